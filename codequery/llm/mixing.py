"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash of their id. Every source queues its documents in that order, ``passes`` times over;
a copy's virtual finish time is the source's cumulative words up to its end divided by the source's weight. The mix is
the global order by finish time, truncated at the word budget.

The order is made and cut range by range. Copies are dealt to equal ranges of virtual time, a copy that spans several by
the words it sends in each; the running total over the ranges shows in which one the budget is reached, and that range
is dealt out again until it is one unit of time wide, within which every source sends at its weight. That gives the
exact time of the cut: a copy that finishes before it is taken whole, one in service at it in part, so that each source
ends at its target to the word. Virtual times are whole numbers, scaled by the weights' common multiple, so sums are
exact and reruns agree. A round reads only the copies that overlap its range and gathers RANGES sums; rows are
range-sorted by finish time where the mix is written out.

Cumulative words are taken in two levels, (source, hash range) sums and then within each range, so that no task holds a
source. ``targets`` has the closed form of what each source gets, which the queue is held against in tests.

Edge cases: a null text has size 0; a null source is a source of its own and comes last; a document in service at the
cut is taken in part; documents of size 0 are taken never; repeated rows queue each on its own; texts of any length are
counted whole; an empty table gives no rows. ``report`` reads four columns and ignores others; ``mixed`` passes other
columns through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequery.llm._support import checkpointed, text_of

BLANK = r"[\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, PASSES = 1.5, 2
#: Ranges of virtual time of a round.
RANGES = 4096


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, passes: int = PASSES, weights: tuple = WEIGHTS) -> DataFrame:
    """Of (source, source_size): weight and target. One row per source, ranked in one task."""
    every = Window.partitionBy()
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), turn + 1)
    out = sizes.withColumn("weight", weight).withColumn("_full", F.lit(passes) * F.col("source_size"))
    out = out.withColumn("_ends", F.col("_full") / F.col("weight"))
    order = every.orderBy("_ends", F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        out.withColumn("_total", share * F.sum("source_size").over(every))
        .withColumn("_done", F.coalesce(F.sum("_full").over(upto), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("_level", (F.col("_total") - F.col("_done")) / F.col("_open"))
    )
    # The cut is the level at the first source that is not used up by then; after that source levels only fall.
    level = F.coalesce(
        F.max(F.when(F.col("_level") <= F.col("_ends"), F.col("_level"))).over(every), F.max("_ends").over(every)
    )
    target = F.least(F.col("_full").cast("double"), F.col("weight") * level)
    return out.select("source", "source_size", "weight", target.alias("target"))


def _placed(df: DataFrame, width: int, seed: str) -> DataFrame:
    """``df`` with its place in the shuffled order: hash, hash range and a source key without nulls."""
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return df.withColumn("_h", digits).withColumn("_range", F.substring("_h", 1, width)).withColumn("_s", key)


def _ranges(placed: DataFrame, share: float, passes: int, weights: tuple) -> DataFrame:
    """(_s, _range, _before, source_size, weight, target): the words of a source before each of its hash ranges."""
    sums = checkpointed(placed.groupBy("source", "_s", "_range").agg(F.sum("size").alias("_sum")))
    earlier = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    plan = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), share, passes, weights)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    plan = plan.select(key.alias("_s"), "source_size", "weight", "target")
    ranges = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    return checkpointed(ranges.select("_s", "_range", "_before").join(plan, "_s"))


def _started(placed: DataFrame, ranges: DataFrame) -> DataFrame:
    """``placed`` with source_size, weight, target and start, the words that its source sends before it in its first
    pass. The rows move once, to their hash range."""
    inside = Window.partitionBy("_s", "_range").orderBy("_h", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(ranges, ["_s", "_range"]).withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return out.withColumn("start", F.col("_before") + F.col("_in")).drop("_s", "_h", "_range", "_in", "_before")


def cut_of(queued: DataFrame, share: float = SHARE, passes: int = PASSES, weights: tuple = WEIGHTS) -> tuple[int, int, int]:
    """(whole, part, slope): the virtual time, in units of 1 / lcm(weights), at which the sources have together sent the
    budget, ``whole + part / slope``; read from the copies of ``queued`` (size, source_size, weight, start)."""
    unit = math.lcm(*weights)
    rate = (F.lit(unit) / F.col("weight")).cast("long")  # virtual time of a word
    copies = queued.where("size > 0").select("size", "source_size", "start", rate.alias("rate"), F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("k"))
    begin = (F.col("start") + F.col("k") * F.col("source_size")) * F.col("rate")
    copies = copies.select(begin.alias("begin"), (begin + F.col("size") * F.col("rate")).alias("end"), "rate")
    last, words = copies.agg(F.max("end"), F.sum(F.expr("(end - begin) div rate"))).first()
    if not last:
        return 0, 0, 1
    # in units of words over ``unit``, so that a word of any source is whole
    budget = round(2 * share * words / passes) * unit
    low, high, sent = 0, last, 0
    while high - low > 1:
        step = -(-(high - low) // RANGES)
        first = F.greatest(F.lit(0), F.expr(f"(begin - {low}) div {step}"))
        final = F.least(F.lit(-(-(high - low) // step) - 1), F.expr(f"(end - 1 - {low}) div {step}"))
        parts = copies.where(f"end > {low} AND begin < {high}").select("begin", "end", "rate", F.explode(F.sequence(first, final)).alias("r"))
        here = F.expr(f"(least(end, least({low} + (r + 1) * {step}, {high})) - greatest(begin, {low} + r * {step})) * ({unit} div rate)")
        sums = parts.groupBy("r").agg(F.sum(here).alias("n"))
        total = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("r"))
        # RANGES rows at most
        found = sums.withColumn("upto", total).where(F.lit(2) * (F.col("upto") + sent) >= F.lit(budget)).orderBy("r").limit(1).first()
        if not found:
            return last, 0, 1
        sent += found.upto - found.n
        low, high = low + found.r * step, min(high, low + (found.r + 1) * step)
    slope = copies.where(f"begin <= {low} AND end > {low}").agg(F.sum(F.expr(f"{unit} div rate"))).first()[0]
    return low, budget - 2 * sent, 2 * slope


def queued(df: DataFrame, share: float = SHARE, passes: int = PASSES, weights: tuple = WEIGHTS, seed: str = "mix") -> DataFrame:
    """``df`` (doc_id, source, size and any others) with source_size, weight, target, taken and finish, the virtual time
    at which its first pass ends. Ids, sources and sizes are kept once to plan with; whole rows move once."""
    light = checkpointed(df.select("doc_id", "source", "size"))
    # About as many hash ranges as there are rows in each; their number sets who adds what up, never the result.
    width = max(2, round(math.log(max(light.count(), 1), 16) / 2))
    placed = _placed(light, width, seed)
    ranges = _ranges(placed, share, passes, weights)
    started = checkpointed(_started(placed, ranges))
    whole, part, slope = cut_of(started, share, passes, weights)
    out = started if set(df.columns) == {"doc_id", "source", "size"} else _started(_placed(df, width, seed), ranges)
    time = (F.lit(float(whole)) + F.lit(float(part)) / F.lit(float(slope))) / F.lit(float(math.lcm(*weights)))
    # Words that the source has sent by the cut; a half counts as a word.
    sent = F.least(F.lit(passes) * F.col("source_size"), F.floor(F.col("weight") * time + 0.5 + 1e-6)).cast("long")
    taken = F.lit(0).cast("long")
    for k in range(passes):
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), sent - k * F.col("source_size") - F.col("start")))
    finish = (F.col("start") + F.col("size")) / F.col("weight")
    return out.withColumn("taken", taken.cast("long")).withColumn("finish", finish).drop("start")


def report(df: DataFrame) -> DataFrame:
    """What the mix takes of every document."""
    sized = df.select("doc_id", "source", size_of(text_of()).alias("size"))
    return queued(sized).select("doc_id", "size", "source_size", "target", "taken", F.col("finish").alias("virtual_finish"))


def mixed(df: DataFrame, share: float = SHARE, passes: int = PASSES, weights: tuple = WEIGHTS) -> DataFrame:
    """The mix itself in order of finish time: a row per copy taken, one in service at the cut shortened to the words
    that it gives. The columns are ``df``'s; ``n_chars``, if there, follows a shortened text."""
    own = df.columns
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), "doc_id", "source", size_of(text_of()).alias("size"))
    found = queued(rows, share, passes, weights).where("taken > 0")
    copies = F.sequence(F.lit(0), F.expr("cast((taken - 1) div size as int)"))
    left = F.col("taken") - F.col("_copy") * F.col("size")
    out = found.withColumn("_copy", F.explode(copies)).withColumn("_words", F.least(F.col("size"), left))
    out = out.withColumn("_at", F.col("finish") + F.col("_copy") * F.col("source_size") / F.col("weight"))
    short = F.col("_words") < F.col("size")
    text = F.when(short, _head(F.col("_row.text"), F.col("_words"))).otherwise(F.col("_row.text"))
    out = out.repartitionByRange("_at", "doc_id").sortWithinPartitions("_at", "doc_id").withColumn("_text", text)
    made = {"text": F.col("_text"), "n_chars": F.when(short, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars"))}
    return out.select(*((made[c] if c in made else F.col(f"_row.`{c}`")).alias(c) for c in own))


def _head(text: Column, n: Column) -> Column:
    """The text's first ``n`` words, joined by single spaces."""
    return F.array_join(F.slice(F.filter(F.split(text, BLANK), lambda w: w != ""), F.lit(1), n.cast("int")), " ")
