"""Quality rules with thresholds from mergeable quantile sketches per language and source.

Each document gets four rates in thousandths (symbols, repeated words, repeated lines, capitals). A sketch is a
set of (bin, count) rows whose bins grow with the value, so that a value is off by less than a sixteenth; sketches
merge by adding counts, and do so for a language and source, a language, and all rows. A rate is too high above
``q75 + fence * max(q75 - q25, least spread)`` of the finest of those three groups that has ``least_rows`` rows.
The sketches are joined back to the documents by null-safe keys, and the verdict is taken.

Edge cases: a null text has no words and fails the base rule; null languages and sources are groups of their own; texts
of any length are read whole, and windows are counted by a sort within the text; ties of a rate share a bin; repeated rows
count each time and are judged alike; an empty table gives no rows; columns besides those used pass through ``filtered``
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequery.llm._support import checkpointed, text_of

#: Characters that part words.
BLANK = r"[\x20\x09-\x0D]+"
#: Rate, and the least spread of its group in thousandths.
RATES = (("symbol_rate", 20), ("repeat_rate", 100), ("line_rate", 150), ("capital_rate", 70))
FENCE, LEAST_ROWS = 3, 30
#: Up to this many threshold rows (a few dozen bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
_HASH_BITS = 33


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with word and line counts and the four rates; row-local."""
    text = text_of(text_col)
    out = df.withColumn("_w", F.filter(F.split(text, BLANK), lambda w: w != ""))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    # A window's key holds 33 bits of its hash and its position; equal neighbours after the sort are candidates.
    last = F.col("n_words").cast("int") - 3
    key = lambda i: F.shiftleft(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)), 64 - _HASH_BITS).bitwiseOR(i.cast("long"))
    out = out.withColumn("_k", F.sort_array(F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), key))))
    same = lambda a, b: F.shiftright(a.bitwiseXOR(b), 64 - _HASH_BITS) == 0
    near = lambda x, i: ((i > 0) & same(x, F.get("_k", i - 1))) | ((i < F.size("_k") - 1) & same(x, F.get("_k", i + 1)))
    position = lambda x: x.bitwiseAND(F.lit((1 << (64 - _HASH_BITS)) - 1)).cast("int")
    gram = lambda i: F.struct(F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("g"), i.alias("i"))
    out = out.withColumn("_c", F.sort_array(F.transform(F.filter("_k", near), lambda x: gram(position(x)))))
    # The candidates are compared as strings, so that hashes decide nothing.
    equal = lambda x, i: ((i > 0) & (x["g"] == F.get("_c", i - 1)["g"])) | ((i < F.size("_c") - 1) & (x["g"] == F.get("_c", i + 1)["g"]))
    out = out.withColumn("_p", F.sort_array(F.transform(F.filter("_c", equal), lambda x: x["i"])))
    step = lambda x, i: F.when(i == F.size("_p") - 1, F.lit(3)).otherwise(F.least(F.lit(3), F.get("_p", i + 1) - x))
    repeated = F.aggregate(F.transform("_p", step), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_lines", lines)
    out = (
        out.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long"))
        .withColumn("_capitals", F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"))
        .withColumn("_n_lines", F.size("_lines").cast("long"))
    )
    share = lambda part, whole: F.coalesce(F.expr(f"{part} * 1000 div nullif({whole}, 0)"), F.lit(0)).cast("long")
    out = (
        out.withColumn("symbol_rate", share("n_symbols", "word_chars"))
        .withColumn("repeat_rate", share("n_repeat_words", "n_words"))
        .withColumn("line_rate", share("n_dup_lines", "_n_lines"))
        .withColumn("capital_rate", share("_capitals", "word_chars"))
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("_w", "_k", "_c", "_p", "_lines", "_capitals", "_n_lines")


def bin_of(v: Column) -> Column:
    """The lower end of a value's bin: exact below 64, then 32 bins to each doubling."""
    out = F.when(v < 64, v)
    for k in range(1, 5):
        out = out.when(v < 64 << k, F.shiftleft(F.shiftright(v, k), k))
    return out.otherwise(F.lit(1024)).cast("long")


def sketches(df: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n): the finest sketches, added up before the shuffle."""
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("rate"), bin_of(F.col(name)).alias("bin")) for name, _ in RATES)))
    return df.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.rate", "p.bin").agg(F.count("*").alias("n"))


def merged(finest: DataFrame) -> DataFrame:
    """The sketches at three levels: 0 language and source, 1 language, 2 all."""
    level = lambda k, lang, source: finest.select(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"), "rate", "bin", "n")
    none = F.lit(None).cast("string")
    every = level(0, F.col("lang"), F.col("source")).unionByName(level(1, F.col("lang"), none)).unionByName(level(2, none, none))
    return every.groupBy("level", "lang", "source", "rate", "bin").agg(F.sum("n").alias("n"))


def limits(every: DataFrame, fence: int = FENCE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per language and source: the highest rate each document of it may have."""
    group = ["level", "lang", "source", "rate"]
    running = every.withColumn("cum", F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    at = lambda q: F.min(F.when(100 * F.col("cum") >= q * F.col("total"), F.col("bin")))
    marks = running.groupBy(*group).agg(at(25).alias("q25"), at(75).alias("q75"), F.max("total").alias("total"))
    spread = F.coalesce(*(F.when(F.col("rate") == name, F.lit(least)) for name, least in RATES))
    marks = marks.withColumn("most", F.col("q75") + fence * F.greatest(F.col("q75") - F.col("q25"), spread))
    wide = marks.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *(F.max(F.when(F.col("rate") == name, F.col("most"))).alias(f"most_{name}") for name, _ in RATES))
    names = [f"most_{name}" for name, _ in RATES]
    fine, by_lang, whole = (wide.where(F.col("level") == k) for k in (0, 1, 2))
    by_lang = by_lang.select(F.col("lang").alias("_lang"), F.col("total").alias("_n1"), *(F.col(x).alias(f"_1{x}") for x in names))
    whole = whole.select(F.lit(1).alias("_one"), *(F.col(x).alias(f"_2{x}") for x in names))
    both = fine.withColumn("_one", F.lit(1)).join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).join(whole, "_one")
    pick = lambda x: F.when(F.col("total") >= least_rows, F.col(x)).when(F.col("_n1") >= least_rows, F.col(f"_1{x}")).otherwise(F.col(f"_2{x}"))
    return both.select("lang", "source", *(pick(x).alias(x) for x in names))


def judged(df: DataFrame, fence: int = FENCE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``df``, which has ``features``' columns, with ``kept``. ``df`` is read twice: hand in a table or a checkpoint."""
    most = checkpointed(limits(merged(sketches(df)), fence, least_rows)).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(f"most_{name}" for name, _ in RATES))
    if most.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        most = F.broadcast(most)
    out = df.join(most, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    too_high = F.lit(False)
    for name, _ in RATES:
        too_high = too_high | (F.col(name) > F.col(f"most_{name}"))
    return out.withColumn("kept", ~F.col("base_failed") & ~too_high).drop("_lang", "_source")


def report(df: DataFrame) -> DataFrame:
    """The counts and verdict of every document."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rates = [name for name, _ in RATES]
    found = features(df.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", *counts, *rates, "base_failed")
    return judged(checkpointed(found)).select("doc_id", *counts, "base_failed", "kept", *rates, *(f"most_{x}" for x in rates))


def filtered(df: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    own = [c for c in df.columns]
    inside = df.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), "lang", "source", "text")
    found = features(inside).drop("text")
    return judged(checkpointed(found)).where("kept").select("_row.*")
