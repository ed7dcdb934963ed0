"""Text mining: characteristic terms, bigrams, acronyms, name grams, synonym rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequery.functions import text as X
from codequery.session import checkpointed

STAT_WEIGHT, POSITION_WEIGHT, WINDOW, TOP = 0.4, 0.6, 5, 10
#: Up to so many ranked documents, or names, go to every task.
BROADCAST_ROWS = 100_000
#: Stop words of characteristic terms.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on",
    "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with", "from",
    "about", "also", "just", "only", "very", "over", "under", "after", "before", "between", "during", "through", "without",
    "within", "against", "which", "who", "what", "when", "where", "how", "than", "can", "may", "might", "each", "one",
    "two", "per", "i", "e", "g", "etc", "eg", "ie", "returns", "return", "param", "throws", "method", "class", "interface",
    "object", "instance", "type", "value", "result", "list", "array", "map", "null", "true", "false", "public", "private",
    "protected", "static",
]


def terms_of(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(doc_id, field, term) once each, without short, dotted or stop words."""
    fine = lambda t: (F.length(t) >= 3) & ~F.contains(t, F.lit(".")) & ~t.isin(STOP_WORDS)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.array_distinct(F.filter(X.tokens(F.col(f)), fine)).alias("t")) for f in fields)))
    return docs.select("doc_id", each.alias("f")).select("doc_id", "f.field", F.explode("f.t").alias("term"))


def background(terms: DataFrame) -> DataFrame:
    """(term, df): the largest document frequency over the fields."""
    return terms.groupBy("field", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.max("n").alias("df"))


def characteristic(docs: DataFrame, ranked: DataFrame, fields: tuple[str, ...], top: int = TOP, window: int = WINDOW) -> DataFrame:
    """Of each query's ranked documents the terms that set them apart: frequency against all documents, and early ranks."""
    every = terms_of(docs, fields)
    ranked = checkpointed(ranked)
    # The terms of a few ranked documents are cut from their texts alone; of many, the keys of all are joined.
    few = ranked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = terms_of(docs.join(F.broadcast(ranked.select("doc_id").distinct()), "doc_id", "left_semi"), fields) if few else every
    n_docs = docs.count()
    ahead = ranked.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    hits = own.join(ahead.select("query_id", "doc_id", "rank", "n"), "doc_id").select("query_id", "doc_id", "term", "rank", "n").distinct()
    early = F.when(F.col("rank") <= window, 1 / F.sqrt(F.col("rank").cast("double"))).otherwise(0.0)
    front = hits.groupBy("query_id", "term").agg(F.count("*").alias("fg"), F.max("n").alias("n"), F.sum(early).alias("pos"))
    wanted = background(every)  # counted before it meets the terms, so that no row of a text is shuffled
    stat = F.greatest(F.lit(0.0), F.log((F.col("fg") / F.col("n")) / (F.greatest(F.col("df"), F.lit(1)) / F.lit(float(n_docs)))))
    out = front.join(wanted, "term").withColumn("stat", stat)
    w = Window.partitionBy("query_id")
    share = lambda x: F.coalesce(F.col(x) / F.nullif(F.max(x).over(w), F.lit(0.0)), F.lit(0.0))
    out = out.withColumn("score", F.round(STAT_WEIGHT * share("stat") + POSITION_WEIGHT * share("pos"), 6))
    out = out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "term")))
    return out.where(F.col("rank") <= top).select("query_id", "rank", "term", "score", "fg", F.col("df").alias("bg"))


def name_grams(classes: DataFrame, longest: int = 3) -> DataFrame:
    """(gram, class) of (class): runs of one to three words of a class name; two words need 4 characters, three need 6."""
    words = classes.select("class", F.split(X.split_identifier(F.col("class")), " ").alias("w"))
    starts = F.sequence(F.lit(1), F.size("w"))
    cut = lambda i, n: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, F.lit(n)), "").alias("gram"), (i + n - 1 <= F.size("w")).alias("whole"))
    every = F.flatten(F.transform(starts, lambda i: F.array(*(cut(i, n) for n in range(1, longest + 1)))))
    rows = words.select("class", F.explode(every).alias("g")).where("g.whole")
    least = F.when(F.col("g.n") == 1, 3).when(F.col("g.n") == 2, 4).otherwise(6)
    return rows.where(F.length("g.gram") >= least).select(F.col("g.gram").alias("gram"), "class").distinct()


def acronyms(docs: DataFrame, text: str) -> DataFrame:
    """(acronym, expansion) written as ``expansion (ACR)`` or ``ACR (expansion)`` whose initials fit."""
    one = F.transform(F.regexp_extract_all(text, F.lit(r"([a-zA-Z][\w\s-]{3,35})\s*\(([A-Z]{3,10})\)"), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r"\(([A-Z]{3,10})\)$", 1).alias("acronym"), F.regexp_extract(m, r"^(.*?)\s*\([A-Z]{3,10}\)$", 1).alias("expansion")))
    two = F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{3,10})\s+\(([a-zA-Z][\w\s-]{3,35})\)"), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r"^([A-Z]{3,10})", 1).alias("acronym"), F.regexp_extract(m, r"\((.*)\)$", 1).alias("expansion")))
    rows = docs.select(F.explode(F.concat(one, two)).alias("p")).select("p.*")
    # the last as many words as the acronym has letters, by their initials
    words = F.split(F.trim("expansion"), r"[\s-]+")
    n = F.length("acronym")
    tail = F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), n)
    fits = F.upper(F.array_join(F.transform(tail, lambda w: F.substring(w, 1, 1)), "")) == F.col("acronym")
    return rows.where(fits).select("acronym", F.lower(F.array_join(tail, " ")).alias("expansion")).distinct()


def expansion_grams(phrases: DataFrame) -> DataFrame:
    """(gram, class) of (phrase, class): pairs of content words, the whole phrase, and runs of three words, joined."""
    words = phrases.select("class", F.split(F.lower(F.trim("phrase")), r"[\s-]+").alias("w"))
    words = words.withColumn("c", F.filter("w", lambda x: (F.length(x) >= 3) & ~x.isin(STOP_WORDS)))
    runs = lambda a, n, fine: F.when(F.size(a) >= n, F.filter(F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, F.lit(n)), "")), fine)).otherwise(F.array().cast("array<string>"))
    plain = lambda least: lambda g: (F.length(g) >= least) & (F.length(g) <= 20) & ~F.rlike(g, F.lit("^[0-9]"))
    w, c = F.col("w"), F.col("c")
    whole = F.filter(F.array(F.array_join(w, "")), lambda g: (F.size(w) >= 2) & plain(4)(g))
    starts = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.when(F.length(F.get(w, i - 1)) >= 2, F.array_join(F.slice(w, i, F.lit(3)), ""))))
    three = F.coalesce(F.filter(starts, lambda g: g.isNotNull() & plain(6)(g)), F.array().cast("array<string>"))
    grams = F.concat(runs(c, 2, lambda g: F.length(g) >= 4), whole, three)
    return words.select(F.explode(grams).alias("gram"), "class").distinct()


def initialisms(docs: DataFrame, text: str) -> DataFrame:
    """(acronym, phrase, class): words of the text whose initials spell a part of the class's name that has no vowel."""
    parts = F.filter(F.split(X.split_identifier(F.col("class")), " "), lambda p: F.rlike(p, F.lit(r"^[^aeiou]{3,6}$")))
    clean = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z\s]", " ")), r"\s+")
    rows = docs.select("class", F.explode(F.array_distinct(parts)).alias("acronym"), clean.alias("w"))
    n = F.length("acronym")
    at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
    some = F.transform(at, lambda i: F.slice("w", i, n))
    fits = lambda s: F.array_join(F.transform(s, lambda x: F.substring(x, 1, 1)), "") == F.col("acronym")
    found = rows.select("class", "acronym", F.explode(F.filter(some, fits)).alias("s"))
    return found.select("acronym", F.array_join("s", " ").alias("phrase"), "class").distinct()


def link_graph(docs: DataFrame) -> DataFrame:
    """(lhs, rhs) of (class, comment): the first sentence's terms, and each class's own name, lead to the classes that its
    comment links to; those lead back to it."""
    rows = docs.select("class", F.explode(X.linked_classes(F.col("comment"))).alias("to"), X.first_sentence(F.col("comment")).alias("s"))
    known = docs.select(F.lower("class").alias("_low"), F.col("class").alias("target")).distinct()
    rows = rows.join(known, F.lower("to") == F.col("_low"))
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    terms = F.filter(F.transform(X.tokens(F.col("s")), lambda t: X.normal_term(t, stop)), lambda t: t.isNotNull())
    said = rows.select(F.explode(terms).alias("lhs"), F.col("target").alias("rhs"))
    there = rows.select(F.lower("class").alias("lhs"), F.col("target").alias("rhs"))
    back = rows.select(F.lower("target").alias("lhs"), F.col("class").alias("rhs"))
    return said.unionByName(there).unionByName(back).distinct()


#: Parts of package names that say nothing of a class.
GENERIC_PARTS = (
    "org", "apache", "lucene", "java", "javax", "com", "net", "util", "core", "search", "index", "store", "analysis",
    "common", "codec", "codecs", "document", "query", "queries", "test", "tests",
)


def package_paths(classes: DataFrame) -> DataFrame:
    """(lhs, rhs) of (fqn, class): the parts of a class's package that are not generic lead to it."""
    parts = F.filter(F.split(F.regexp_replace("fqn", r"\.?[^.]*$", ""), r"\."), lambda p: (F.length(p) >= 3) & ~p.isin(*GENERIC_PARTS))
    return classes.select(F.explode(F.transform(parts, F.lower)).alias("lhs"), F.col("class").alias("rhs")).distinct()


def places(words: Column) -> Column:
    """The places of an array, from 0; none of an empty one."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))


def context_windows(docs: DataFrame, names: DataFrame, text: str, width: int = 5, least: int = 2, top: int = 15) -> DataFrame:
    """(lhs, rhs, n): of the terms within ``width`` words of a class's name, or of a word of it, those seen ``least``
    times, the ``top`` of each class. ``docs`` (doc_id, text), ``names`` (token, class)."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    names = checkpointed(names.groupBy("token").agg(F.min("class").alias("class")))
    wanted = [r.token for r in names.select("token").limit(BROADCAST_ROWS + 1).collect()]
    if len(wanted) <= BROADCAST_ROWS:
        # few names: their windows are cut within the row
        at = lambda t: F.filter(places(t), lambda i: F.get(t, i).isin(wanted))
        before = lambda i: F.least(i, F.lit(width))
        around = lambda t, i: F.concat(F.slice(t, i - before(i) + 1, before(i)), F.slice(t, i + 2, F.lit(width)))
        windows = X.bound(X.tokens(F.col(text)), lambda t: F.transform(at(t), lambda i: F.struct(F.get(t, i).alias("token"), around(t, i).alias("near"))))
        near = docs.select(F.explode(windows).alias("w")).select("w.token", "w.near").join(F.broadcast(names), "token")
        near = near.select("class", F.explode("near").alias("token"))
    else:
        words = docs.select("doc_id", F.posexplode(X.tokens(F.col(text))).alias("pos", "token"))
        steps = F.array(*(F.lit(k) for k in range(-width, width + 1) if k))
        near = words.join(names, "token").select("doc_id", "class", F.explode(F.transform(steps, lambda k: F.col("pos") + k)).alias("pos"))
        near = near.join(words, ["doc_id", "pos"])
    near = near.select(X.normal_term(F.col("token"), stop).alias("lhs"), F.col("class").alias("rhs"))
    found = near.where("lhs IS NOT NULL").groupBy("lhs", "rhs").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("rhs").orderBy(F.desc("n"), "lhs"))
    return found.withColumn("_k", rank).where(F.col("_k") <= top).drop("_k")


def bigrams(docs: DataFrame, key: str, text: str, percent: float = 10) -> DataFrame:
    """(key, bigram, ppmi): of each key's joined neighbouring words those that are likelier in it than in all, the best ``percent``."""
    t = F.col("t")
    pair = F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.struct(F.get(t, i).alias("a"), F.get(t, i + 1).alias("b")))
    content = lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS)
    fine = lambda p: (F.length(p["a"]) >= 2) & (F.length(p["b"]) >= 2) & (content(p["a"]) | content(p["b"])) & (F.length(p["a"]) + F.length(p["b"]) >= 4)
    rows = docs.select(F.col(key).alias("key"), X.tokens(F.col(text)).alias("t")).where(F.size("t") >= 2)
    rows = rows.select("key", F.explode(F.transform(F.filter(pair, fine), lambda p: F.concat(p["a"], p["b"]))).alias("bigram"))
    tf = rows.groupBy("key", "bigram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("bigram").agg(F.count("*").alias("df"))
    sizes = tf.groupBy("key").agg(F.sum("tf").alias("len"))
    n_keys = sizes.count()
    out = tf.join(df, "bigram").join(sizes, "key")
    out = out.withColumn("ppmi", F.round(F.log((F.col("tf") / F.col("len")) / (F.col("df") / F.lit(n_keys))), 6)).where("ppmi > 0")
    return best_share(checkpointed(out.select("key", "bigram", "ppmi")), "key", "ppmi", "bigram", percent)


def best_share(rows: DataFrame, key: str, score: str, name: str, percent: float) -> DataFrame:
    """Of each key's rows the best ``percent`` by score, one at least, ties by name. Whole values of the score are taken
    by their counts; only the value at the cut is ranked by name, so that no task sorts the rows of a large key."""
    counts = rows.groupBy(F.col(key).alias("_key"), F.col(score).alias("_score")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_key").orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    most = F.greatest(F.lit(1), F.ceil(F.sum("_n").over(Window.partitionBy("_key")) * percent / 100))
    counts = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_left", most - F.col("_upto") + F.col("_n"))
    counts = counts.where("_left > 0").select("_key", "_score", "_n", "_left")
    found = rows.join(counts, (F.col(key) == F.col("_key")) & (F.col(score) == F.col("_score")))
    own = [F.col(c) for c in rows.columns]
    whole = found.where("_n <= _left").select(*own)
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(name))
    cut = found.where("_n > _left").withColumn("_k", nth).where("_k <= _left").select(*own)
    return whole.unionByName(cut)


def tf_idf(docs: DataFrame, key: str, text: str, top: int = TOP) -> DataFrame:
    """(key, rank, term, score): terms of each key by frequency and rarity among keys."""
    rows = docs.select(F.col(key).alias("key"), F.explode(X.tokens(F.col(text))).alias("term"))
    tf = rows.groupBy("key", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.select(key).distinct().count()
    out = tf.join(df, "term").withColumn("score", F.round(F.col("tf") * F.log(F.lit(float(n)) / F.col("df")), 6))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "term")))
    return out.where(F.col("rank") <= top).select("key", "rank", "term", "score")


def limited_fan_out(rules: DataFrame, most: int, least_count: int | None = None) -> DataFrame:
    """Rules (lhs, rhs[, n]) whose trigger leads to at most ``most`` targets, seen often enough."""
    out = rules if least_count is None else rules.where(F.col("n") >= least_count)
    return out.withColumn("_f", F.count("*").over(Window.partitionBy("lhs"))).where(F.col("_f") <= most).drop("_f")


def combined(sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """(lhs, rhs, sources): rules of several miners with a bit for each; long or numeric triggers are left out."""
    rows = None
    for bit, rules in sources:
        part = rules.select("lhs", "rhs").withColumn("bit", F.lit(1 << bit))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where((F.length("lhs") <= 20) & ~F.rlike("lhs", F.lit("^[0-9]"))).groupBy("lhs", "rhs").agg(F.bit_or("bit").alias("sources"))


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rules of ``new`` that may be added: unknown trigger of 4 characters or more, two targets at most, no identity, no tests."""
    fine = (F.length("lhs") >= 4) & (F.lower("lhs") != F.lower("rhs")) & ~F.startswith(F.lower(F.col("lhs")), F.lit("test"))
    return limited_fan_out(new.where(fine).join(old.select("lhs").distinct(), "lhs", "left_anti").select("lhs", "rhs").distinct(), 2)


def redundant(rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Rules whose target is not among the best hits (lhs, target) of the trigger already."""
    return rules.join(hits.select("lhs", F.col("target").alias("rhs")), ["lhs", "rhs"], "left_anti")


def co_callers(edges: DataFrame, least: float = 0.05) -> DataFrame:
    """(a, b, jaccard) of nodes that share callers, at least so similar.

    Prefixes keep hubs from meeting all against all: with callers in the order of their degrees, a pair so similar must
    share one of the first ``n - ceil(least * n) + 1`` callers of either, and sizes must be within ``least`` of each
    other. Pairs that meet so are then counted in full.
    """
    e = edges.select("src", "dst").distinct()
    degree = e.groupBy(F.col("src").alias("_s")).agg(F.count("*").alias("_d"))
    rows = e.join(degree, F.col("src") == F.col("_s")).groupBy("dst")
    sets = checkpointed(rows.agg(F.array_sort(F.collect_list(F.struct("_d", "src"))).alias("callers"), F.count("*").alias("n")))
    first = F.slice("callers", F.lit(1), (F.col("n") - F.ceil(least * F.col("n")) + 1).cast("int"))
    heads = sets.select("dst", "n", F.explode(first).alias("c")).select("dst", "n", F.col("c.src").alias("src"))
    x, y = heads.alias("x"), heads.alias("y")
    near = (F.col("x.n") >= least * F.col("y.n")) & (F.col("y.n") >= least * F.col("x.n"))
    pairs = x.join(y, (F.col("x.src") == F.col("y.src")) & (F.col("x.dst") < F.col("y.dst")) & near)
    pairs = pairs.select(F.col("x.dst").alias("a"), F.col("y.dst").alias("b")).distinct()
    of = lambda end: sets.select(F.col("dst").alias(end), F.transform("callers", lambda c: c["src"]).alias(f"_{end}"))
    both = F.size(F.array_intersect("_a", "_b"))
    out = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", both)
    share = F.round(F.col("both") / (F.size("_a") + F.size("_b") - F.col("both")), 6)
    return out.select("a", "b", share.alias("jaccard")).where(F.col("jaccard") >= least)


def npmi(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n, npmi) of (item, a, b) rows: normalised pointwise mutual information over items."""
    ab = pairs.select("item", "a", "b").distinct()
    total = F.lit(ab.select("item").distinct().count())
    count = lambda *c: ab.select("item", *c).distinct().groupBy(*c).agg(F.count("*").alias("n" + "".join(c)))
    out = count("a", "b").join(count("a"), "a").join(count("b"), "b").where(F.col("nab") >= least)
    pab = F.col("nab") / total
    value = F.when(pab < 1, F.log(pab / (F.col("na") / total * F.col("nb") / total)) / -F.log(pab)).otherwise(1.0)
    return out.select("a", "b", F.col("nab").alias("n"), F.round(value, 6).alias("npmi"))
