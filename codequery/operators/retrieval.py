"""Ranked retrieval over multi-field documents and vectors.

Queries come in batches: every table has ``query_id``. What a batch matches comes from one of two sources with the same
rows, ``Matches``: ``scanned`` reads the documents once and keeps, in their own rows, the tokens that are among the
batch's terms (a hash lookup a token, however many terms there are); ``looked_up`` reads a kept inverted table, dealt by
a hash of the term and sorted by term, of which only the batch's buckets and terms are read. Tiers, phrases and
expansions of a batch share one such pass. All orders end in ``doc_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequery.functions import text as X
from codequery.session import checkpointed

#: Boost of a field, and of a field in a phrase.
BOOSTS = {"name": 4.0, "class_name": 4.0, "javadoc": 2.0, "signature": 1.5, "annotations": 1.0, "caller_context": 1.0, "body": 0.5}
PHRASE_FIELDS = ("name", "class_name", "javadoc", "signature")
IDF_FIELDS = ("name", "class_name", "signature")
#: k1 and b of BM25 by field.
BM25 = {"javadoc": (1.0, 0.5), "caller_context": (1.0, 0.5)}
BM25_OTHER = (1.2, 0.9)
MATCH_SHARE, MATCH_BOOST, PHRASE_BOOST, SLOP, EXPANSION_BOOST = 0.75, 1.5, 3.0, 2, 0.5
EXPANSION_FIELDS = ("name", "class_name", "javadoc")
GRAPH_WEIGHT = 0.3
UNIFIED_SCALE = 150.0
#: Up to this many synonym rules, or query vectors, are broadcast; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_VECTORS = 100_000, 1_000
#: Parts of the inverted table by the term's hash, and parts in which a large batch of vectors meets all others.
BUCKETS, VECTOR_PARTS = 64, 64


def field_tokens(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(doc_id, field, tokens, len) of each document and field that has words."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), X.tokens(F.col(f)).alias("tokens")) for f in fields)))
    out = docs.select("doc_id", each.alias("f")).select("doc_id", "f.field", "f.tokens", F.size("f.tokens").cast("long").alias("len"))
    return out.where("len > 0")


def postings(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The inverted table: (field, term, doc_id, tf, positions, len)."""
    rows = field_tokens(docs, fields).select("doc_id", "field", "len", F.posexplode("tokens").alias("pos", "term"))
    rows = rows.groupBy("field", "term", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.max("len").alias("len"))
    return rows.select("field", "term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions", "len")


def with_places(tokens: str) -> Column:
    return F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))


def by_term(each: Column) -> Column:
    """(term, positions) of each term of an array of (term, pos): sorted once and cut where the term changes, within the
    row and without comparing each term with all words."""

    def cut(s: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"])
        run = lambda at, i, k: F.slice(s, i + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - i).getField("pos")
        runs = lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i)["term"].alias("term"), run(at, i, k).alias("positions")))
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        return X.bound(F.filter(places, new), runs)

    return X.bound(F.sort_array(each), cut)


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def save_postings(rows: DataFrame, folder: str) -> None:
    """The inverted table in ``folder``: a part for each bucket, sorted by term, so that a term is found by skipping."""
    out = rows.withColumn("bucket", bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(4)))
    out.sortWithinPartitions("bucket", "term", "field", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def field_stats(tokens: DataFrame) -> DataFrame:
    """(field, n_docs, avg_len)."""
    return tokens.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, at, n_terms) of (query_id, text): each distinct term with its first place."""
    rows = queries.select("query_id", F.posexplode(X.tokens(F.col("text"))).alias("at", "term"))
    rows = rows.groupBy("query_id", "term").agg(F.min("at").alias("at"))
    return rows.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))


def with_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Query terms and what ``synonyms`` (lhs, rhs) adds to them; places follow the term that brought them."""
    few = synonyms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    added = terms.join(F.broadcast(synonyms) if few else synonyms, terms.term == synonyms.lhs).select("query_id", F.explode(X.tokens(F.col("rhs"))).alias("term"), "at")
    both = terms.select("query_id", "term", "at").unionByName(added).groupBy("query_id", "term").agg(F.min("at").alias("at"))
    return both.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))


@dataclass(frozen=True)
class Matches:
    """What a batch's terms match: ``rows`` (doc_id, field, len, term, tf, positions) of all fields, and ``stats`` of the
    fields (field, n_docs, avg_len)."""

    rows: DataFrame
    stats: DataFrame

    def of(self, fields: tuple[str, ...]) -> Matches:
        return Matches(self.rows.where(F.col("field").isin(*fields)), self.stats)


def batch_terms(*tables: DataFrame) -> list[str]:
    """The distinct terms of query tables: a batch's own, not the corpus's."""
    return sorted({r.term for t in tables for r in t.select("term").distinct().collect()})


def scanned(tokens: DataFrame, terms: list[str]) -> Matches:
    """Matches by one pass over ``tokens`` (doc_id, field, tokens, len): of each row the tokens that are among the terms,
    gathered in the row; row-local. The statistics come from the same pass."""
    hits = F.filter(with_places("tokens"), lambda x: x["term"].isin(terms)) if terms else F.array().cast("array<struct<term:string,pos:int>>")
    rows = checkpointed(tokens.select("doc_id", "field", "len", by_term(hits).alias("m")))
    stats = rows.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    rows = rows.select("doc_id", "field", "len", F.explode("m").alias("m"))
    return Matches(rows.select("doc_id", "field", "len", "m.term", F.size("m.positions").cast("long").alias("tf"), "m.positions"), checkpointed(stats))


def looked_up(kept: DataFrame, stats: DataFrame, terms: list[str]) -> Matches:
    """Matches from an inverted table that ``save_postings`` has written: the batch's buckets, and in them its terms."""
    wanted = kept.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(bucket(F.col("term")).alias("b"))
    buckets = [r.b for r in wanted.distinct().collect()]
    rows = kept.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)) if terms else kept.where("false")
    return Matches(checkpointed(rows.select("doc_id", "field", "len", "term", "tf", "positions")), stats)


def similarity(field: Column, tf: Column, length: Column, n: Column, df: Column, avg: Column, mixed: bool = True) -> Column:
    """A term's weight in a field: BM25, or for names only the inverse document frequency."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))

    def bm25(k1: float, b: float) -> Column:
        return idf * tf / (tf + k1 * (1 - b + b * length / avg))

    if not mixed:
        return bm25(1.2, 0.75)
    out = F.when(field.isin(*IDF_FIELDS), F.log((n + 1) / (df + 1)) + 1)
    for name, (k1, b) in BM25.items():
        out = out.when(field == name, bm25(k1, b))
    return out.otherwise(bm25(*BM25_OTHER))


def weighted(found: Matches, terms: DataFrame, mixed: bool = True, boosts: dict[str, float] | None = None) -> DataFrame:
    """(query_id, term, doc_id, field, n_terms, w) of every match: boosted weights."""
    df = found.rows.groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.coalesce(*(F.when(F.col("field") == f, F.lit(b)) for f, b in (boosts or BOOSTS).items()), F.lit(1.0))
    out = found.rows.join(df, ["field", "term"]).join(found.stats, "field").join(terms, "term")
    w = similarity(F.col("field"), F.col("tf"), F.col("len"), F.col("n_docs"), F.col("df"), F.col("avg_len"), mixed)
    return out.select("query_id", "term", "doc_id", "field", "n_terms", (boost * w).alias("w"))


def disjunction(weights: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the sum over all matched terms and fields."""
    return weights.groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


def least_matches(weights: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the boosted sum of documents with enough distinct terms."""
    rows = weights.groupBy("query_id", "doc_id").agg(F.sum("w").alias("s"), F.countDistinct("term").alias("k"), F.max("n_terms").alias("n"))
    return rows.where((F.col("n") >= 2) & (F.col("k") >= F.greatest(F.lit(2), F.ceil(MATCH_SHARE * F.col("n"))))).select("query_id", "doc_id", (MATCH_BOOST * F.col("s")).alias("score"))


def phrases(found: Matches, terms: DataFrame, slop: int = SLOP, fields: tuple[str, ...] = PHRASE_FIELDS) -> DataFrame:
    """(query_id, doc_id, field, freq): sloppy occurrences of the whole query, ``sum 1 / (1 + spread)``.

    Every place of the query's first term anchors at most one occurrence: each other term takes the place whose offset,
    less its place in the query, is nearest to the anchor's. The spread is that of the offsets; more than ``slop`` is none.
    """
    rows = found.of(fields).rows.join(terms.where("n_terms >= 2"), "term")
    each = F.array_sort(F.collect_list(F.struct("at", "positions"))).alias("t")
    rows = rows.groupBy("query_id", "doc_id", "field").agg(F.count("*").alias("k"), F.max("n_terms").alias("n"), each)
    rows = rows.where(F.col("k") == F.col("n"))
    offsets = F.transform("t", lambda x: F.transform(x["positions"], lambda p: p - x["at"]))
    rows = rows.withColumn("o", offsets)

    def spread(anchor: Column) -> Column:
        nearest = lambda ps: F.array_min(F.transform(ps, lambda p: F.struct(F.abs(p - anchor).alias("d"), p.alias("p"))))
        near = F.transform("o", lambda ps: nearest(ps)["p"])
        return F.array_max(near) - F.array_min(near)

    spreads = F.transform(F.get("o", F.lit(0)), spread)
    freq = F.aggregate(spreads, F.lit(0.0), lambda a, d: a + F.when(d <= slop, 1 / (1 + d)).otherwise(0.0))
    return rows.select("query_id", "doc_id", "field", freq.alias("freq")).where("freq > 0")


def phrase_scores(found: Matches, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the phrase tier: freq / (freq + 1), field boosts, tier boost."""
    boost = F.coalesce(*(F.when(F.col("field") == f, F.lit(BOOSTS[f])) for f in PHRASE_FIELDS))
    part = F.sum(PHRASE_BOOST * boost * F.col("freq") / (F.col("freq") + 1))
    return phrases(found, terms).groupBy("query_id", "doc_id").agg(part.alias("score"))


def expansion_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of the words of three characters or more inside identifier-like words."""
    words = queries.select("query_id", F.explode(F.split("text", r"\s+")).alias("w")).where(X.is_identifier_like(F.col("w")))
    parts = words.select("query_id", F.explode(F.split(X.split_identifier(F.col("w")), " ")).alias("term"))
    return parts.where(F.length("term") >= 3).distinct().withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))


def multiplied(hits: DataFrame, docs: DataFrame, intent: Column | None = None) -> DataFrame:
    """Hits with ``score`` times the factors of call graph, path, kind, class type and access."""
    most = F.greatest(F.lit(1), F.max("in_degree").over(Window.partitionBy("query_id")))
    out = hits.join(docs.select("doc_id", "in_degree", "file_path", "doc_type", "class_type", "access"), "doc_id")
    graph = 1 + GRAPH_WEIGHT * F.log1p(F.col("in_degree")) / F.log1p(most)
    factor = graph * X.path_factor(F.col("file_path")) * X.doc_type_factor(F.col("doc_type"), F.col("file_path")) * X.class_type_factor(F.col("class_type"), intent if intent is not None else F.lit(None).cast("string")) * X.access_factor(F.col("access"))
    return out.select("query_id", "doc_id", (F.col("score") * factor).alias("score"))


def ranked(hits: DataFrame, limit: int | None = None, digits: int = 6) -> DataFrame:
    """(query_id, rank, doc_id, score), scores rounded before ties are broken."""
    out = hits.select("query_id", "doc_id", F.round("score", digits).alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return (out.where(F.col("rank") <= limit) if limit else out).select("query_id", "rank", "doc_id", "score")


@dataclass(frozen=True)
class Asked:
    """The terms of a batch: its own, those with synonyms, and those inside of identifiers."""

    plain: DataFrame
    wide: DataFrame
    inner: DataFrame

    @classmethod
    def of(cls, queries: DataFrame, synonyms: DataFrame | None = None) -> Asked:
        plain = query_terms(queries)
        wide = with_synonyms(plain, synonyms) if synonyms is not None else plain
        return cls(plain, wide, expansion_terms(queries))

    def all(self) -> list[str]:
        return batch_terms(self.wide, self.inner)


def keyword(
    docs: DataFrame,
    queries: DataFrame,
    limit: int,
    synonyms: DataFrame | None = None,
    keep: Column | None = None,
    intent: Column | None = None,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Keyword search: disjunction, enough-matches and phrase tiers, identifier expansion, then the factors on the top.

    ``index`` (postings, stats) is a kept inverted table of the documents; without it their texts are read.
    """
    asked = Asked.of(queries, synonyms)
    found = looked_up(*index, asked.all()) if index else scanned(field_tokens(docs, tuple(BOOSTS)), asked.all())
    weights = weighted(found, asked.wide)
    tiers = disjunction(weights).unionByName(least_matches(weights)).unionByName(phrase_scores(found, asked.plain))
    base = tiers.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    extra = weighted(found.of(EXPANSION_FIELDS), asked.inner, boosts={f: EXPANSION_BOOST for f in EXPANSION_FIELDS})
    raw = base.join(disjunction(extra).withColumnRenamed("score", "more"), ["query_id", "doc_id"], "left")
    raw = raw.select("query_id", "doc_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    if keep is not None:
        raw = raw.join(docs.where(keep).select("doc_id"), "doc_id", "left_semi")
    return ranked(multiplied(ranked(raw, limit), docs, intent))


def bm25(docs: DataFrame, queries: DataFrame, limit: int, field: str = "body") -> DataFrame:
    """BM25 over one field with the common constants."""
    terms = query_terms(queries)
    found = scanned(field_tokens(docs, (field,)), batch_terms(terms))
    return ranked(disjunction(weighted(found, terms, mixed=False, boosts={field: 1.0})), limit)


# -- vectors -----------------------------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def asked_pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``vectors`` with each query vector of their dimension (query_id, qv). A batch of few is broadcast; a larger one is
    dealt into parts, each of which all vectors meet."""
    q = queries.select("query_id", F.col("vec").alias("qv"))
    if q.limit(BROADCAST_VECTORS + 1).count() <= BROADCAST_VECTORS:
        return vectors.join(F.broadcast(q), F.size("vec") == F.size("qv"))
    q = q.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(VECTOR_PARTS)).cast("int"))
    each = vectors.withColumn("_each", F.explode(F.sequence(F.lit(0), F.lit(VECTOR_PARTS - 1))))
    return each.join(q, (F.col("_each") == F.col("_part")) & (F.size("vec") == F.size("qv"))).drop("_part", "_each")


def knn(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, doc_id, score): nearest of (doc_id, vec) to (query_id, vec), score (1 + cosine) / 2; exact."""
    score = (1 + cosine(F.col("vec"), F.col("qv"))) / 2
    return ranked(asked_pairs(vectors, queries).select("query_id", "doc_id", score.alias("score")), limit)


def late_interaction(first: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``first``'s hits scored by their best chunk (doc_id, vec); hits without chunks keep their score."""
    q = queries.select("query_id", F.col("vec").alias("qv"))
    if q.limit(BROADCAST_VECTORS + 1).count() <= BROADCAST_VECTORS:
        q = F.broadcast(q)
    pairs = first.select("query_id", "doc_id").join(chunks, "doc_id").join(q, "query_id")
    best = pairs.groupBy("query_id", "doc_id").agg(F.max((1 + cosine(F.col("vec"), F.col("qv"))) / 2).alias("best"))
    out = first.select("query_id", "doc_id", "score").join(best, ["query_id", "doc_id"], "left")
    return ranked(out.select("query_id", "doc_id", F.coalesce("best", "score").alias("score")))


def mean_pooled(chunks: DataFrame) -> DataFrame:
    """(doc_id, vec): the mean of a document's chunk vectors."""
    rows = chunks.select("doc_id", F.posexplode("vec").alias("d", "x")).groupBy("doc_id", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("s")).select("doc_id", F.transform("s", lambda x: x["m"]).alias("vec"))


def unified(words: DataFrame, vectors: DataFrame, bonus: float | Column, limit: int) -> DataFrame:
    """Vector scores with a bonus for words: ``vec + bonus * tanh(bm25 / 150)``; without a vector the bonus at a hundredth."""
    both = words.select("query_id", "doc_id", F.col("score").alias("b")).join(vectors.select("query_id", "doc_id", F.col("score").alias("v")), ["query_id", "doc_id"], "full_outer")
    bonus = bonus if isinstance(bonus, Column) else F.lit(bonus)
    lift = F.tanh(F.coalesce("b", F.lit(0.0)) / UNIFIED_SCALE) * bonus
    return ranked(both.select("query_id", "doc_id", F.when(F.col("v").isNull(), lift * 0.01).otherwise(F.col("v") + lift).alias("score")), limit)


def batch(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A batch of queries."""
    return spark.createDataFrame(rows, "query_id int, text string")
