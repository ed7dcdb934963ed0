"""Queries of retrieval, fusion and reranking, and their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from codequery.functions import text as X
from codequery.operators import fusion as U
from codequery.operators import retrieval as R
from codequery.plans.views import DOCS, EDGES, FIELDS, QUERIES, documents, part_edges, sql_tokens, table, vector_queries, vectors
from codequery.session import checkpointed, deleted, shared_dir

LIMIT = 20


def _q(spark):
    return R.batch(spark, QUERIES)


def _found(spark, sf_dir, fields, *terms):
    return R.scanned(R.field_tokens(documents(spark, sf_dir), fields), R.batch_terms(*terms))


def r1_disjunction(spark, sf_dir):
    t = R.query_terms(_q(spark))
    return R.ranked(R.disjunction(R.weighted(_found(spark, sf_dir, FIELDS, t), t)), LIMIT)


def r2_bm25(spark, sf_dir):
    return R.bm25(documents(spark, sf_dir), _q(spark), 10)


def r2_benchmark_batch(spark, sf_dir):
    """All texts of ``benchmark`` as one batch."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("query_id"), "text")
    return R.bm25(documents(spark, sf_dir), q, 10)


def r3_idf_only(spark, sf_dir):
    t = R.query_terms(_q(spark))
    return R.ranked(R.disjunction(R.weighted(_found(spark, sf_dir, R.IDF_FIELDS, t), t)), LIMIT)


def r4_enough_matches(spark, sf_dir):
    t = R.query_terms(_q(spark))
    return R.ranked(R.least_matches(R.weighted(_found(spark, sf_dir, FIELDS, t), t)), LIMIT)


def r5_phrase(spark, sf_dir):
    t, fields = R.query_terms(_q(spark)), (*R.PHRASE_FIELDS, "body")
    found = R.phrases(_found(spark, sf_dir, fields, t), t, fields=fields)
    return found.select("query_id", "doc_id", "field", F.round("freq", 6).alias("freq"))


def r6_identifier_expansion(spark, sf_dir):
    t = R.expansion_terms(_q(spark))
    boosts = {f: R.EXPANSION_BOOST for f in R.EXPANSION_FIELDS}
    return R.ranked(R.disjunction(R.weighted(_found(spark, sf_dir, R.EXPANSION_FIELDS, t), t, boosts=boosts)), LIMIT)


SYNONYMS = [("apache", "license"), ("anea", "thanedble"), ("nicht", "sch einber")]


def r7_synonyms(spark, sf_dir):
    t = R.with_synonyms(R.query_terms(_q(spark)), spark.createDataFrame(SYNONYMS, "lhs string, rhs string"))
    found = _found(spark, sf_dir, ("body",), t)
    return R.ranked(R.disjunction(R.weighted(found, t, mixed=False, boosts={"body": 1.0})), LIMIT)


def r8_multipliers(spark, sf_dir):
    d = documents(spark, sf_dir)
    return R.ranked(R.multiplied(R.bm25(d, _q(spark), LIMIT), d, F.lit("ENUM")))


def r9_keyword(spark, sf_dir):
    d = documents(spark, sf_dir)
    return R.keyword(d, _q(spark), LIMIT, keep=F.col("doc_type") != "chunk")


def r9_kept_index(spark, sf_dir):
    """The same search from an inverted table that was written and read again; its folder goes when the result is kept."""
    d = documents(spark, sf_dir)
    folder = f"{shared_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    stats = checkpointed(R.field_stats(R.field_tokens(d, FIELDS)))
    R.save_postings(R.postings(d, FIELDS), folder)
    kept = spark.read.parquet(folder)
    out = checkpointed(R.keyword(d, _q(spark), LIMIT, keep=F.col("doc_type") != "chunk", index=(kept, stats)))
    deleted(spark, folder)
    return out


def r10_knn(spark, sf_dir):
    return R.knn(vectors(spark, sf_dir), vector_queries(spark, sf_dir), LIMIT)


def _chunks(spark, sf_dir):
    """Vectors as chunks of documents: one document for every ten ids, every third document without chunks."""
    v = vectors(spark, sf_dir)
    return v.where(F.expr("doc_id div 10") % 3 != 0).select(F.expr("doc_id div 10").alias("doc_id"), "vec")


def r11_late_interaction(spark, sf_dir):
    v = vectors(spark, sf_dir).where(F.col("doc_id") % 10 == 0).select(F.expr("doc_id div 10").alias("doc_id"), "vec")
    q = vector_queries(spark, sf_dir)
    return R.late_interaction(R.knn(v, q, LIMIT), _chunks(spark, sf_dir), q)


def r12_mean_pooling(spark, sf_dir):
    pooled = R.mean_pooled(_chunks(spark, sf_dir))
    return pooled.select("doc_id", F.size("vec").alias("dims"), F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def r13_vector_multipliers(spark, sf_dir):
    return R.ranked(R.multiplied(r10_knn(spark, sf_dir), documents(spark, sf_dir)))


def _both(spark, sf_dir):
    """Words and vectors on one numbering: query 1 and 7 of either."""
    words = R.bm25(documents(spark, sf_dir), R.batch(spark, [(1, QUERIES[0][1]), (7, QUERIES[1][1])]), 30)
    return words, R.knn(vectors(spark, sf_dir), vector_queries(spark, sf_dir, (1, 7)), 30)


def r14_unified(spark, sf_dir):
    return R.unified(*_both(spark, sf_dir), U.UNIFIED_NONE, LIMIT)


def r15_words_without_vectors(spark, sf_dir):
    words, near = _both(spark, sf_dir)
    return R.unified(words, near.where("false"), U.UNIFIED_NONE, LIMIT)


def r16_borda(spark, sf_dir):
    return U.borda(list(_both(spark, sf_dir)), [0.7, 0.3], LIMIT)


def r17_borda_many(spark, sf_dir):
    words, near = _both(spark, sf_dir)
    return U.borda([words, near, words.where("rank <= 5")], limit=LIMIT)


def r18_rrf(spark, sf_dir):
    return U.rrf(list(_both(spark, sf_dir)), limit=LIMIT)


def r19_pool(spark, sf_dir):
    return U.cross_encoded(list(_both(spark, sf_dir)), None, None, None, LIMIT)


def overlap_score():
    """A stand-in for a cross-encoder: the share of the query's words that the passage has."""
    q, p = F.array_distinct(X.tokens(F.col("query"))), F.array_distinct(X.tokens(F.col("passage")))
    return F.size(F.array_intersect(q, p)) / F.greatest(F.lit(1), F.size(q))


def r20_cross_encoder(spark, sf_dir):
    words, _ = _both(spark, sf_dir)
    texts = documents(spark, sf_dir).select("doc_id", X.passage(F.col("name"), F.col("signature"), F.col("javadoc"), F.col("body")).alias("passage"))
    return U.cross_encoded([words], texts, R.batch(spark, [(1, QUERIES[0][1]), (7, QUERIES[1][1])]), overlap_score(), LIMIT)


def _labelled(spark, sf_dir):
    return r10_knn(spark, sf_dir).join(vectors(spark, sf_dir).select("doc_id", "label"), "doc_id")


def r21_class_diversity(spark, sf_dir):
    return U.diversified(_labelled(spark, sf_dir), F.col("label").cast("string"), 15)


def r22_type_diversity(spark, sf_dir):
    return U.diversified(_labelled(spark, sf_dir), F.coalesce(F.when(F.col("label") < 5, "class"), F.lit("unknown")), 15, 0.8)


def r23_project_affinity(spark, sf_dir):
    d = documents(spark, sf_dir)
    hits = R.bm25(d, _q(spark), LIMIT).join(d.select("doc_id", "project"), "doc_id")
    return R.ranked(U.boosted(hits, F.col("project").isin("src1", "src2", "src3"), U.AFFINITY))


def r24_hint_boosts(spark, sf_dir):
    d = documents(spark, sf_dir)
    hits = R.bm25(d, _q(spark), LIMIT).join(d.select("doc_id", "project", "file_path"), "doc_id")
    hits = U.boosted(hits, F.col("project") == "src4", U.EXPLICIT)
    return R.ranked(U.boosted(hits, F.col("file_path").endswith(".java"), U.IMPLICIT))


def r25_neighbours(spark, sf_dir):
    out = U.with_neighbours(R.bm25(documents(spark, sf_dir), _q(spark), LIMIT), part_edges(spark, sf_dir))
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "kind")


def r27_camel_hybrid(spark, sf_dir):
    """The older hybrid; a query that names a class leans on words."""
    asked = R.batch(spark, [(1, "HashMap anea"), (7, "merge the lists")])
    return U.camel_hybrid(*_both(spark, sf_dir), asked, LIMIT)


def r28_projection(spark, sf_dir):
    d = documents(spark, sf_dir)
    hits = R.bm25(d, _q(spark), LIMIT).join(d, "doc_id")
    return hits.select("query_id", "rank", "doc_id", F.coalesce("doc_type", F.lit("method")).alias("doc_type"), X.label(F.col("doc_type")).alias("label"), "name", "class_name", "file_path", "score")


# -- SQL ---------------------------------------------------------------------------------------------------------------


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _match_ctes(queries=QUERIES, fields=FIELDS, mixed=True, boosts=None, terms=None) -> str:
    boosts = boosts or R.BOOSTS
    tok = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {sql_tokens(f)} AS t FROM docs" for f in fields)
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}::DOUBLE" for f, b in boosts.items()) + " ELSE 1.0::DOUBLE END"
    idf = "ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
    bm = lambda k1, b: f"{idf} * tf / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * ln_ / avg_len))"
    sim = bm(1.2, 0.75)
    if mixed:
        sim = "CASE WHEN field IN ('name', 'class_name', 'signature') THEN ln((n_docs + 1)::DOUBLE / (df + 1)) + 1 " + f"WHEN field IN ('javadoc', 'caller_context') THEN {bm(1.0, 0.5)} ELSE {bm(1.2, 0.9)} END"
    source = queries if isinstance(queries, str) else f"SELECT * FROM (VALUES {_values(queries)}) v(query_id, text)"
    own = f"""q AS ({source}),
qt AS (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS spot FROM (SELECT query_id, {sql_tokens('text')} AS ts FROM q)),
"""
    terms = terms or "SELECT query_id, term, min(spot) AS spot FROM qt GROUP BY query_id, term"
    return f"""WITH {DOCS}, {own}terms0 AS ({terms}),
terms AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_terms FROM terms0),
tok AS (SELECT doc_id, field, t, len(t) AS ln_ FROM ({tok}) WHERE len(t) > 0),
fs AS (SELECT field, count(*) AS n_docs, avg(ln_) AS avg_len FROM tok GROUP BY field),
occ AS (SELECT doc_id, field, ln_, term, pos FROM (SELECT doc_id, field, ln_, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tok) WHERE term IN (SELECT term FROM terms)),
post AS (SELECT doc_id, field, ln_, term, count(*) AS tf FROM occ GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
w AS (SELECT query_id, term, doc_id, field, n_terms, {boost} * ({sim}) AS w FROM post JOIN dfs USING (field, term) JOIN fs USING (field) JOIN terms USING (term)),
disj AS (SELECT query_id, doc_id, sum(w) AS score FROM w GROUP BY ALL)"""


def _ranked(source: str, limit: int | None = LIMIT) -> str:
    top = f" WHERE rank <= {limit}" if limit else ""
    return f"SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM {source})){top}"


_LEAST = "lm AS (SELECT query_id, doc_id, 1.5::DOUBLE * sum(w) AS score FROM w GROUP BY ALL HAVING max(n_terms) >= 2 AND count(DISTINCT term) >= greatest(2, ceil(0.75::DOUBLE * max(n_terms))))"


def _phrase_ctes(fields) -> str:
    return f"""po AS (SELECT query_id, doc_id, field, term, spot, n_terms, pos - spot AS o FROM occ JOIN terms USING (term) WHERE n_terms >= 2 AND field IN ({', '.join(repr(f) for f in fields)})),
whole AS (SELECT query_id, doc_id, field, min(spot) AS first_at FROM po GROUP BY ALL HAVING count(DISTINCT term) = max(n_terms)),
anchors AS (SELECT po.query_id, po.doc_id, po.field, po.o AS a FROM po JOIN whole w ON po.query_id = w.query_id AND po.doc_id = w.doc_id AND po.field = w.field AND po.spot = w.first_at),
near AS (SELECT a.query_id, a.doc_id, a.field, a.a, p.term, arg_min(p.o, abs(p.o - a.a) * 100000000 + p.o) AS o FROM anchors a JOIN po p ON a.query_id = p.query_id AND a.doc_id = p.doc_id AND a.field = p.field GROUP BY ALL),
spreads AS (SELECT query_id, doc_id, field, a, max(o) - min(o) AS d FROM near GROUP BY ALL),
freqs AS (SELECT query_id, doc_id, field, sum(CASE WHEN d <= 2 THEN 1.0::DOUBLE / (1 + d) ELSE 0 END) AS freq FROM spreads GROUP BY ALL HAVING sum(CASE WHEN d <= 2 THEN 1 ELSE 0 END) > 0)"""


_SPLIT = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_$\-]+', ' ', 'g')), '\s+', ' ', 'g'))"""


def _expansion_terms() -> str:
    words = r"SELECT query_id, unnest(regexp_split_to_array(text, '\s+')) AS x FROM q"
    return f"SELECT DISTINCT query_id, term, 0 AS spot FROM (SELECT query_id, unnest(string_split({_SPLIT}, ' ')) AS term FROM ({words}) WHERE contains(x, '_') OR regexp_matches(x, '^.+[A-Z]')) WHERE length(term) >= 3"


_PATH = """CASE WHEN file_path IS NULL THEN 1.0::DOUBLE WHEN contains(file_path, '/benchmark/') THEN 0.25 WHEN contains(file_path, '/jmh/') THEN 0.25 WHEN contains(file_path, '/src/test/') THEN 0.3 WHEN contains(file_path, '/test/') THEN 0.3
  WHEN contains(file_path, '/.github/') THEN 0.1 WHEN regexp_matches(file_path, '\\.(md|txt|sh|yml)$') THEN 0.1 ELSE 1.0 END""".replace("\\\\", "\\")
_KIND = "CASE WHEN doc_type = 'class' AND NOT contains(file_path, '/src/test/') AND NOT contains(file_path, '/test/') THEN 1.8::DOUBLE ELSE 1.0 END"
_ACCESS = "CASE access WHEN 'public' THEN 1.0::DOUBLE WHEN 'protected' THEN 0.85 WHEN 'private' THEN 0.5 ELSE 0.75 END"


def _class_type(intent: str | None) -> str:
    if not intent:
        return "1.0::DOUBLE"
    row = X.CLASS_BONUS[intent]
    return "CASE WHEN class_type IS NULL THEN 1.0::DOUBLE " + " ".join(f"WHEN class_type = '{k}' THEN {v}" for k, v in zip(X.CLASS_TYPES, row, strict=False)) + f" ELSE {row[-1]} END"


def _multiplied(source: str, intent: str | None = None) -> str:
    graph = "(1 + 0.3::DOUBLE * ln(1 + in_degree::DOUBLE) / ln(1 + greatest(1, max(in_degree) OVER (PARTITION BY query_id))::DOUBLE))"
    return f"(SELECT h.query_id, h.doc_id, h.score * ({graph} * ({_PATH}) * ({_KIND}) * ({_class_type(intent)}) * ({_ACCESS})) AS score FROM {source} h JOIN docs USING (doc_id))"


def _bm25(limit, queries=QUERIES, name="kw") -> str:
    return _match_ctes(queries, ("body",), False, {"body": 1.0}) + f", {name} AS ({_ranked('disj', limit)})"


_COS = "list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE), lambda s, v: s + v)"


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: _COS.format(a=x, b=y)
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


def _knn(ids=(0, 1, 7), limit=LIMIT, name="kv", div=1) -> str:
    return f"{name} AS ({_ranked(f'(SELECT q.vec_id::INTEGER AS query_id, e.vec_id // {div} AS doc_id, (1 + {_cos("e.embedding", "q.embedding")}) / 2 AS score FROM embeddings e, embeddings q WHERE q.vec_id IN {ids} AND e.vec_id % {div} = 0)', limit)})"


_PAIR = [(1, QUERIES[0][1]), (7, QUERIES[1][1])]


def _both_sql() -> str:
    return _bm25(30, _PAIR) + ", " + _knn((1, 7), 30)


def oracle_sql() -> dict[str, str]:
    body = (*R.PHRASE_FIELDS, "body")
    kw = _match_ctes() + f", {_LEAST}, {_phrase_ctes(R.PHRASE_FIELDS)}"
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {R.BOOSTS[f]}::DOUBLE" for f in R.PHRASE_FIELDS) + " END"
    ph = f"ph AS (SELECT query_id, doc_id, sum(3.0::DOUBLE * {boost} * freq / (freq + 1)) AS score FROM freqs GROUP BY ALL)"
    unified = lambda v: (
        _both_sql() + f", u AS (SELECT query_id, doc_id, CASE WHEN vs IS NULL THEN lift * 0.01 ELSE vs + lift END AS score FROM (SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.doc_id, v.doc_id) AS doc_id, v.score AS vs, "
        f"0.3::DOUBLE * (1 - 2 / (exp(2 * coalesce(k.score, 0) / 150.0::DOUBLE) + 1)) AS lift FROM kw k FULL JOIN {v} v ON k.query_id = v.query_id AND k.doc_id = v.doc_id)) " + _ranked("u")
    )
    lists = lambda *xs: "lists AS (" + " UNION ALL ".join(f"SELECT {i} AS list, * FROM {x}" for i, x in enumerate(xs)) + ")"
    counted = "c AS (SELECT *, count(*) OVER (PARTITION BY query_id, list) AS n FROM lists)"
    diverse = lambda key, decay: (
        f"WITH {_knn()}, l AS (SELECT query_id, doc_id, score, {key} AS k FROM kv JOIN embeddings ON vec_id = doc_id), "
        f"s AS (SELECT query_id, doc_id, score * pow({decay}, row_number() OVER (PARTITION BY query_id, k ORDER BY score DESC, doc_id) - 1) AS score FROM l) " + _ranked("s", 15)
    )
    q_share = f"len(list_intersect(list_distinct({sql_tokens('q.text')}), list_distinct({sql_tokens('p.passage')})))::DOUBLE / greatest(1, len(list_distinct({sql_tokens('q.text')})))"
    expansion = _match_ctes(fields=R.EXPANSION_FIELDS, boosts={f: 0.5 for f in R.EXPANSION_FIELDS}, terms=_expansion_terms())
    syn = _values(SYNONYMS)
    syn_terms = f"SELECT query_id, term, min(spot) AS spot FROM (SELECT * FROM qt UNION ALL SELECT qt.query_id, unnest(string_split(rhs, ' ')) AS term, qt.spot FROM qt JOIN (VALUES {syn}) s(lhs, rhs) ON lhs = qt.term) GROUP BY query_id, term"
    inner = expansion.replace("WITH ", "", 1)
    for name in ("terms0", "terms", "tok", "fs", "occ", "post", "dfs", "disj"):
        inner = re.sub(rf"\b{name}\b", f"x_{name}", inner)
    inner = re.sub(r"\bw AS \(", "x_w AS (", inner).replace("sum(w) AS score FROM w ", "sum(w) AS score FROM x_w ")
    inner = inner[inner.index("x_terms0 AS") :]
    kw_all = kw + f", {ph}, base AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT * FROM disj UNION ALL SELECT * FROM lm UNION ALL SELECT * FROM ph) GROUP BY ALL), {inner}, raw AS (SELECT b.query_id, b.doc_id, b.score + coalesce(x.score, 0) AS score FROM base b LEFT JOIN x_disj x USING (query_id, doc_id) JOIN docs USING (doc_id) WHERE doc_type <> 'chunk'), "
    return {
        "r1_disjunction": _match_ctes() + " " + _ranked("disj"),
        "r2_bm25": _bm25(10) + " SELECT * FROM kw",
        "r2_benchmark_batch": _bm25(10, "SELECT item_id::INTEGER AS query_id, text FROM benchmark") + " SELECT * FROM kw",
        "r9_kept_index": kw_all + f"top AS ({_ranked('raw')}) " + _ranked(_multiplied("top"), None),
        "r3_idf_only": _match_ctes(fields=R.IDF_FIELDS) + " " + _ranked("disj"),
        "r4_enough_matches": _match_ctes() + f", {_LEAST} " + _ranked("lm"),
        "r5_phrase": _match_ctes(fields=body) + f", {_phrase_ctes(body)} SELECT query_id, doc_id, field, round(freq, 6) AS freq FROM freqs",
        "r6_identifier_expansion": expansion + " " + _ranked("disj"),
        "r7_synonyms": _match_ctes(fields=("body",), mixed=False, boosts={"body": 1.0}, terms=syn_terms) + " " + _ranked("disj"),
        "r8_multipliers": _bm25(LIMIT) + " " + _ranked(_multiplied("kw", "ENUM"), None),
        "r10_knn": f"WITH {_knn()} SELECT * FROM kv",
        "r11_late_interaction": f"WITH {_knn(div=10, name='f')}, b AS (SELECT f.query_id, f.doc_id, max((1 + {_cos('c.embedding', 'q.embedding')}) / 2) AS best FROM f JOIN embeddings c ON c.vec_id // 10 = f.doc_id AND (c.vec_id // 10) % 3 <> 0 JOIN embeddings q ON q.vec_id = f.query_id GROUP BY ALL), s AS (SELECT f.query_id, f.doc_id, coalesce(best, score) AS score FROM f LEFT JOIN b USING (query_id, doc_id)) "
        + _ranked("s", None),
        "r12_mean_pooling": "WITH x AS (SELECT vec_id // 10 AS doc_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings WHERE (vec_id // 10) % 3 <> 0), m AS (SELECT doc_id, d, avg(x) AS m FROM x GROUP BY ALL) SELECT doc_id, count(*)::INTEGER AS dims, round(max(m) FILTER (WHERE d = 1), 6) AS first, round(sum(m), 6) AS total FROM m GROUP BY doc_id",
        "r13_vector_multipliers": f"WITH {DOCS}, {_knn()} " + _ranked(_multiplied("kv"), None),
        "r14_unified": unified("kv"),
        "r15_words_without_vectors": unified("(SELECT * FROM kv WHERE FALSE)"),
        "r16_borda": _both_sql() + f", {lists('kw', 'kv')}, {counted}, s AS (SELECT query_id, doc_id, sum((CASE list WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END) * (n - rank + 1)) * CASE WHEN count(DISTINCT list) = 2 THEN 1.5::DOUBLE ELSE 1.0 END AS score FROM c GROUP BY ALL) " + _ranked("s"),
        "r17_borda_many": _both_sql() + f", {lists('kw', 'kv', '(SELECT * FROM kw WHERE rank <= 5)')}, {counted}, s AS (SELECT query_id, doc_id, sum(n - rank + 1)::DOUBLE AS score FROM c GROUP BY ALL) " + _ranked("s"),
        "r27_camel_hybrid": _both_sql() + f", {lists('kw', 'kv')}, {counted}, s AS (SELECT query_id, doc_id, sum((CASE WHEN query_id = 1 THEN CASE list WHEN 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END ELSE 0.5::DOUBLE END) * (n - rank + 1)) * CASE WHEN count(DISTINCT list) = 2 THEN 1.5::DOUBLE ELSE 1.0 END AS score FROM c GROUP BY ALL) " + _ranked("s"),
        "r18_rrf": _both_sql() + f", {lists('kw', 'kv')}, s AS (SELECT query_id, doc_id, sum(1::DOUBLE / (60 + rank)) * CASE WHEN count(DISTINCT list) = 2 THEN 1.5::DOUBLE ELSE 1.0 END AS score FROM lists GROUP BY ALL) " + _ranked("s"),
        "r19_pool": _both_sql() + f", {lists('kw', 'kv')}, p AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY list, rank) = 1) SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY list, rank, doc_id))::INTEGER AS rank, doc_id, score FROM p) WHERE rank <= {LIMIT}",
        "r20_cross_encoder": _bm25(30, _PAIR) + f", p AS (SELECT doc_id, concat_ws(' ', nullif(name, ''), nullif(signature, ''), nullif(CASE WHEN javadoc <> '' THEN substr(javadoc, 1, 300) ELSE substr(body, 1, 300) END, '')) AS passage FROM docs), s AS (SELECT k.query_id, k.doc_id, {q_share} AS score FROM kw k JOIN p USING (doc_id) JOIN q USING (query_id)) " + _ranked("s"),
        "r21_class_diversity": diverse("label", "0.5::DOUBLE"),
        "r22_type_diversity": diverse("CASE WHEN label < 5 THEN 'class' ELSE 'unknown' END", "0.8::DOUBLE"),
        "r23_project_affinity": _bm25(LIMIT) + " " + _ranked("(SELECT query_id, doc_id, CASE WHEN project IN ('src1', 'src2', 'src3') THEN score * 1.5::DOUBLE ELSE score END AS score FROM kw JOIN docs USING (doc_id))", None),
        "r24_hint_boosts": _bm25(LIMIT) + " " + _ranked("(SELECT query_id, doc_id, score * CASE WHEN project = 'src4' THEN 1.8::DOUBLE ELSE 1 END * CASE WHEN file_path LIKE '%.java' THEN 1.3::DOUBLE ELSE 1 END AS score FROM kw JOIN docs USING (doc_id))", None),
        "r25_neighbours": _bm25(LIMIT) + ", " + EDGES + ", n AS (SELECT query_id, dst AS doc_id, score * 0.5::DOUBLE AS score, row_number() OVER (PARTITION BY query_id, dst ORDER BY rank) AS k FROM kw JOIN edges ON src = doc_id WHERE rank <= 3), m AS (SELECT n.* FROM n ANTI JOIN kw USING (query_id, doc_id) WHERE k = 1) SELECT query_id, doc_id, round(score, 6) AS score, 'primary' AS kind FROM kw UNION ALL SELECT query_id, doc_id, round(score, 6), 'related' FROM m",
        "r28_projection": _bm25(LIMIT) + " SELECT query_id, rank, doc_id, coalesce(doc_type, 'method') AS doc_type, CASE doc_type WHEN 'class' THEN 'class' WHEN 'doc' THEN 'document' WHEN 'chunk' THEN 'chunk' ELSE 'method' END AS label, name, class_name, file_path, score FROM kw JOIN docs USING (doc_id)",
        "r9_keyword": kw_all + f"top AS ({_ranked('raw')}) " + _ranked(_multiplied("top"), None),
    }


def queries():
    return {n: f for n, f in globals().items() if n[0] == "r" and n[1:2].isdigit()}
