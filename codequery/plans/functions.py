"""Queries of the scalar functions, of routing and of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequery.functions import text as X
from codequery.operators import index as K
from codequery.operators import lookup as L
from codequery.operators import retrieval as R
from codequery.operators import routing as U
from codequery.plans import retrieval as P
from codequery.plans.retrieval import _ACCESS, _KIND, _PATH, _SPLIT, _class_type, _values
from codequery.plans.views import DOCS, QUERIES, documents, sql_tokens, table, vectors

NAMES = [(1, "parseXMLDocument"), (2, "snake_case_name"), (3, "HTTPServer2Go"), (4, "simple"), (5, "A"), (6, "toJSON"), (7, "x-ray$value")]
RETURNS = ["List<User>", "Set<Order>", "Map<String,User>", "Optional<User>", "CompletableFuture<List<User>>", "User[]", "User", "void", "", "Stream<int[]>", "Foo<Bar>", "HashMap<K,List<V>>", "Deque<X>"]
FQNS = ["com.a.B#run(int,Map<String,List<X>>)", "com.a.B#<init>()", "com.a.B", "B#x(a)", "Top", "p.q.R#m(Map<A,B>,C,D)"]
TYPES = ["java.util.List<a.B>", "java.util.Map<java.lang.String,x.y.Z[]>", "int", "a.b.C...", "a.b.C$D"]
COMMENTS = ["Uses {@link a.b.Cache#get} and {@link Store}. More.\n@see x.Index#put() end", "No links here. Second one", "One only"]
ASKS = [
    (1, "find code that parses json"), (2, "interface for storage"), (3, "class that implements Comparable"), (4, "configure the cache size"), (5, "HashMap"), (6, "throws IOException on close"), (7, "merge ranked lists quickly"),
    (8, "how does the index grow"), (9, "Foo#bar now"), (10, "@Override usage"), (11, "tiny words"), (12, "Open Close"), (13, "enum with states for the graph"), (14, "graceful shutdown of nodes"), (15, ""), (16, "indexWriter flush"),
]


def _names(spark):
    return spark.createDataFrame(NAMES, "id int, x string")


def _texts(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "x string")


def f1_split_identifier(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("id"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("x"))
    return _names(spark).unionByName(parts).select("id", "x", X.split_identifier(F.col("x")).alias("words"))


def f2_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"), F.array_max("t").alias("last"))


def f3_query_terms(spark, sf_dir):
    s = spark.createDataFrame(P.SYNONYMS, "lhs string, rhs string")
    return R.with_synonyms(R.query_terms(R.batch(spark, QUERIES)), s).select("query_id", "term", F.col("at").alias("place"), "n_terms")


def f4_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.escaped(F.col("url")).alias("escaped"))


def f21_line_ranges(spark, sf_dir):
    """Ranges written as bytes and read back."""
    p = table(spark, sf_dir, "part").withColumn("r", F.transform(F.sequence(F.lit(1), F.col("p_size") % 4), lambda i: F.struct((i * 10).alias("start"), (i * 10 + F.col("p_size")).alias("end"))))
    raw = X.encoded_ranges(F.when(F.col("p_size") % 4 > 0, F.col("r")).otherwise(F.slice("r", 1, 0)))
    return p.select("p_partkey", F.hex(raw).alias("raw"), F.array_join(F.transform(X.decoded_ranges(raw), lambda r: F.concat_ws("-", r["start"], r["end"])), ",").alias("ranges"))


def f27_refs_stamp(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return K.refs_stamp(c.select(F.col("c_mktsegment").alias("project"), F.col("c_name").alias("caller"), (F.col("c_custkey") % 10).cast("string").alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.lit("T")).alias("receiver")))


def f5_identifier_like(spark, sf_dir):
    return _names(spark).select("x", X.is_identifier_like(F.col("x")).alias("yes"))


def f6_scope(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", X.scope(F.col("file_path"), F.col("doc_type") == "chunk").alias("scope"))


def f7_factors(spark, sf_dir):
    d = documents(spark, sf_dir)
    intents = ("INTERFACE", "ENUM", "IMPLEMENTATION")
    return d.select("doc_id", X.path_factor(F.col("file_path")).alias("path"), X.doc_type_factor(F.col("doc_type"), F.col("file_path")).alias("kind"), X.access_factor(F.col("access")).alias("access"), *(X.class_type_factor(F.col("class_type"), F.lit(i)).alias(i.lower()) for i in intents))


def f11_return_phrase(spark, sf_dir):
    return _texts(spark, RETURNS).select("x", X.return_phrase(F.col("x")).alias("phrase"))


def f12_description(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    name = F.concat(F.lower(F.get(words, F.lit(0))), F.initcap(F.lit("total")))
    return p.select("p_partkey", X.description(name, F.lit("Part"), F.col("p_size") % 5 == 0, F.transform(words, lambda w: F.concat(w, F.lit("Id"))), F.when(F.col("p_size") % 2 == 0, "List<Part>").otherwise("void"), F.split("p_type", " ")).alias("text"))


def f13_embedding_text(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.sha2(X.embedding_text(F.col("doc_type"), F.col("name"), F.col("signature"), F.col("javadoc"), F.col("body")), 256).alias("digest"))


def f14_passage(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", X.passage(F.col("name"), F.col("signature"), F.col("javadoc"), F.col("body")).alias("passage"))


def f15_fqn_parts(spark, sf_dir):
    return _texts(spark, FQNS).select("x", X.fqn_parts(F.col("x")).alias("p")).select("x", "p.*")


def f16_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.extension(F.concat(F.regexp_replace("url", r"[?#].*", ""), F.when(F.col("page_id") % 2 == 0, ".HTML").otherwise(""))).alias("extension"))


def f17_levenshtein(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_name", F.levenshtein("n_name", F.lit("INDIANA")).alias("edits"))


def f19_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


def f20_field_name(spark, sf_dir):
    return _texts(spark, ["BAAI/bge-small-en-v1.5", "a..b", "--x--", "m" * 80]).select("x", X.field_name(F.col("x")).alias("field"))


def f22_first_word(spark, sf_dir):
    return _names(spark).select("x", X.first_word(F.col("x")).alias("word"))


def f23_first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("sentence"))


def f24_normal_terms(spark, sf_dir):
    stop = F.array(F.lit("the"), F.lit("and"), F.lit("with"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("t"))
    return d.select("doc_id", X.normal_term(F.col("t"), stop).alias("term")).where("term IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("term").alias("n_distinct"))


def f25_linked_classes(spark, sf_dir):
    return _texts(spark, COMMENTS).select("x", F.array_join(X.linked_classes(F.col("x")), ",").alias("classes"))


def f28_collision_probability(spark, sf_dir):
    v = vectors(spark, sf_dir).where("doc_id = 0").select(F.col("vec").alias("qv"))
    pairs = vectors(spark, sf_dir).join(F.broadcast(v), F.size("vec") == F.size("qv"))  # one query
    return pairs.select("doc_id", F.round(X.collision_probability(R.cosine(F.col("vec"), F.col("qv")), 8), 6).alias("p"))


def s3_project_name(spark, sf_dir):
    return _texts(spark, ["lucene-10.4.0", "app-1", "tool", "a-b-2.x", "x-1.2-3.4"]).select("x", X.project_name(F.col("x")).alias("name"))


def s6_simple_types(spark, sf_dir):
    return _texts(spark, TYPES).select("x", X.simple_type(F.col("x")).alias("simple"))


def _asks(spark):
    return spark.createDataFrame(ASKS, "query_id int, text string")


def u1_intents(spark, sf_dir):
    return U.tagged_intents(_asks(spark)).select("query_id", "intent")


def u2_routes(spark, sf_dir):
    return U.intent_phrases(spark).select("intent").distinct().select("intent", U.routed_type(F.col("intent")).alias("type"), U.routed_doc_type(F.col("intent")).alias("doc_type"))


def u3_heuristic(spark, sf_dir):
    return _asks(spark).select("query_id", U.heuristic(F.col("text")).alias("h")).select("query_id", "h.type", "h.intent")


def u4_default_classifier(spark, sf_dir):
    return _asks(spark).select("query_id", U.default_type(F.col("text")).alias("type"))


def u5_classified(spark, sf_dir):
    return U.classified(_asks(spark))


#: Where queries of a type go.
AUTO = {"KEYWORD": "_auto-keyword", "HYBRID": "_auto-hybrid-rrf", "HYBRID_RERANKED": "_auto-hybrid-rrf-reranked", "default": "_auto-hybrid-rrf"}


def registry(spark, sf_dir) -> U.Registry:
    """All pipelines over the fixed tables; vectors are looked up by query id."""
    from codequery.operators import fusion as M

    d, v = documents(spark, sf_dir), vectors(spark, sf_dir)
    keyword = lambda q, n: R.bm25(d, q, n)
    near = lambda q, n: R.knn(v, v.join(q.select(F.col("query_id").cast("long").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").cast("int").alias("query_id"), "vec"), n)
    mixed = lambda q, n: R.unified(keyword(q, 5 * n), near(q, 5 * n), M.UNIFIED_NONE, n)
    mmr = lambda x, n: M.diversified(x.join(d.select("doc_id", "class_name"), "doc_id"), F.col("class_name"), n)
    kinds = lambda x: M.diversified(x.join(d.select("doc_id", "doc_type"), "doc_id"), F.coalesce("doc_type", F.lit("unknown")))
    texts = d.select("doc_id", X.passage(F.col("name"), F.col("signature"), F.col("javadoc"), F.col("body")).alias("passage"))
    asked = R.batch(spark, QUERIES)
    ce = lambda x, n: M.cross_encoded([x], texts, asked, P.overlap_score(), n)
    both, borda, rrf = [keyword, near], lambda xs, n: M.borda(xs, None, n), lambda xs, n: M.rrf(xs, limit=n)
    make = lambda name, *a, **k: U.Pipeline(name, *a, **k)
    return U.Registry([
        make("keyword", [keyword]), make("_auto-keyword", [keyword]), make("vector", [near], rerankers=[mmr], needs=("vectors",)), make("unified", [mixed], rerankers=[mmr], needs=("vectors",)),
        make("hybrid", both, borda, rerankers=[mmr], needs=("vectors",)), make("hybrid-rrf", both, rrf, rerankers=[mmr], needs=("vectors",)), make("_auto-hybrid-rrf", both, rrf, rerankers=[mmr], needs=("vectors",)),
        make("hybrid-reranked", both, borda, rerankers=[ce, mmr], needs=("vectors", "cross-encoder")), make("_auto-hybrid-rrf-reranked", both, rrf, rerankers=[ce, mmr], needs=("vectors", "cross-encoder")),
        make("hybrid-ce-merge", both, lambda xs, n: M.cross_encoded(xs, texts, asked, P.overlap_score(), n), rerankers=[mmr], needs=("vectors", "cross-encoder")),
        make("hybrid-diverse", both, borda, premerge=[kinds], rerankers=[mmr], oversample=3, needs=("vectors",)), make("hybrid-reranked-diverse", both, borda, premerge=[kinds], rerankers=[ce, mmr], oversample=3, needs=("vectors", "cross-encoder")),
    ], ("vectors", "cross-encoder"), {"auto": AUTO})


def u6_pipeline_hybrid_diverse(spark, sf_dir):
    return registry(spark, sf_dir).get("hybrid-diverse").run(R.batch(spark, QUERIES), 10)


def u6_pipeline_hybrid_rrf(spark, sf_dir):
    return registry(spark, sf_dir).get("hybrid-rrf").run(R.batch(spark, QUERIES), 10)


def u8_pipeline_unified(spark, sf_dir):
    return registry(spark, sf_dir).get("unified").run(R.batch(spark, QUERIES), 10)


def u9_auto(spark, sf_dir):
    return registry(spark, sf_dir).get("auto").run(R.batch(spark, QUERIES), 10)


def u10_pipelines(spark, sf_dir):
    return registry(spark, sf_dir).describe(spark)


def u12_projects(spark, sf_dir):
    return U.resolved_projects(documents(spark, sf_dir), projects=["src1", "src2", "nope"])


def p1_filtered(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.where("project = 'src1' AND doc_type = 'method'").where(X.scope(F.col("file_path")) == "prod").select("doc_id")


def p2_first_project(spark, sf_dir):
    d = documents(spark, sf_dir).select((F.col("doc_id") % 30).alias("doc_id"), "project", "name")
    return U.first_by_project(d.groupBy("doc_id", "project").agg(F.min("name").alias("name")), ["src3", "src1"])


def p3_bulk_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    return L.by_ids(documents(spark, sf_dir), ids).select("doc_id", "name")


def p4_prefix_lookup(spark, sf_dir):
    return L.by_prefix(documents(spark, sf_dir).select("name").distinct(), "name", "The ", 50)


def p6_did_you_mean(spark, sf_dir):
    return L.did_you_mean(documents(spark, sf_dir), R.batch(spark, [(1, "Thb adn"), (2, "C11#x"), (3, "Anaea.y"), (4, "zz")]))


def p7_token_hits(spark, sf_dir):
    return L.token_hits(documents(spark, sf_dir), R.batch(spark, [*QUERIES, (9, "zzzqqq license")]), ("name", "body"))


def p8_filter_note(spark, sf_dir):
    d = documents(spark, sf_dir)
    hits = R.bm25(d, R.batch(spark, QUERIES), 50).join(d.select("doc_id", "doc_type"), "doc_id")
    return L.filter_note(hits, F.col("doc_type") == "class")


def p9_hints(spark, sf_dir):
    rows = [U.parse_hints(t, ["Lucene", "solr"]) for t in ("lucene: fast merge in:java", "python parser", "solr cloud", "no: hint", "in:rust")]
    return spark.createDataFrame([(h.text, h.project, h.project_explicit, h.language, h.language_explicit) for h in rows], "text string, project string, project_explicit boolean, language string, language_explicit boolean")


def p11_public_paths(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.where(F.col("file_path").startswith("src/") & (F.size(F.split("file_path", "/")) <= 5)).groupBy("file_path").agg(F.count("*").alias("n"))


def _lines(spark, sf_dir):
    d = documents(spark, sf_dir)
    hits = R.bm25(d, R.batch(spark, QUERIES), 20).join(d.select("doc_id", "body"), "doc_id")
    terms = R.query_terms(R.batch(spark, QUERIES)).select("query_id", "term", F.length("term").alias("w"))
    return hits, L.best_line(hits, terms)


def n1_best_line(spark, sf_dir):
    return _lines(spark, sf_dir)[1]


def n2_best_chunk(spark, sf_dir):
    """The chunk of each document that is nearest to the query, as a range of ids."""
    v, q = vectors(spark, sf_dir), vectors(spark, sf_dir).where("doc_id = 0").select(F.col("vec").alias("qv"))
    rows = v.join(F.broadcast(q), F.size("vec") == F.size("qv")).select((F.expr("doc_id div 10")).alias("doc"), F.col("doc_id").alias("chunk"), F.round(R.cosine(F.col("vec"), F.col("qv")), 6).alias("s"))  # one query
    return rows.groupBy("doc").agg(F.max_by("chunk", F.struct("s", -F.col("chunk"))).alias("chunk"), F.max("s").alias("score"))


def n3_snippets(spark, sf_dir):
    hits, lines = _lines(spark, sf_dir)
    rows = hits.join(lines, ["query_id", "doc_id"], "left")
    return rows.select("query_id", "doc_id", F.sha2(L.snippet(F.col("body"), F.col("line"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 7).cast("int")), F.lit(5)), 256).alias("snippet"))


def s29_line_range(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", L.line_range(F.col("body"), F.lit(2), F.lit(4)).alias("lines"))


def p5_class_lookup(spark, sf_dir):
    return documents(spark, sf_dir).where("doc_type = 'class' AND class_name = 'C8'").select("doc_id", "class_name", "file_path")


def p10_constructors(spark, sf_dir):
    """A class's members parted into constructors and public methods; every tenth row stands for a constructor."""
    d = documents(spark, sf_dir).withColumn("member", F.when(F.col("doc_id") % 10 == 0, "<init>").otherwise(F.col("name")))
    part = F.when(F.col("member") == "<init>", "constructor").when(F.col("access") == "public", "public")
    return d.select("class_name", part.alias("part")).where("part IS NOT NULL").groupBy("class_name", "part").agg(F.count("*").alias("n"))


def p12_advice(spark, sf_dir):
    """Suggestions for the queries of a batch that find nothing, and only for those."""
    d, q = documents(spark, sf_dir), R.batch(spark, [*QUERIES[:2], (8, "Thb zzqq"), (9, "C11x")])
    empty = q.join(R.bm25(d, q, 1).select("query_id"), "query_id", "left_anti")
    return L.did_you_mean(d, empty)


def r26_oversample(spark, sf_dir):
    rows = [(k, t, U.oversample(k, t)) for k in ("KEYWORD", "HYBRID", "VECTOR") for t in ("merge lists", "HashMap merge")]
    return spark.createDataFrame(rows, "type string, text string, factor int")


def m1_embeddings(spark, sf_dir):
    """The stand-in embedder over the first lines: all vectors have unit length, but those without a word."""
    from codequery.operators.index import hashing_embedder

    v = documents(spark, sf_dir).select("doc_id", hashing_embedder(F.col("javadoc"), 8).alias("vec"))
    return v.select("doc_id", F.size("vec").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def m5_pair_scores(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.col("javadoc").alias("passage")).withColumn("query", F.lit(QUERIES[0][1]))
    return d.select("doc_id", F.round(P.overlap_score(), 6).alias("score"))


#: The kinds of documents, as the pipelines part them.
KIND = "coalesce(doc_type, 'unknown')"
_RRF = "SELECT query_id, doc_id, sum(1::DOUBLE / (60 + rank)) * CASE WHEN count(DISTINCT list) = 2 THEN 1.5::DOUBLE ELSE 1.0 END AS score FROM (SELECT 0 AS list, * FROM kw UNION ALL SELECT 1, * FROM kv) GROUP BY query_id, doc_id"


def _lists(limit: int, words: str = "kw", vectors: str = "kv") -> str:
    """The two lists of the fixed queries; the vector of a query is that of its number."""
    return P._bm25(limit, name=words) + ", " + P._knn((1, 2, 3, 4), limit, vectors)


def _diverse(source: str, name: str, key: str) -> str:
    return f"{name} AS (SELECT query_id, doc_id, score * pow(0.5::DOUBLE, row_number() OVER (PARTITION BY query_id, {key} ORDER BY score DESC, doc_id) - 1) AS score FROM {source} JOIN docs USING (doc_id))"


N5_SQL = """
WITH m AS (SELECT DISTINCT p_brand AS class, string_split(p_name, ' ')[1] || upper(string_split(p_name, ' ')[-1][1]) || lower(string_split(p_name, ' ')[-1][2:]) AS name FROM part),
w AS (SELECT class, name, lower(regexp_extract(name, '^.[^A-Z]*', 0)) AS word FROM m),
g AS (SELECT class, name, CASE WHEN count(*) OVER (PARTITION BY class, word) >= 2 THEN word ELSE '(header)' END AS part FROM w)
SELECT class, part, sha256(string_agg(name, ',' ORDER BY name)) AS names FROM g GROUP BY class, part"""

#: Windows of five lines: the middle of two near hints, two windows for far ones; w = 5, so that a third is 3.
SNIPPET_SQL = """,
h AS (SELECT k.query_id, k.doc_id, string_split(body, chr(10)) AS ls, line AS kl, CASE WHEN k.doc_id % 2 = 0 THEN (k.doc_id % 7)::INTEGER END AS vl FROM kw k JOIN docs USING (doc_id) LEFT JOIN best b ON b.query_id = k.query_id AND b.doc_id = k.doc_id),
c AS (SELECT *, len(ls) AS n, greatest(0, least(len(ls) - 1, kl)) AS k, greatest(0, least(len(ls) - 1, vl)) AS v FROM h),
a AS (SELECT *, CASE WHEN kl IS NULL THEN v WHEN vl IS NULL THEN k WHEN abs(k - v) <= 2 THEN (k + v) // 2 END AS mid, greatest(0, v - 3) AS vf FROM c),
t AS (SELECT *, least(n, vf + 6) AS vt FROM a)
SELECT query_id, doc_id, sha256(CASE
  WHEN kl IS NULL AND vl IS NULL THEN array_to_string(ls[1:5], chr(10))
  WHEN mid IS NOT NULL THEN array_to_string(ls[greatest(0, least(mid - 2, n - 5)) + 1:greatest(0, least(mid - 2, n - 5)) + 5], chr(10))
  WHEN k > v THEN array_to_string(ls[vf + 1:vt], chr(10)) || chr(10) || '// ...' || chr(10) || array_to_string(ls[greatest(vt, k - 1) + 1:greatest(vt, k - 1) + 6], chr(10))
  ELSE array_to_string(ls[greatest(0, k - 1) + 1:greatest(0, k - 1) + greatest(0, least(6, vf - greatest(0, k - 1)))], chr(10)) || chr(10) || '// ...' || chr(10) || array_to_string(ls[vf + 1:vt], chr(10))
END) AS snippet FROM t"""


def oracle_sql() -> dict[str, str]:
    v = lambda rows: ", ".join("('" + x.replace("'", "''") + "')" for x in rows)
    names = f"(SELECT * FROM (VALUES {_values(NAMES)}) v(id, x))"
    asks = f"q AS (SELECT * FROM (VALUES {_values(ASKS)}) v(query_id, text))"
    scope = "CASE {c} WHEN regexp_matches(file_path, '\\.(md|txt|yml|adoc|yaml|sh|xml)$') THEN 'docs' WHEN contains(file_path, '/src/test/') OR contains(file_path, '/test/') OR contains(file_path, '/benchmark/') OR contains(file_path, '/jmh/') THEN 'test' ELSE 'prod' END"
    scope_of = lambda c: scope.replace("{c}", c)
    phrases = "ph AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{i}')" for p, i in U.INTENT_PHRASES) + ") v(phrase, intent))"
    grams = "w AS (SELECT query_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9#@]+', ' ', 'g')), ' ') AS w FROM q), s AS (SELECT query_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (SELECT query_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM s, (VALUES (1), (2), (3), (4)) v(n)), tag AS (SELECT query_id, arg_min(intent, i * 10 - n) AS intent FROM g JOIN ph USING (phrase) GROUP BY query_id)"
    words = "regexp_split_to_array(trim(text), '\\s+')"
    any_ = lambda c: f"len(list_filter({words}, lambda w: {c})) > 0"
    code = any_("regexp_matches(w, '^[A-Z][a-z]+[A-Z].*$') OR regexp_matches(w, '^.*[a-z][A-Z].*$') OR regexp_matches(w, '^[A-Z0-9]{3,}$')")
    syntax = "(" + " OR ".join(f"contains(lower(text), '{x}')" for x in ("throws ", "implements ", "extends ", "@override", "@deprecated")) + ")"
    stop = lambda ws: any_(f"lower(w) IN ({', '.join(repr(x) for x in ws)})")
    caps = f"(len({words}) <= 3 AND len(list_filter({words}, lambda w: NOT regexp_matches(w, '[A-Z]'))) = 0)"
    first = lambda h, k: f"WHEN trim(text) = '' THEN {h} WHEN NOT contains(trim(text), ' ') OR contains(text, '#') OR starts_with(trim(text), '@') OR {syntax} OR {code} THEN {k}"
    h_type = "CASE " + first("'HYBRID'", "'KEYWORD'") + f" WHEN len({words}) >= 4 AND NOT {stop(U.STOP_WORDS)} THEN 'KEYWORD' WHEN len({words}) >= 4 THEN 'HYBRID' WHEN {caps} THEN 'KEYWORD' ELSE 'HYBRID' END"
    h_intent = "CASE " + first("NULL", "NULL") + f" WHEN len({words}) >= 4 AND NOT {stop(U.STOP_WORDS)} THEN 'KEYWORD_TECHNICAL' END"
    classes = "('" + "', '".join(U.CLASS_INTENTS) + "')"
    route = f"CASE WHEN intent = 'CONFIG' THEN 'HYBRID_RERANKED' WHEN intent IN {classes} OR intent = 'BEHAVIORAL' THEN 'HYBRID' ELSE 'KEYWORD' END"
    kind = f"CASE WHEN intent IN {classes} THEN 'class' END"
    embed = "concat_ws(chr(10), {})"
    part = lambda c, n: f"nullif(substr({c}, 1, {n}), '')"
    qs = _values(QUERIES)
    kw_best = P._bm25(20) + f""", l AS (SELECT query_id, doc_id, unnest(string_split(body, chr(10))) AS t, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line FROM kw JOIN docs USING (doc_id)),
lw AS (SELECT DISTINCT query_id, doc_id, line, unnest({sql_tokens('t')}) AS term FROM l), lh AS (SELECT query_id, doc_id, line, max(length(term)) AS w FROM lw JOIN terms USING (query_id, term) GROUP BY ALL), best AS (SELECT query_id, doc_id, arg_max(line, w * 1000000 - line)::INTEGER AS line FROM lh GROUP BY ALL)"""
    return {
        "f1_split_identifier": f"SELECT id, x, {_SPLIT} AS words FROM (SELECT id, x FROM {names} UNION ALL SELECT p_partkey::INTEGER, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') FROM part)",
        "f2_tokens": f"SELECT doc_id, len(t)::INTEGER AS n, len(list_distinct(t))::INTEGER AS n_distinct, list_max(t) AS last FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)",
        "f3_query_terms": f"WITH q AS (SELECT * FROM (VALUES {qs}) v(query_id, text)), qt AS (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS spot FROM (SELECT query_id, {sql_tokens('text')} AS ts FROM q)), t AS (SELECT query_id, term, min(spot) AS spot FROM (SELECT * FROM qt UNION ALL SELECT qt.query_id, unnest(string_split(rhs, ' ')) AS term, qt.spot FROM qt JOIN (VALUES {_values(P.SYNONYMS)}) s(lhs, rhs) ON lhs = qt.term) GROUP BY query_id, term) SELECT query_id, term, spot::INTEGER AS place, count(*) OVER (PARTITION BY query_id) AS n_terms FROM t",
        "f4_escaped": r"""SELECT page_id, regexp_replace(url, '([+\-!(){}\[\]^"~*?:\\/|&])', '\\\1', 'g') AS escaped FROM pages""",
        "f21_line_ranges": "WITH r AS (SELECT p_partkey, p_size, range(1, p_size % 4 + 1) AS k FROM part) SELECT p_partkey, printf('%08X', len(k)) || array_to_string(list_transform(k, lambda i: printf('%08X%08X', i * 10, i * 10 + p_size)), '') AS raw, array_to_string(list_transform(k, lambda i: (i * 10) || '-' || (i * 10 + p_size)), ',') AS ranges FROM r",
        "f27_refs_stamp": "SELECT c_mktsegment AS project, count(*) AS refs, sum(('0x' || substr(md5(c_name || chr(1) || (c_custkey % 10) || chr(1) || CASE WHEN c_custkey % 3 > 0 THEN 'T' ELSE '' END), 1, 12))::BIGINT)::VARCHAR AS stamp FROM customer GROUP BY c_mktsegment",
        "n5_class_chunks": N5_SQL,
        "p12_advice": P._bm25(1, [*QUERIES[:2], (8, "Thb zzqq"), (9, "C11x")]) + f", e AS (SELECT query_id, lower(regexp_extract(trim(text), '^([^\\s#.(]*)', 1)) AS probe FROM q ANTI JOIN kw USING (query_id)), n AS (SELECT DISTINCT name FROM (SELECT name FROM docs UNION ALL SELECT class_name FROM docs) WHERE name <> '') SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY levenshtein(lower(name), probe), name))::INTEGER AS rank, name, levenshtein(lower(name), probe)::INTEGER AS distance FROM n, e WHERE length(probe) >= 3 AND levenshtein(lower(name), probe) <= 2) WHERE rank <= 5",
        "n3_snippets": kw_best + SNIPPET_SQL,
        "u6_pipeline_hybrid_rrf": f"{_lists(10)}, s AS ({_RRF}), m AS ({P._ranked('s', 10)}), {_diverse('m', 'd', 'class_name')} " + P._ranked("d", 10),
        "u6_pipeline_hybrid_diverse": f"{_lists(30, 'kw0', 'kv0')}, {_diverse('kw0', 'd1', KIND)}, {_diverse('kv0', 'd2', KIND)}, kw AS ({P._ranked('d1', None)}), kv AS ({P._ranked('d2', None)}), l AS (SELECT 0 AS list, * FROM kw UNION ALL SELECT 1, * FROM kv), c AS (SELECT *, count(*) OVER (PARTITION BY query_id, list) AS n FROM l), s AS (SELECT query_id, doc_id, sum(0.5::DOUBLE * (n - rank + 1)) * CASE WHEN count(DISTINCT list) = 2 THEN 1.5::DOUBLE ELSE 1.0 END AS score FROM c GROUP BY ALL), m AS ({P._ranked('s', 10)}), {_diverse('m', 'd', 'class_name')} " + P._ranked("d", 10),
        "u8_pipeline_unified": f"{_lists(50)}, u AS (SELECT query_id, doc_id, CASE WHEN vs IS NULL THEN lift * 0.01 ELSE vs + lift END AS score FROM (SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.doc_id, v.doc_id) AS doc_id, v.score AS vs, 0.3::DOUBLE * (1 - 2 / (exp(2 * coalesce(k.score, 0) / 150.0::DOUBLE) + 1)) AS lift FROM kw k FULL JOIN kv v ON k.query_id = v.query_id AND k.doc_id = v.doc_id)), m AS ({P._ranked('u', 10)}), {_diverse('m', 'd', 'class_name')} " + P._ranked("d", 10),
        "u9_auto": f"{_lists(10)}, s AS ({_RRF}), m AS ({P._ranked('s', 10)}), {_diverse('m', 'd', 'class_name')}, h AS ({P._ranked('d', 10)}) SELECT * FROM h WHERE query_id IN (1, 2) UNION ALL SELECT * FROM kw WHERE query_id IN (3, 4) AND rank <= 10",
        "f5_identifier_like": f"SELECT x, contains(x, '_') OR regexp_matches(x, '^.+[A-Z]') AS yes FROM {names}",
        "f6_scope": f"WITH {DOCS} SELECT doc_id, {scope_of("WHEN doc_type = 'chunk' THEN 'docs'")} AS scope FROM docs",
        "f7_factors": f"WITH {DOCS} SELECT doc_id, {_PATH} AS path, {_KIND} AS kind, {_ACCESS} AS access, " + ", ".join(f"{_class_type(i)} AS {i.lower()}" for i in ("INTERFACE", "ENUM", "IMPLEMENTATION")) + " FROM docs",
        "f12_description": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'creates Part' ELSE lower(string_split(p_name, ' ')[1]) || ' total' END || ': given ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: lower(w) || ' id'), ', ') || CASE WHEN p_size % 5 <> 0 AND p_size % 2 = 0 THEN ' — returns list of Part' ELSE '' END || ' — calls ' || array_to_string(list_transform(string_split(p_type, ' '), lambda w: lower(w)), ', ') AS text FROM part",
        "f13_embedding_text": f"WITH {DOCS} SELECT doc_id, sha256(CASE doc_type WHEN 'class' THEN {embed.format(', '.join((part('name', 4000), part('signature', 4000), part('javadoc', 8000), part('body', 16000))))} WHEN 'chunk' THEN {embed.format(', '.join((part('signature', 4000), part('name', 4000), part('body', 20000))))} ELSE {embed.format(', '.join((part('name', 4000), part('signature', 4000), part('javadoc', 4000), part('body', 8000))))} END) AS digest FROM docs",
        "f14_passage": f"WITH {DOCS} SELECT doc_id, concat_ws(' ', nullif(name, ''), nullif(signature, ''), nullif(CASE WHEN javadoc <> '' THEN substr(javadoc, 1, 300) ELSE substr(body, 1, 300) END, '')) AS passage FROM docs",
        "f16_extension": "SELECT page_id, coalesce(nullif(lower(regexp_extract(regexp_replace(url, '[?#].*', '') || CASE WHEN page_id % 2 = 0 THEN '.HTML' ELSE '' END, '\\.([A-Za-z0-9]+)$', 1)), ''), 'other') AS extension FROM pages",
        "f17_levenshtein": "SELECT n_name, levenshtein(n_name, 'INDIANA')::INTEGER AS edits FROM nation",
        "f19_sha256": "SELECT doc_id, sha256(text) AS digest FROM documents",
        "f20_field_name": f"SELECT x, substr(regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 64) AS field FROM (VALUES {v(['BAAI/bge-small-en-v1.5', 'a..b', '--x--', 'm' * 80])}) t(x)",
        "f22_first_word": f"SELECT x, lower(regexp_extract(x, '^.[^A-Z]*', 0)) AS word FROM {names}",
        "f23_first_sentence": "SELECT doc_id, substr(trim(regexp_extract(text, '(?s)^(.*?)(?:\\.\\s|\\.$|$)', 1)), 1, 200) AS sentence FROM documents",
        "f24_normal_terms": f"WITH t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS t FROM documents), n AS (SELECT doc_id, regexp_replace(lower(t), '^[0-9]+|[0-9]+$', '', 'g') AS term FROM t) SELECT doc_id, count(*) AS n, count(DISTINCT term) AS n_distinct FROM n WHERE length(term) >= 3 AND term NOT IN ('the', 'and', 'with') GROUP BY doc_id",
        "f28_collision_probability": f"SELECT e.vec_id AS doc_id, round(pow(1 - acos(greatest(-1, least(1, {P._cos('e.embedding', 'q.embedding')}))) / pi(), 8), 6) AS p FROM embeddings e, embeddings q WHERE q.vec_id = 0",
        "s3_project_name": f"SELECT x, regexp_replace(x, '-\\d+(\\.\\d+)*$', '') AS name FROM (VALUES {v(['lucene-10.4.0', 'app-1', 'tool', 'a-b-2.x', 'x-1.2-3.4'])}) t(x)",
        "u1_intents": f"WITH {asks}, {phrases}, {grams} SELECT query_id, intent FROM q LEFT JOIN tag USING (query_id)",
        "u2_routes": f"WITH {phrases} SELECT DISTINCT intent, {route} AS type, {kind} AS doc_type FROM ph",
        "u3_heuristic": f"WITH {asks} SELECT query_id, {h_type} AS type, {h_intent} AS intent FROM q",
        "u4_default_classifier": f"WITH {asks} SELECT query_id, CASE {first("'HYBRID'", "'KEYWORD'")} WHEN {stop(U.DEFAULT_STOP_WORDS)} THEN 'HYBRID' WHEN {caps} THEN 'KEYWORD' ELSE 'HYBRID' END AS type FROM q",
        "u5_classified": f"WITH {asks}, {phrases}, {grams} SELECT query_id, CASE WHEN intent IS NOT NULL THEN {route} ELSE {h_type} END AS type, coalesce(intent, {h_intent}) AS intent, {kind} AS doc_type FROM q LEFT JOIN tag USING (query_id)",
        "u12_projects": "SELECT DISTINCT source AS project FROM documents WHERE source IN ('src1', 'src2', 'nope')",
        "p1_filtered": f"WITH {DOCS} SELECT doc_id FROM docs WHERE project = 'src1' AND doc_type = 'method' AND ({scope_of('')}) = 'prod'",
        "p2_first_project": f"WITH {DOCS}, d AS (SELECT doc_id % 30 AS doc_id, project, min(name) AS name FROM docs GROUP BY ALL) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE project WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 99 END, project) = 1",
        "p3_bulk_lookup": f"WITH {DOCS} SELECT doc_id, name FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "p4_prefix_lookup": f"WITH {DOCS} SELECT DISTINCT name FROM docs WHERE starts_with(name, 'The ') ORDER BY name LIMIT 50",
        "p5_class_lookup": f"WITH {DOCS} SELECT doc_id, class_name, file_path FROM docs WHERE doc_type = 'class' AND class_name = 'C8'",
        "p10_constructors": f"WITH {DOCS}, m AS (SELECT class_name, CASE WHEN doc_id % 10 = 0 OR name = '<init>' THEN 'constructor' WHEN access = 'public' THEN 'public' END AS part FROM docs) SELECT class_name, part, count(*) AS n FROM m WHERE part IS NOT NULL GROUP BY ALL",
        "m1_embeddings": f"WITH {DOCS} SELECT doc_id, 8::INTEGER AS dims, CASE WHEN len({sql_tokens('javadoc')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM docs",
        "m5_pair_scores": f"WITH {DOCS} SELECT doc_id, round(len(list_intersect({sql_tokens(chr(39) + QUERIES[0][1] + chr(39))}, list_distinct({sql_tokens('javadoc')})))::DOUBLE / 3, 6) AS score FROM docs",
        "p6_did_you_mean": f"WITH {DOCS}, q AS (SELECT query_id, lower(regexp_extract(trim(text), '^([^\\s#.(]*)', 1)) AS probe FROM (VALUES (1, 'Thb adn'), (2, 'C11#x'), (3, 'Anaea.y'), (4, 'zz')) v(query_id, text)), n AS (SELECT DISTINCT name FROM (SELECT name FROM docs UNION ALL SELECT class_name FROM docs) WHERE name <> '') SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY levenshtein(lower(name), probe), name))::INTEGER AS rank, name, levenshtein(lower(name), probe)::INTEGER AS distance FROM n, q WHERE length(probe) >= 3 AND levenshtein(lower(name), probe) <= 2) WHERE rank <= 5",
        "p7_token_hits": f"WITH {DOCS}, q AS (SELECT query_id, {sql_tokens('text')} AS t FROM (VALUES {_values([*QUERIES, (9, 'zzzqqq license')])}) v(query_id, text)), w AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest(t) AS token FROM q WHERE len(t) > 1) WHERE length(token) >= 3), k AS (SELECT DISTINCT unnest({sql_tokens('name')} || {sql_tokens('body')}) AS token FROM docs) SELECT query_id, token, k.token IS NOT NULL AS found FROM w LEFT JOIN k USING (token)",
        "p8_filter_note": P._bm25(50) + " SELECT query_id, count(*) AS without, sum((doc_type = 'class')::INTEGER)::BIGINT AS with_filter FROM kw JOIN docs USING (doc_id) GROUP BY query_id",
        "p11_public_paths": f"WITH {DOCS} SELECT file_path, count(*) AS n FROM docs WHERE starts_with(file_path, 'src/') AND len(string_split(file_path, '/')) <= 5 GROUP BY file_path",
        "n1_best_line": kw_best + " SELECT * FROM best",
        "n2_best_chunk": f"WITH s AS (SELECT e.vec_id // 10 AS doc, e.vec_id AS chunk, round({P._cos('e.embedding', 'q.embedding')}, 6) AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0) SELECT doc, arg_max(chunk, s * 1000000000 - chunk) AS chunk, max(s) AS score FROM s GROUP BY doc",
        "s29_line_range": "SELECT doc_id, array_to_string(string_split(coalesce(text, ''), chr(10))[2:4], chr(10)) AS lines FROM documents",
    }


def queries():
    return {n: f for n, f in globals().items() if n[0] in "fsupnrm" and n[1:2].isdigit() and callable(f)}
