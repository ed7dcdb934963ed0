"""Queries of mining, evaluation and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequery.functions import text as X
from codequery.operators import evaluation as E
from codequery.operators import mining as M
from codequery.operators import retrieval as R
from codequery.plans import retrieval as P
from codequery.plans.views import DOCS, EDGES, QUERIES, documents, part_edges, sql_tokens, table


def a1_characteristic_terms(spark, sf_dir):
    d = documents(spark, sf_dir)
    return M.characteristic(d, R.bm25(d, R.batch(spark, QUERIES[:2]), 20), ("javadoc", "body"))


def a2_background(spark, sf_dir):
    return M.background(M.terms_of(documents(spark, sf_dir), ("name", "javadoc", "signature"))).where("df >= 2")


def a3_name_grams(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.replace(F.initcap("p_type"), F.lit(" "), F.lit("")).alias("class")).distinct()
    return M.name_grams(parts)


ACRONYMS = ["a finite state machine (FST) here", "Weak AND is WAN (weak and null) too", "the call graph index (CGI) and more", "hierarchical navigable small world (HNSW)", "not matching words (XYZ)", "see BFS (breadth first search)"]


def a4_acronyms(spark, sf_dir):
    return M.acronyms(spark.createDataFrame([(t,) for t in ACRONYMS], "text string"), "text")


def _class_comments(spark, sf_dir):
    """Documents as classes, called by two of their words, their first lines as comments that link to others."""
    d = documents(spark, sf_dir)
    words = F.filter(X.tokens(F.col("javadoc")), lambda t: F.rlike(t, F.lit("^[a-z]+$")))
    name = lambda k: F.concat(F.initcap(F.coalesce(F.get(words, F.lit(k)), F.lit("x"))), F.initcap(F.coalesce(F.get(words, F.lit(k + 1)), F.lit("y"))))
    return d.select("doc_id", name(0).alias("class"), F.concat("javadoc", F.lit(" {@link "), name(0), F.lit("} {@link a.b."), name(2), F.lit("#go}")).alias("comment"))


_CLASS_COMMENTS = f"""cw AS (SELECT doc_id, javadoc, list_filter({sql_tokens('javadoc')}, lambda t: regexp_matches(t, '^[a-z]+$')) AS w FROM docs),
cn AS (SELECT doc_id, javadoc, list_transform([coalesce(w[1], 'x'), coalesce(w[2], 'y'), coalesce(w[3], 'x'), coalesce(w[4], 'y')], lambda x: upper(x[1]) || x[2:]) AS p FROM cw),
cc AS (SELECT doc_id, p[1] || p[2] AS class, p[3] || p[4] AS other, javadoc FROM cn)"""


def a4_initialisms(spark, sf_dir):
    """Classes with a part of consonants, and texts whose words it abbreviates."""
    rows = [("FSTReader", "A finite state transducer reads fast. Finite state tables too."), ("KNNQuery", "k nearest neighbours of k near nodes"), ("HNSWGraph", "no such words"), ("IndexWriter", "it writes")]
    return M.initialisms(spark.createDataFrame(rows, "class string, javadoc string"), "javadoc")


def a4_expansion_grams(spark, sf_dir):
    rows = [("finite state transducer", "FST"), ("k nearest neighbours", "KNN"), ("call graph of the index", "CGI"), ("merge-policy", "MP"), ("one", "O")]
    return M.expansion_grams(spark.createDataFrame(rows, "phrase string, class string"))


def a11_link_graph(spark, sf_dir):
    return M.link_graph(_class_comments(spark, sf_dir))


def a11_package_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("org."), F.regexp_replace("p_type", " ", "."), F.lit(".Part")).alias("fqn"), F.col("p_brand").alias("class"))
    return M.package_paths(p)


def a11_context_windows(spark, sf_dir):
    names = spark.createDataFrame([("license", "License"), ("apache", "ApacheLicense"), ("version", "Version")], "token string, class string")
    return M.context_windows(documents(spark, sf_dir), names, "body")


def a5_bigrams(spark, sf_dir):
    return M.bigrams(documents(spark, sf_dir), "project", "javadoc", 10)


def a6_class_terms(spark, sf_dir):
    """Characteristic terms of each class, shared by three classes at most."""
    d = documents(spark, sf_dir)
    order = d.select((F.col("doc_id") % 50).cast("int").alias("query_id"), "doc_id", F.row_number().over(E.Window.partitionBy(F.col("doc_id") % 50).orderBy("doc_id")).alias("rank"))
    found = M.characteristic(d, order, ("javadoc",), top=5).select(F.col("term").alias("lhs"), F.concat(F.lit("C"), F.col("query_id").cast("string")).alias("rhs"), F.col("fg").alias("n"))
    return M.limited_fan_out(found, 3, 2)


def _rules(spark, sf_dir):
    b = a5_bigrams(spark, sf_dir).select(F.col("bigram").alias("lhs"), F.col("key").alias("rhs"))
    g = a3_name_grams(spark, sf_dir).select(F.col("gram").alias("lhs"), F.col("class").alias("rhs"))
    return b, g


def a7_combined_rules(spark, sf_dir):
    b, g = _rules(spark, sf_dir)
    return M.combined([(0, g), (1, b), (2, g.where("length(lhs) > 8"))])


def k20_appended_rules(spark, sf_dir):
    b, g = _rules(spark, sf_dir)
    return M.appended(b, g.unionByName(b))


def a8_redundant_rules(spark, sf_dir):
    """Of two triggers' rules those whose target the search does not give already."""
    d = documents(spark, sf_dir)
    hits = R.bm25(d, R.batch(spark, [(1, "anea"), (2, "license")]), 5)
    names = spark.createDataFrame([(1, "anea"), (2, "license")], "query_id int, lhs string")
    best = hits.join(names, "query_id").select("lhs", F.col("doc_id").alias("target"))
    rules = d.select(F.when(F.col("doc_id") % 2 == 0, "anea").otherwise("license").alias("lhs"), F.col("doc_id").alias("rhs"))
    return M.redundant(rules, best)


def a9_tf_idf(spark, sf_dir):
    return M.tf_idf(documents(spark, sf_dir), "lang", "javadoc", 5)


def a10_co_callers(spark, sf_dir):
    return M.co_callers(part_edges(spark, sf_dir), 0.05)


def a11_npmi(spark, sf_dir):
    """Which event types follow which, by user."""
    e = table(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(E.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select(F.col("user_id").alias("item"), F.col("event_type").alias("a"), nxt.alias("b")).where("b IS NOT NULL")
    return M.npmi(rows)


def a12_languages(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.groupBy(X.extension(F.col("file_path")).alias("extension")).agg(F.count("*").alias("n"))


def a13_skeleton(spark, sf_dir):
    """Signatures of public and protected rows by class, the first ten."""
    d = documents(spark, sf_dir).where(F.col("access").isin("public", "protected"))
    top = E.nth_best(d, F.col("class_name"), [F.col("doc_id")], 10)
    return top.groupBy("class_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "name"))), lambda x: x["name"]), "; ").alias("members"), F.count("*").alias("n"))


def a14_project_stats(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.groupBy("project").agg(F.count("*").alias("docs"), F.countDistinct("class_name").alias("classes"), F.sum(F.length("body").cast("long")).alias("chars"), F.countDistinct("lang").alias("languages"))


def a15_recount(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("doc_type").agg(F.count("*").alias("n"))


def _qrels(spark, sf_dir):
    """Labels as grades of every query: quality one, non-toxic quality two."""
    lab = table(spark, sf_dir, "labels")
    grade = F.when((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("doc_id") % 3 == 0), 2).when(F.col("quality") == 1, 1).otherwise(0)
    each = F.explode(F.array(*(F.lit(i) for i, _ in QUERIES)))
    return lab.select(each.alias("query_id"), "doc_id", grade.alias("grade"), F.lit(None).cast("string").alias("class_name"))


def a16_metrics(spark, sf_dir):
    d, q = documents(spark, sf_dir), _qrels(spark, sf_dir)
    return E.metrics(E.graded(R.bm25(d, R.batch(spark, QUERIES), 20), q), q)


def a17_class_grades(spark, sf_dir):
    d, q = documents(spark, sf_dir), _qrels(spark, sf_dir)
    by_class = spark.createDataFrame([(i, None, 1, f"C{k}") for i, _ in QUERIES for k in range(0, 50, 7)], "query_id int, doc_id long, grade int, class_name string")
    run = R.bm25(d, R.batch(spark, QUERIES), 20)
    return E.graded(run, q.where("doc_id % 2 = 0").unionByName(by_class.select(q.columns)), d).select("query_id", "rank", "doc_id", "grade")


def _bench(spark, sf_dir):
    """Forty benchmark queries whose truth is the document of ten times their number; ids by digits."""
    d = documents(spark, sf_dir)
    run = R.bm25(d, R.batch(spark, QUERIES), 20).select("query_id", "rank", F.col("doc_id").cast("string").alias("result_id"))
    truth = spark.createDataFrame([(1, "12", "A", "p1"), (2, "3", "B", "p1"), (3, "9", "A", "p2"), (4, "77", "B", "p2")], "query_id int, truth_id string, category string, project string")
    return run, truth


def a18_benchmark(spark, sf_dir):
    run, truth = _bench(spark, sf_dir)
    return E.benchmark(E.hit_ranks(run, truth), truth)


def a18_regressions(spark, sf_dir):
    run, truth = _bench(spark, sf_dir)
    return E.regressions(E.hit_ranks(run, truth), E.hit_ranks(run.where("rank > 3"), truth))


def a19_golden_set(spark, sf_dir):
    """Events as ratings: the share of purchases among each user type's last events."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("query"), (F.col("user_id") % 50).alias("result_id"), F.col("ts"), (F.col("event_type") == "purchase").cast("int").alias("rating"))
    last = E.last_ratings(e, ["query", "result_id"])
    return last.groupBy("query").agg(F.count("*").alias("n"), F.sum("rating").alias("good"))


def s31_last_ratings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("rating"))
    return E.last_ratings(e, ["user_id", "event_type"]).select("user_id", "event_type", "rating")


def a20_weight_grid(spark, sf_dir):
    truth = spark.createDataFrame([(1, 25), (1, 7), (7, 7), (7, 3)], "query_id int, doc_id long")
    return E.weight_grid(list(P._both(spark, sf_dir)), truth)


def a21_synonym_ablation(spark, sf_dir):
    """MRR with and without synonyms."""
    d, q = documents(spark, sf_dir), _qrels(spark, sf_dir)
    plain, more = P.r2_bm25(spark, sf_dir), P.r7_synonyms(spark, sf_dir).where("rank <= 10")
    one = lambda run, name: E.metrics(E.graded(run, q), q).agg(F.lit(name).alias("variant"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
    return one(plain, "none").unionByName(one(more, "synonyms"))


def a22_boost_ablation(spark, sf_dir):
    q = _qrels(spark, sf_dir)
    one = lambda run, name: E.metrics(E.graded(run, q), q).agg(F.lit(name).alias("variant"), F.round(F.avg("mrr"), 6).alias("mrr"))
    d = documents(spark, sf_dir)
    base = R.bm25(d, R.batch(spark, QUERIES), 10)
    return one(base, "base").unionByName(one(R.ranked(R.multiplied(base, d)), "multiplied"))


def a23_percentiles(spark, sf_dir):
    return E.nearest_rank(table(spark, sf_dir, "events"), "value", ["event_type"])


def oracle_sql() -> dict[str, str]:
    stop = "[" + ", ".join(f"'{w}'" for w in M.STOP_WORDS) + "]"
    terms = lambda source, fields: "terms AS (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, unnest(list_distinct(list_filter({sql_tokens(f)}, lambda t: length(t) >= 3 AND NOT contains(t, '.') AND NOT list_contains({stop}, t)))) AS term FROM {source}" for f in fields) + ")"
    wormhole = lambda top, run, extra="": (
        f", run AS ({run}), ahead AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM run), hits AS (SELECT DISTINCT query_id, doc_id, term, rank, n FROM terms JOIN ahead USING (doc_id)), "
        "f AS (SELECT query_id, term, count(*) AS fg, max(n) AS n, sum(CASE WHEN rank <= 5 THEN 1 / sqrt(rank::DOUBLE) ELSE 0 END) AS pos FROM hits GROUP BY ALL), bg AS (SELECT term, max(c) AS df FROM (SELECT field, term, count(*) AS c FROM terms GROUP BY ALL) GROUP BY term), "
        "s AS (SELECT *, greatest(0, ln((fg::DOUBLE / n) / (greatest(df, 1)::DOUBLE / (SELECT count(*) FROM docs)))) AS stat FROM f JOIN bg USING (term)), "
        "t AS (SELECT *, round(0.4::DOUBLE * coalesce(stat / nullif(max(stat) OVER (PARTITION BY query_id), 0), 0) + 0.6::DOUBLE * coalesce(pos / nullif(max(pos) OVER (PARTITION BY query_id), 0), 0), 6) AS score FROM s), "
        f"worm AS (SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term))::INTEGER AS rank, term, score, fg, df AS bg FROM t) WHERE rank <= {top})"
    )
    kw20 = P._bm25(20, QUERIES[:2])
    content = lambda w: f"(length({w}) >= 3 AND NOT list_contains({stop}, {w}))"
    bigram = f"""bt AS (SELECT project AS key, {sql_tokens('javadoc')} AS t FROM docs), bp AS (SELECT key, unnest(list_zip(t[:-2], t[2:])) AS p FROM bt WHERE len(t) >= 2), bx AS (SELECT key, p[1] AS a, p[2] AS b FROM bp),
btf AS (SELECT key, a || b AS bigram, count(*) AS tf FROM bx WHERE length(a) >= 2 AND length(b) >= 2 AND length(a) + length(b) >= 4 AND ({content('a')} OR {content('b')}) GROUP BY ALL), bdf AS (SELECT bigram, count(*) AS df FROM btf GROUP BY bigram), bl AS (SELECT key, sum(tf) AS len FROM btf GROUP BY key),
bs AS (SELECT key, bigram, round(ln((tf::DOUBLE / len) / (df::DOUBLE / (SELECT count(*) FROM bl))), 6) AS ppmi FROM btf JOIN bdf USING (bigram) JOIN bl USING (key)),
bigrams AS (SELECT key, bigram, ppmi FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ppmi DESC, bigram) AS k, count(*) OVER (PARTITION BY key) AS m FROM bs WHERE ppmi > 0) WHERE k <= greatest(1, ceil(m * 10.0::DOUBLE / 100)))"""
    cap = "(SELECT DISTINCT array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS class FROM part)"
    split = P._SPLIT.replace("lower(regexp_replace(regexp_replace(regexp_replace(x,", "lower(regexp_replace(regexp_replace(regexp_replace(class,")
    grams = f"nw AS (SELECT class, string_split({split}, ' ') AS w FROM {cap}), ng AS (SELECT class, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM nw, (VALUES (1), (2), (3)) v(n)), grams AS (SELECT DISTINCT array_to_string(w[i : i + n - 1], '') AS gram, class FROM ng WHERE length(array_to_string(w[i : i + n - 1], '')) >= CASE n WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 6 END)"
    rules = f"WITH {DOCS}, {bigram}, {grams}, b AS (SELECT bigram AS lhs, key AS rhs FROM bigrams), g AS (SELECT gram AS lhs, class AS rhs FROM grams)"
    qrels = "qrels AS (SELECT query_id, doc_id, CASE WHEN quality = 1 AND toxic = 0 AND doc_id % 3 = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS grade FROM labels, (VALUES (1), (2), (3), (4)) v(query_id))"
    met = lambda run, name="met": f"""{name} AS (WITH gr AS (SELECT r.query_id, rank, coalesce(grade, 0) AS grade FROM {run} r LEFT JOIN qrels q ON r.query_id = q.query_id AND r.doc_id = q.doc_id WHERE rank <= 10), h AS (SELECT *, sum((grade > 0)::INTEGER) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM gr),
  got AS (SELECT query_id, min(rank) FILTER (WHERE grade > 0) AS first, sum((grade > 0)::INTEGER) AS n, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg, sum(hits::DOUBLE / rank) FILTER (WHERE grade > 0) AS ps FROM h GROUP BY query_id),
  ide AS (SELECT query_id, count(*) AS relevant, sum((pow(2, grade) - 1) / log2(i + 1)) FILTER (WHERE i <= 10) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS i FROM qrels WHERE grade > 0) GROUP BY query_id)
  SELECT query_id, round(coalesce(1::DOUBLE / first, 0), 6) AS mrr, round(n::DOUBLE / 10, 6) AS p, round(CASE WHEN relevant IS NULL THEN 1 ELSE n::DOUBLE / relevant END, 6) AS r, round(CASE WHEN relevant IS NULL THEN 0 ELSE dcg / idcg END, 6) AS ndcg, round(CASE WHEN relevant IS NULL THEN 0 ELSE coalesce(ps, 0) / relevant END, 6) AS ap FROM got LEFT JOIN ide USING (query_id))"""  # noqa: E731
    truth = "truth AS (SELECT * FROM (VALUES (1, '12', 'A', 'p1'), (2, '3', 'B', 'p1'), (3, '9', 'A', 'p2'), (4, '77', 'B', 'p2')) v(query_id, truth_id, category, project))"
    hits = lambda where, name: f"{name} AS (SELECT t.query_id, min(rank) AS hit FROM truth t LEFT JOIN (SELECT * FROM kw WHERE {where}) k ON k.query_id = t.query_id AND (starts_with(doc_id::VARCHAR, truth_id) OR starts_with(truth_id, doc_id::VARCHAR)) GROUP BY t.query_id)"
    at = ", ".join(f"round(avg((coalesce(hit, 99) <= {k})::INTEGER), 6) AS p{k}" for k in (1, 3, 5, 10))
    class_rules = ", ".join(f"(C, 'C{k}')" for k in range(0, 50, 7)).replace("(C, ", "(")
    syn_terms = f"SELECT query_id, term, min(spot) AS spot FROM (SELECT * FROM qt UNION ALL SELECT qt.query_id, unnest(string_split(rhs, ' ')) AS term, qt.spot FROM qt JOIN (VALUES {P._values(P.SYNONYMS)}) s(lhs, rhs) ON lhs = qt.term) GROUP BY query_id, term"
    syn_sql = P._match_ctes(fields=("body",), mixed=False, boosts={"body": 1.0}, terms=syn_terms)
    syn_run = f"(SELECT * FROM ({syn_sql} {P._ranked('disj', 10)}))"
    grid = "SELECT step, query_id, doc_id, round(sum((CASE WHEN list = 0 THEN step::DOUBLE / 10 ELSE 1 - step::DOUBLE / 10 END) * (n - rank + 1)) * CASE WHEN count(DISTINCT list) = 2 THEN 1.5::DOUBLE ELSE 1 END, 6) AS score FROM c, (SELECT unnest(range(0, 11))::INTEGER AS step) GROUP BY step, query_id, doc_id"
    return {
        "a1_characteristic_terms": f"{kw20}, {terms('docs', ('javadoc', 'body'))}{wormhole(10, 'SELECT query_id, rank, doc_id FROM kw').replace('terms', 'wterms')}".replace("terms AS (SELECT doc_id, 'javadoc'", "wterms AS (SELECT doc_id, 'javadoc'") + " SELECT * FROM worm",
        "a2_background": f"WITH {DOCS}, {terms('docs', ('name', 'javadoc', 'signature'))} SELECT * FROM (SELECT term, max(c) AS df FROM (SELECT field, term, count(*) AS c FROM terms GROUP BY ALL) GROUP BY term) WHERE df >= 2",
        "a3_name_grams": f"WITH {grams} SELECT gram, class FROM grams",
        "a4_acronyms": rf"""WITH t AS (SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in ACRONYMS)}) v(text)),
m AS (SELECT regexp_extract(x, '\(([A-Z]{{3,10}})\)$', 1) AS acronym, regexp_extract(x, '^(.*?)\s*\([A-Z]{{3,10}}\)$', 1) AS expansion FROM (SELECT unnest(regexp_extract_all(text, '([a-zA-Z][\w\s-]{{3,35}})\s*\(([A-Z]{{3,10}})\)')) AS x FROM t)
  UNION ALL SELECT regexp_extract(x, '^([A-Z]{{3,10}})', 1), regexp_extract(x, '\((.*)\)$', 1) FROM (SELECT unnest(regexp_extract_all(text, '\b([A-Z]{{3,10}})\s+\(([a-zA-Z][\w\s-]{{3,35}})\)')) AS x FROM t)),
w AS (SELECT acronym, regexp_split_to_array(trim(expansion), '[\s-]+') AS ws FROM m), s AS (SELECT acronym, ws[greatest(1, len(ws) - length(acronym) + 1):] AS tail FROM w)
SELECT DISTINCT acronym, lower(array_to_string(tail, ' ')) AS expansion FROM s WHERE upper(array_to_string(list_transform(tail, lambda w: w[1]), '')) = acronym""",
        "a4_initialisms": "SELECT * FROM (VALUES ('fst', 'finite state transducer', 'FSTReader'), ('fst', 'finite state tables', 'FSTReader'), ('knn', 'k nearest neighbours', 'KNNQuery'), ('knn', 'k near nodes', 'KNNQuery')) v(acronym, phrase, class)",
        "a4_expansion_grams": "SELECT * FROM (VALUES ('finitestate', 'FST'), ('statetransducer', 'FST'), ('nearestneighbours', 'KNN'), ('knearestneighbours', 'KNN'), ('callgraph', 'CGI'), ('graphindex', 'CGI'), ('callgraphoftheindex', 'CGI'), ('callgraphof', 'CGI'), ('graphofthe', 'CGI'), ('oftheindex', 'CGI'), ('mergepolicy', 'MP')) v(gram, class)",
        "a11_link_graph": f"WITH {DOCS}, {_CLASS_COMMENTS}, k AS (SELECT DISTINCT lower(class) AS low, class AS target FROM cc), l AS (SELECT class, javadoc, target, unnest({sql_tokens('sentence')}) AS t FROM (SELECT c.class, c.javadoc, k.target, substr(trim(regexp_extract(c.javadoc || ' {{@link ' || c.class || '}} {{@link a.b.' || c.other || '#go}}', '(?s)^(.*?)(?:\\.\\s|\\.$|$)', 1)), 1, 200) AS sentence FROM cc c JOIN k ON k.low IN (lower(c.class), lower(c.other)))), n AS (SELECT regexp_replace(t, '^[0-9]+|[0-9]+$', '', 'g') AS lhs, target AS rhs FROM l), p AS (SELECT c.class, k.target FROM cc c JOIN k ON k.low IN (lower(c.class), lower(c.other))) SELECT DISTINCT lhs, rhs FROM n WHERE length(lhs) >= 3 AND NOT list_contains({stop}, lhs) UNION SELECT lower(class), target FROM p UNION SELECT lower(target), class FROM p",
        "a11_package_paths": "SELECT DISTINCT lower(s) AS lhs, p_brand AS rhs FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS s FROM part) WHERE length(s) >= 3",
        "a11_context_windows": f"WITH {DOCS}, t AS (SELECT doc_id, unnest({sql_tokens('body')}) AS token, generate_subscripts({sql_tokens('body')}, 1) AS pos FROM docs), n AS (SELECT * FROM (VALUES ('license', 'License'), ('apache', 'ApacheLicense'), ('version', 'Version')) v(token, class)), h AS (SELECT doc_id, pos, class FROM t JOIN n USING (token)), c AS (SELECT regexp_replace(t.token, '^[0-9]+|[0-9]+$', '', 'g') AS lhs, class AS rhs FROM h JOIN t ON t.doc_id = h.doc_id AND t.pos BETWEEN h.pos - 5 AND h.pos + 5 AND t.pos <> h.pos), g AS (SELECT lhs, rhs, count(*) AS n FROM c WHERE length(lhs) >= 3 AND NOT list_contains({stop}, lhs) GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY rhs ORDER BY n DESC, lhs) <= 15",
        "a5_bigrams": f"WITH {DOCS}, {bigram} SELECT * FROM bigrams",
        "a6_class_terms": f"WITH {DOCS}, {terms('docs', ('javadoc',))}{wormhole(5, 'SELECT (doc_id % 50)::INTEGER AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rank FROM docs')} SELECT lhs, rhs, n FROM (SELECT term AS lhs, 'C' || query_id AS rhs, fg AS n, count(*) OVER (PARTITION BY term) AS c FROM worm WHERE fg >= 2) WHERE c <= 3",
        "a7_combined_rules": rules + ", u AS (SELECT lhs, rhs, 1 AS bit FROM g UNION ALL SELECT lhs, rhs, 2 FROM b UNION ALL SELECT lhs, rhs, 4 FROM g WHERE length(lhs) > 8) SELECT lhs, rhs, bit_or(bit)::INTEGER AS sources FROM u WHERE length(lhs) <= 20 AND NOT regexp_matches(lhs, '^[0-9]') GROUP BY ALL",
        "k20_appended_rules": rules + ", n AS (SELECT DISTINCT lhs, rhs FROM (SELECT * FROM g UNION ALL SELECT * FROM b) WHERE length(lhs) >= 4 AND lower(lhs) <> lower(rhs) AND NOT starts_with(lower(lhs), 'test') AND lhs NOT IN (SELECT lhs FROM b)) SELECT lhs, rhs FROM n QUALIFY count(*) OVER (PARTITION BY lhs) <= 2",
        "a8_redundant_rules": P._bm25(5, [(1, "anea"), (2, "license")]) + ", r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'anea' ELSE 'license' END AS lhs, doc_id AS rhs FROM docs) SELECT lhs, rhs FROM r WHERE NOT EXISTS (SELECT 1 FROM kw WHERE kw.doc_id = r.rhs AND (CASE kw.query_id WHEN 1 THEN 'anea' ELSE 'license' END) = r.lhs)",
        "a9_tf_idf": f"WITH {DOCS}, t AS (SELECT lang AS key, unnest({sql_tokens('javadoc')}) AS term FROM docs), tf AS (SELECT key, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT key, term, round(tf * ln((SELECT count(DISTINCT lang) FROM docs)::DOUBLE / df), 6) AS score FROM tf JOIN df USING (term)) SELECT * FROM (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY score DESC, term))::INTEGER AS rank, term, score FROM s) WHERE rank <= 5",
        "a10_co_callers": f"WITH {EDGES}, e AS (SELECT * FROM edges), z AS (SELECT dst, count(*) AS n FROM e GROUP BY dst), p AS (SELECT x.dst AS a, y.dst AS b, count(*) AS k FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst GROUP BY ALL), j AS (SELECT a, b, round(k::DOUBLE / (za.n + zb.n - k), 6) AS jaccard FROM p JOIN z za ON za.dst = a JOIN z zb ON zb.dst = b) SELECT * FROM j WHERE jaccard >= 0.05",
        "a11_npmi": "WITH e AS (SELECT user_id AS item, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), ab AS (SELECT DISTINCT * FROM e WHERE b IS NOT NULL), t AS (SELECT count(DISTINCT item)::DOUBLE AS total FROM ab), na AS (SELECT a, count(DISTINCT item) AS na FROM ab GROUP BY a), nb AS (SELECT b, count(DISTINCT item) AS nb FROM ab GROUP BY b), nab AS (SELECT a, b, count(*) AS n FROM ab GROUP BY ALL HAVING count(*) >= 2) SELECT a, b, n, round(CASE WHEN n / total < 1 THEN ln((n / total) / (na / total * nb / total)) / -ln(n / total) ELSE 1 END, 6) AS npmi FROM nab JOIN na USING (a) JOIN nb USING (b), t",
        "a12_languages": f"WITH {DOCS} SELECT coalesce(nullif(lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)), ''), 'other') AS extension, count(*) AS n FROM docs GROUP BY 1".replace("\\\\", "\\"),
        "a13_skeleton": f"WITH {DOCS}, t AS (SELECT * FROM docs WHERE access IN ('public', 'protected') QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY doc_id) <= 10) SELECT class_name, string_agg(name, '; ' ORDER BY doc_id) AS members, count(*) AS n FROM t GROUP BY class_name",
        "a14_project_stats": f"WITH {DOCS} SELECT project, count(*) AS docs, count(DISTINCT class_name) AS classes, sum(length(body))::BIGINT AS chars, count(DISTINCT lang) AS languages FROM docs GROUP BY project",
        "a15_recount": f"WITH {DOCS} SELECT doc_type, count(*) AS n FROM docs GROUP BY doc_type",
        "a16_metrics": P._bm25(20) + f", {qrels}, {met('kw')} SELECT * FROM met",
        "a17_class_grades": P._bm25(20) + f", {qrels}, cr AS (SELECT * FROM (VALUES {class_rules}) v(class_name)) SELECT k.query_id, rank, k.doc_id, coalesce(q.grade, CASE WHEN c.class_name IS NOT NULL THEN 1 END, 0) AS grade FROM kw k JOIN docs USING (doc_id) LEFT JOIN (SELECT * FROM qrels WHERE doc_id % 2 = 0) q ON q.query_id = k.query_id AND q.doc_id = k.doc_id LEFT JOIN cr c ON c.class_name = docs.class_name",
        "a18_benchmark": P._bm25(20) + f", {truth}, {hits('TRUE', 'h')} SELECT category, project, count(*) AS n, {at}, round(avg(CASE WHEN hit <= 10 THEN 1::DOUBLE / hit ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN hit <= 10 THEN 1 / log2(hit + 1) ELSE 0 END), 6) AS ndcg FROM h JOIN truth USING (query_id) GROUP BY GROUPING SETS ((), (category), (project))",
        "a18_regressions": P._bm25(20) + f", {truth}, {hits('TRUE', 'h')}, {hits('rank > 3', 'g')} SELECT query_id, coalesce(h.hit, 99) AS old, coalesce(g.hit, 99) AS new FROM h JOIN g USING (query_id) WHERE coalesce(g.hit, 99) > coalesce(h.hit, 99)",
        "a19_golden_set": "WITH l AS (SELECT user_id % 7 AS query, (event_type = 'purchase')::INTEGER AS rating FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 7, user_id % 50 ORDER BY ts DESC, (event_type = 'purchase')::INTEGER DESC) = 1) SELECT query, count(*) AS n, sum(rating)::BIGINT AS good FROM l GROUP BY query",
        "s31_last_ratings": "SELECT user_id, event_type, event_id AS rating FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
        "a20_weight_grid": P._both_sql() + f", lists AS (SELECT 0 AS list, * FROM kw UNION ALL SELECT 1, * FROM kv), c AS (SELECT *, count(*) OVER (PARTITION BY query_id, list) AS n FROM lists), s AS ({grid}), o AS (SELECT *, row_number() OVER (PARTITION BY step, query_id ORDER BY score DESC, doc_id) AS rank FROM s), f AS (SELECT step, query_id, min(rank) FILTER (WHERE (query_id, doc_id) IN ((1, 25), (1, 7), (7, 7), (7, 3))) AS hit FROM o WHERE rank <= 10 GROUP BY ALL) SELECT step, round(avg(coalesce(1::DOUBLE / hit, 0)), 6) AS mrr FROM f GROUP BY step",
        "a21_synonym_ablation": P._bm25(10) + f", {qrels}, syn AS {syn_run}, {met('kw', 'm1')}, {met('syn', 'm2')} SELECT 'none' AS variant, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m1 UNION ALL SELECT 'synonyms', round(avg(mrr), 6), round(avg(ndcg), 6) FROM m2",
        "a22_boost_ablation": P._bm25(10) + f", {qrels}, mul AS ({P._ranked(P._multiplied('kw'), None)}), {met('kw', 'm1')}, {met('mul', 'm2')} SELECT 'base' AS variant, round(avg(mrr), 6) AS mrr FROM m1 UNION ALL SELECT 'multiplied', round(avg(mrr), 6) FROM m2",
        "a23_percentiles": "SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type",
    }


def queries():
    return {n: f for n, f in globals().items() if n[0] in "aks" and n[1:2].isdigit()}
