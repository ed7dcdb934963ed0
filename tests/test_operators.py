"""Semantics that the fixed tables do not reach."""

import itertools
import os
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequery import session
from codequery.functions import chunking as N
from codequery.functions import text as X
from codequery.operators import evaluation as E
from codequery.operators import fusion as U
from codequery.operators import graph as G
from codequery.operators import index as K
from codequery.operators import mining as M
from codequery.operators import retrieval as R
from codequery.operators import routing as Q
from codequery.plans.views import part_edges
from codequery.sources import builds, code, files

DIR = "/root/testdata/sf0.001"
LIST = "query_id int, rank int, doc_id long, score double"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_split_identifier(spark):
    df = spark.createDataFrame([("parseXMLDocument",), ("a_b",), ("toJSON",)], "x string")
    assert rows(df.select(X.split_identifier(F.col("x")).alias("y")), "y") == [("a b",), ("parse xml document",), ("to json",)]


@pytest.mark.parametrize(
    ("kind", "phrase"),
    [("List<User>", "list of User"), ("Map<String,User>", "map of String to User"), ("User[]", "array of User"), ("void", None), ("Optional<User>", "optional User"), ("User", "User"), ("CompletableFuture<X>", "future X"), ("Foo<Bar>", "Foo")],
)
def test_return_phrase(spark, kind, phrase):
    assert spark.createDataFrame([(kind,)], "x string").select(X.return_phrase(F.col("x"))).first()[0] == phrase


def test_phrase_beats_scattered_words(spark):
    docs = [(1, "merge ranked lists"), (2, "merge a b c d e ranked x y z lists")]
    d = spark.createDataFrame(docs, "doc_id long, javadoc string")
    terms = R.query_terms(R.batch(spark, [(1, "merge ranked lists")]))
    found = R.phrases(R.scanned(R.field_tokens(d, ("javadoc",)), R.batch_terms(terms)), terms)
    assert [r.doc_id for r in found.collect()] == [1]


def test_enough_matches_needs_three_of_four(spark):
    d = spark.createDataFrame([(1, "a1 b1 c1 x"), (2, "a1 b1 x y")], "doc_id long, body string")
    terms = R.query_terms(R.batch(spark, [(1, "a1 b1 c1 d1")]))
    w = R.weighted(R.scanned(R.field_tokens(d, ("body",)), R.batch_terms(terms)), terms)
    assert [r.doc_id for r in R.least_matches(w).collect()] == [1]


def test_no_match_no_row(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, body string")
    assert R.bm25(d, R.batch(spark, [(1, "zzz"), (2, "")]), 5).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 20), min_size=1, max_size=6, unique=True), st.lists(st.integers(0, 20), min_size=1, max_size=6, unique=True))
def test_rrf_is_symmetric(spark, a, b):
    make = lambda ids: spark.createDataFrame([(1, i + 1, d, 1.0) for i, d in enumerate(ids)], LIST)
    assert rows(U.rrf([make(a), make(b)]), "rank", "doc_id", "score") == rows(U.rrf([make(b), make(a)]), "rank", "doc_id", "score")


def test_agreement_bonus(spark):
    a = spark.createDataFrame([(1, 1, 7, 1.0), (1, 2, 8, 0.5)], LIST)
    b = spark.createDataFrame([(1, 1, 8, 1.0)], LIST)
    got = dict(rows(U.rrf([a, b]), "doc_id", "score"))
    assert got == {8: round(1.5 * (1 / 62 + 1 / 61), 6), 7: round(1 / 61, 6)}


def test_diversity_decay(spark):
    a = spark.createDataFrame([(1, i + 1, i, 1.0 - i / 100) for i in range(4)], LIST)
    got = dict(rows(U.diversified(a, F.lit("k")), "doc_id", "score"))
    assert got == {0: 1.0, 1: 0.495, 2: 0.245, 3: 0.12125}
    with pytest.raises(ValueError, match="between"):
        U.diversified(a, F.lit("k"), decay=2)


def test_bfs_with_cycle_and_self_loop(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 3), (4, 1)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (9,)], "root long")
    assert rows(G.bfs(e, roots, None), "root", "node", "depth") == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (9, 9, 0)]
    cut = G.capped(G.bfs(e, roots, None), 2)
    assert rows(cut, "root", "node", "truncated") == [(1, 1, True), (1, 2, True), (9, 9, False)]


def test_shortest_path_is_least(spark):
    e = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d")], "src string, dst string")
    p = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "a"), ("a", "zz")], "src string, dst string")
    assert rows(G.shortest_path(e, p), "src", "dst", F.array_join("path", "")) == [("a", "a", "a"), ("a", "d", "abd")]


def test_pipelines_are_validated():
    with pytest.raises(ValueError, match="retriever"):
        Q.Pipeline("x", [])
    with pytest.raises(ValueError, match="merger"):
        Q.Pipeline("x", [lambda q, n: q, lambda q, n: q])
    with pytest.raises(KeyError):
        Q.Registry([], ()).get("nope")


def test_hints():
    h = Q.parse_hints("Lucene: fast merge in:java", ["lucene"])
    assert (h.text, h.project, h.project_explicit, h.language, h.language_explicit) == ("fast merge", "lucene", True, ".java", True)
    assert Q.parse_hints("note: x", ["lucene"]).text == "note: x"


def test_metrics_edges(spark):
    run = spark.createDataFrame([(1, 1, 5, 1.0), (1, 2, 6, 1.0), (2, 1, 5, 1.0)], LIST)
    q = spark.createDataFrame([(1, 6, 2)], "query_id int, doc_id long, grade int")
    got = {r.query_id: r for r in E.metrics(E.graded(run, q), q, 2).collect()}
    assert (got[1].mrr, got[1].p, got[1].r, got[1].ap) == (0.5, 0.5, 1.0, 0.5)
    assert (got[2].mrr, got[2].r, got[2].ndcg, got[2].ap) == (0.0, 1.0, 0.0, 0.0)


@given(st.text(alphabet="ab \n.", max_size=400), st.integers(20, 80))
def test_text_chunks_cover(text, budget):
    parts = N.split_text(text, budget, 5)
    assert all(len(p) <= budget for p in parts)
    assert parts[0] == text[: len(parts[0])] and text.endswith(parts[-1])


def test_line_chunks_cover_all_lines():
    body = "\n".join(f"line {i} " + "x" * 60 for i in range(400))
    parts = N.pack_lines(body, "P\n")
    assert parts[0][0] == 1 and parts[-1][1] == 400
    assert all(b[0] == a[1] + 1 for a, b in zip(parts, parts[1:]))
    assert all(len(t) <= N.BUDGET for _, _, t in parts)


def test_parsers(spark):
    from codequery.plans.sources import BUILDS, CODE, TEXTS

    java = {(r["kind"], r["owner"], r["name"]) for r in code.parse("C.java", CODE["app/src/main/java/shop/Cart.java"])}
    assert {("class", "", "Cart"), ("method", "Cart", "<init>"), ("method", "Cart", "sum"), ("method", "Cart", "report"), ("field", "Cart", "items"), ("writes", "Cart", "total")} <= java
    calls = next(r["calls"] for r in code.parse("C.java", CODE["app/src/main/java/shop/Cart.java"]) if r["name"] == "sum")
    assert "Tax.of/1" in calls and "Item.price/0" in calls and "Cart.report/1" in calls
    ruby = {(r["owner"], r["name"]): r["end_line"] for r in code.parse("c.rb", CODE["lib/cache.rb"]) if r["kind"] == "method"}
    assert ruby == {("Cache", "get"): 9, ("Cache", "open"): 13}
    md = files.markdown_chunks(spark.createDataFrame([("g.md", TEXTS["docs/guide.md"])], "path string, text string"))
    assert [r.breadcrumb for r in md.orderBy("section").collect()] == ["Guide", "Guide > Setup", "Guide > Setup > Linux", "Guide > Use"]
    pom = builds.read("a/pom.xml", BUILDS["a/pom.xml"])
    assert (pom["group_id"], pom["version"], pom["deps"][0]["group_id"], pom["deps"][0]["version"]) == ("org.p", "2.0", "org.p", "1.5")
    assert builds.read("x/package.json", "{") is None and code.parse("x.py", "def (") == []


def test_stream_replaces_files(spark, tmp_path):
    from codequery.streaming.incremental import current, indexed_stream

    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    schema = "path string, text string"
    for text in ("one two two", "three"):
        spark.createDataFrame([("a", text)], schema).write.mode("append").parquet(src)
        indexed_stream(spark, src, schema, out, mark).awaitTermination()
    assert rows(current(spark, out), "path", "term", "tf") == [("a", "three", 1)]


def test_late_events_are_dropped(spark, tmp_path):
    from codequery.streaming.incremental import windowed_counts

    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    (tmp_path / "src").mkdir()
    schema = "ts timestamp, event_type string"
    stream = windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    batches = [[("2024-01-01 10:05:00", "a"), ("2024-01-01 10:50:00", "a")], [("2024-01-01 12:30:00", "b")], [("2024-01-01 10:10:00", "a"), ("2024-01-01 12:40:00", "b")], [("2024-01-01 15:00:00", "c")], [("2024-01-01 15:01:00", "c")]]
    for rows_ in batches:
        spark.createDataFrame(rows_, "ts string, event_type string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
        stream.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = rows(spark.read.parquet(out).select(F.date_format("start", "HH:mm").alias("h"), "event_type", "n"), "h", "event_type", "n")
    assert got == [("10:00", "a", 2), ("12:00", "b", 2)]


def test_index_follows_its_tree(spark, tmp_path):
    from codequery.api import CodeIndex
    from codequery.plans.sources import CODE

    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    java = {p: t for p, t in CODE.items() if p.endswith(".java") and "target" not in p}
    cart = "app/src/main/java/shop/Cart.java"
    CodeIndex.build(frame(java), "shop").save(str(tmp_path / "a"))
    changed = {cart: java[cart].replace("report(", "notify("), "app/New.java": "package shop; class New { void notify(int n) { new Tax().of(n); } }"}
    fresh = CodeIndex.load(spark, str(tmp_path / "a")).updated(frame(changed), spark.createDataFrame([("app/src/main/java/shop/Tax.java",)], "path string"), "shop")
    fresh.save(str(tmp_path / "b"))
    now = CodeIndex.load(spark, str(tmp_path / "b"))
    whole = CodeIndex.build(frame({**{p: t for p, t in java.items() if "Tax" not in p}, **changed}), "shop")
    names = lambda i: rows(i.docs, "fqn")
    assert names(now) == names(whole) and ("shop.Cart#notify(int)",) in names(now) and ("shop.Tax",) not in names(now)
    key = lambda i: rows(i.postings.join(i.docs, "doc_id"), "fqn", "field", "term", "tf")
    plain = lambda k: [x for x in k if x[1] != "caller_context"]
    assert plain(key(now)) == plain(key(whole))
    assert now.search("notify", 3).first().fqn.endswith("#notify(int)") and now.search("tax of", 9).where("fqn LIKE 'shop.Tax%'").count() == 0
    assert now.without_project("shop").docs.count() == 0 and now.of_projects("shop").docs.count() == now.docs.count()
    assert {r.name for r in now.refs.collect()} >= {"of"}


def test_projects_are_linked(spark):
    from codequery.api import CodeIndex

    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    lib = CodeIndex.build(frame({"S.java": "package a.b; public class Store { public void put(int k) { } void put(String k) { } }"}), "lib")
    app = CodeIndex.build(frame({"M.java": "package m; import a.b.Store; class M { void go(Store s) { s.put(1); gone(2); } }"}), "app")
    both = CodeIndex.union([lib, app])
    assert rows(both.links(), "project", "caller", "name", "to_project", "fqn", "points") == [("app", "m.M#go(Store)", "put", "lib", "a.b.Store#put(int)", 3)]
    entries, exits = both.boundary("lib")
    assert rows(entries, "node") == [("a.b.Store#put(int)",)] and exits.count() == 0
    assert rows(both.boundary("app")[1], "caller", "name", "total") == [("m.M#go(Store)", "gone", 1)]


def test_config_readers(spark, tmp_path):
    from codequery.sources import config

    (tmp_path / "r.json").write_text('{"a": {"path": "/x", "groupId": "g"},\n "b": {"path": "/y"}}')
    (tmp_path / "g.jsonl").write_text('{"query": "q", "project": "p", "result_id": "r", "rank": 2, "rating": "good", "ts": "t"}\nbroken\n')
    (tmp_path / "i.csv").write_text("phrase,intent,doctype\nHow to,BEHAVIORAL,\nenum for,ENUM,class\n")
    assert rows(config.registry(spark, str(tmp_path / "r.json")), "project", "path", "group_id") == [("a", "/x", "g"), ("b", "/y", None)]
    assert rows(config.ratings(spark, str(tmp_path / "g.jsonl")), "query", "rank", "rating") == [("q", 2, "good")]
    assert rows(config.intents(spark, str(tmp_path / "i.csv")), "phrase", "intent", "doc_type") == [("enum for", "ENUM", "class"), ("how to", "BEHAVIORAL", None)]


def test_http_provider(spark):
    from codequery.operators import embedding as M

    calls = []

    def service(texts):
        calls.append([len(t) for t in texts])
        if len(calls) == 1:
            return 503, "busy"
        if sum(map(len, texts)) > 2000:
            return 400, "maximum context length exceeded"
        return 200, [[float(len(t)), 1.0] for t in texts]

    p = M.HttpProvider(service, 2, batch=4, pause_s=0.0)
    got = p.embed(["a" * 900, "b" * 10, "c" * 5000, "d" * 800, "e" * 1100])
    assert got == [[900.0, 1.0], [10.0, 1.0], [1250.0, 1.0], [800.0, 1.0], [1100.0, 1.0]] and p.batch < 4
    assert M.HttpProvider(lambda t: (400, "too long") if len(t[0]) > 300 else (200, [[1.0]]), 1).embed(["x" * 4000]) == [None]
    with pytest.raises(RuntimeError, match="refused"):
        M.HttpProvider(lambda t: (401, "who are you"), 1).embed(["x"])
    with pytest.raises(RuntimeError, match="failed"):
        M.HttpProvider(lambda t: (500, "no"), 1, pause_s=0.0).embed(["x"])
    with pytest.raises(ValueError, match="dimensions"):
        M.HttpProvider(lambda t: (200, [[1.0]]), 3).checked()
    models = M.Models({"one": p, "none": M.NoProvider()}, "one")
    assert models.get() is p and M.NoProvider().embed(["x"]) == [None]
    with pytest.raises(M.Unavailable):
        models.get("none")
    texts = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    out = M.embedded(texts, lambda: M.HttpProvider(lambda t: (200, [[float(len(x))] for x in t]), 1))
    assert rows(out, "id", F.get("vec", F.lit(0))) == [(1, 2.0), (2, 0.0)]


def test_local_models(spark):
    import numpy as np

    from codequery.operators import embedding as M

    seen = []

    def run(ids, mask):
        seen.append(ids.shape)
        return np.stack([ids * 1.0, ids * 0.0 + 1.0], axis=2) + 100 * (1 - mask[..., None])

    p = M.LocalProvider(lambda t: [len(w) for w in t.split()], run, 2, batch=2)
    got = p.embed(["a bbb", "cc", "a a a a a", ""])
    want = [(2.0, 1.0), (2.0, 1.0), (1.0, 1.0)]
    assert all(np.allclose(g, np.array(w) / np.linalg.norm(w)) for g, w in zip(got, want)) and got[3] == [0.0, 0.0]
    assert seen == [(2, 1), (2, 5)]
    assert np.allclose(M.positive(np.array([[0.0], [2.0]])), [0.5, 1 / (1 + np.exp(-2))])
    assert np.allclose(M.positive(np.array([[1.0, 1.0], [0.0, np.log(3)]])), [0.5, 0.75])
    pairs = spark.createDataFrame([(1, 5, "a b", "a b c"), (1, 6, "a b", "x")], "query_id int, doc_id long, query string, passage string")
    model = lambda: lambda both: np.array([[float(len(set(q.split()) & set(t.split())))] for q, t in both])
    assert [(d, round(s, 4)) for d, s in rows(M.pair_scores(pairs, model), "doc_id", "score")] == [(5, 0.8808), (6, 0.5)]


def test_walk_reads_a_tree(spark, tmp_path):
    for p in ("a/x.java", "a/target/y.java", "a/.git/z.java", "a/b/node_modules/w.java", "a/b/n.md", "a/b/c.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"text of {p}")
    got = files.walked(spark, str(tmp_path / "a"), ("java", "py"))
    assert [(p.rsplit("/a/", 1)[1], t) for p, t in rows(got, "path", "text")] == [("b/c.py", "text of a/b/c.py"), ("x.java", "text of a/x.java")]


def _first_lines(lines, room):
    """How many lines a chunk takes: as many as fit, one at least, back to a blank line past the half."""
    sizes = list(itertools.accumulate(len(x) + 1 for x in lines))
    n = max(1, sum(x <= room for x in sizes))
    blanks = [i for i in range(1, n) if not lines[i].strip()] if n < len(lines) else []
    return blanks[-1] + 1 if blanks and sizes[blanks[-1] - 1] > room / 2 else n


def _chunk_lengths(body, prefix, budget, head):
    """(length, last line) of each chunk; ``head`` gives the lines repeated at the start of all but the first."""
    if len(prefix) + len(body) + 10 <= budget:
        return [(len(prefix) + len(body), body.count("\n") + 1)]
    out, lines, done = [], body.split("\n"), 0
    while done < len(lines):
        n = _first_lines(lines[done:], max(1, budget - len(prefix) - 400))
        over = head(lines, done) if done else []
        kept = sum(len(x) + 1 for x in over) + len("// ...\n") if over else 0
        out.append((len(prefix) + kept + len("\n".join(lines[done : done + n])), done + n))
        done += n
    return out


@pytest.mark.skipif(not os.path.isdir(DIR), reason="tables are not here")
def test_chunk_queries_by_hand(spark):
    from codequery.plans.sources import n4_method_chunks, n6_document_chunks, n7_text_chunks
    from codequery.plans.views import documents

    docs = {r.doc_id: (r.body, r.name) for r in documents(spark, DIR).collect()}
    first = lambda lines, _: [x for x in lines if x.strip()][:2]
    last = lambda lines, at: lines[max(0, at - 3) : at]
    four = {i: _chunk_lengths(b, n + "\n", 8000, first) for i, (b, n) in docs.items()}
    assert rows(n4_method_chunks(spark, DIR), "id", "chunks", "longest", "lines") == sorted((i, len(c), max(x for x, _ in c), c[-1][1]) for i, c in four.items())
    six = {i: _chunk_lengths(b, "", 4000, last) for i, (b, _) in docs.items()}
    assert rows(n6_document_chunks(spark, DIR), "id", "chunks", "lines") == sorted((i, len(c), c[-1][1]) for i, c in six.items())
    seven = []
    for i, (b, _) in docs.items():
        sizes = []
        while len(b) > 2000:
            ends = [[m.end() for m in re.finditer(sep, b[:2000]) if m.start() > 1000] for sep in ("\n(?=\n)", "\n", r"\. ", " ")]
            ends[0] = [e + 1 for e in ends[0] if e + 1 <= 2000]
            n = next((e[-1] for e in ends if e), 2000)
            sizes.append(n)
            b = b[max(n - 200, 1) :]
        seven.append((i, len(sizes) + 1, max([*sizes, len(b)])))
    assert rows(n7_text_chunks(spark, DIR), "id", "chunks", "longest") == sorted(seven)


def test_script_parser_by_hand():
    text = "/** Sums. */\nexport default function sum(a, b = f(1)) { return add(a, b); }\nclass A extends B { #x = 1; run() { if (x) { go(); } } static of(n) { return new A(n); } handler = async (e) => { on(e); } }\nconst t = `class C { m() {} }`; // class D {}\nconst cb = list.map((x) => x);\n"
    got = [(r["kind"], r["owner"], r["name"], r["params"], r["calls"], r["comment"]) for r in code.parse("u.js", text)]
    assert got == [
        ("method", "u", "sum", ["a", "b"], ["add"], "Sums."), ("class", "", "A", [], [], ""), ("method", "A", "run", [], ["go"], ""),
        ("method", "A", "of", ["n"], [], ""), ("method", "A", "handler", ["e"], ["on"], ""),
    ]


def test_deep_generics_and_long_arguments(spark):
    fqn = "a.B#m(" + "Map<K," * 9 + "V" + ">" * 9 + ",int)"
    assert spark.createDataFrame([(fqn,)], "x string").select(X.fqn_parts(F.col("x"))["n_params"]).first()[0] == 2
    java = "class C { void m(D d) { d.g(1, \"" + "x" * 3000 + "\", h(2, 3)); } }"
    assert "D.g/3" in next(r["calls"] for r in code.parse("C.java", java) if r["name"] == "m")


def test_stamps_see_every_edge(spark):
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls")], "src string, dst string, edge_type string")
    base = G.stamps(e).first().stamp
    other = e.where("src <> 'b'").unionByName(spark.createDataFrame([("b", "x", "calls")], e.schema))
    assert G.stamps(other).first().stamp != base and G.stamps(e.orderBy(F.desc("src"))).first().stamp == base


def test_long_walks_merge_their_hops(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    got = rows(G.bfs(e, spark.createDataFrame([(0,)], "root long"), None), "node", "depth")
    assert got == [(i, i) for i in range(41)]


def test_code_index(spark, tmp_path):
    from codequery.api import CodeIndex
    from codequery.plans.sources import BUILDS, CODE, TEXTS

    tree = spark.createDataFrame(list({**CODE, **TEXTS, **BUILDS}.items()), "path string, text string")
    CodeIndex.build(tree, "demo").save(str(tmp_path / "i"))
    i = CodeIndex.load(spark, str(tmp_path / "i"))
    assert i.search("sum tax", 5).first().fqn == "shop.Cart#sum(Tax)"
    assert rows(i.callers("shop.Tax#of"), "other") == [("shop.Cart#sum(Tax)",)]
    assert rows(i.get("shop.Cart#sum"), "fqn") == [("shop.Cart#sum(Tax)",)] and i.get("shop.Cart").first().javadoc == "A cart."
    assert rows(i.path("shop.Cart#sum", "shop.Cart#report"), F.size("path")) == [(2,)]
    assert ("inherits",) in rows(i.usages("Base"), "kind")
    assert i.languages().count() > 3 and i.module_listing().count() == 4 and i.trace("shop.Cart#sum").count() > 2


def test_embedder_reads_a_text_once(spark):
    v = spark.createDataFrame([("a b a",), ("",)], "t string").select(K.hashing_embedder(F.col("t"), 4).alias("v"))
    assert v._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
    one, none = (r.v for r in v.collect())
    assert sum(x * x for x in one) == pytest.approx(1) and none == [0.0] * 4


def test_alike_candidates_meet_once(spark):
    refs = spark.createDataFrame([("P", f"c{i}", "get", "A" if i % 2 else None, 1, "p") for i in range(40)], "project string, caller string, name string, receiver string, arity long, package_hint string")
    names = [("L", f"{p}.f{i:02}", "get", k, p, a) for i in range(50) for p in ("p", "q") for k in ("A", "B") for a in (1, 2)] + [("L", "q.f", "get", "A", "q", 1)]
    methods = spark.createDataFrame(names, "project string, fqn string, name string, class string, package string, arity long")
    found = G.linked(refs, methods)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Window" not in plan and plan.index("Join") < plan.rindex("min(struct(length")
    assert rows(found, "caller", "fqn", "points") == sorted((f"c{i}", "p.f00", 3 if i % 2 else 1) for i in range(40))


def test_edges_of_lines_in_parts_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 100)
    n = -(-spark.read.parquet(f"{DIR}/lineitem.parquet").count() // 100)
    plan = part_edges(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {n}), REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_direct_neighbours_once(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 1)], "src long, dst long")
    found = G.neighbours(edges, spark.createDataFrame([(1,), (1,)], "node long"), "both")
    assert rows(found, "node", "other") == [(1, 2), (1, 3)]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert re.search("Dedup|Distinct|Aggregate", plan).start() < plan.index("Join")


def test_chunks_leave_a_worker_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(N, "OUT_CHARS", 1000)
    made, real = [], N.pa.RecordBatch

    class Batch(real):
        @classmethod
        def from_arrays(cls, *a, **k):
            made.append(real.from_arrays(*a, **k))
            return made[-1]

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            body = ["x" * 40 + "\n" + "y" * 4000] * 5
            return list(run(iter([real.from_arrays([N.pa.array(range(5)), N.pa.array(body)], ["id", "body"])])))

    monkeypatch.setattr(N.pa, "RecordBatch", Batch)
    out = N.text_chunks(Frame(), 500)
    assert len(out) > 5 and max(sum(map(len, b.column(2).to_pylist())) for b in out) < 2000
    assert [t for b in out for t in b.column(2).to_pylist()] == 5 * N.split_text("x" * 40 + "\n" + "y" * 4000, 500)


def test_terms_of_a_few_ranked_documents_and_of_many(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma{i % 2} delta") for i in range(12)], "doc_id long, body string")
    r = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 5)], "query_id int, rank int, doc_id long")
    few = M.characteristic(d, r, ("body",))
    assert "posexplode" not in few._jdf.queryExecution().analyzed().toString() and "LeftSemi" in few._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(M, "BROADCAST_ROWS", 1)
    assert rows(few, *few.columns) == rows(M.characteristic(d, r, ("body",)), *few.columns)


def test_windows_are_cut_within_the_row(spark, monkeypatch):
    d = spark.createDataFrame([(1, "red license uno due license"), (2, None), (3, "license"), (4, "red red license uno")], "doc_id long, body string")
    n = spark.createDataFrame([("license", "L"), ("license", "K"), ("none", "N")], "token string, class string")
    few = M.context_windows(d, n, "body", width=2, least=1)
    assert "posexplode" not in few._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(M, "BROADCAST_ROWS", 1)
    many = M.context_windows(d, n, "body", width=2, least=1)
    assert rows(few, "lhs", "rhs", "n") == rows(many, "lhs", "rhs", "n") == [("due", "K", 2), ("red", "K", 3), ("uno", "K", 3)]


def test_matches_are_gathered_in_one_pass_over_a_row(spark):
    d = spark.createDataFrame([(1, "b a b c a b"), (2, "c"), (3, None)], "doc_id long, body string")
    found = R.scanned(R.field_tokens(d, ("body",)), ["a", "b"])
    assert rows(found.rows, "doc_id", "term", "tf", "positions", "len") == [(1, "a", 2, [1, 4], 6), (1, "b", 3, [0, 2, 5], 6)]
    assert rows(found.stats, "n_docs") == [(2,)]
    assert rows(d.select(F.size(R.by_term(R.with_places(X.tokens(F.col("body"))))).alias("n")), "n") == [(0,), (1,), (3,)]
    assert R.scanned(R.field_tokens(d, ("body",)), []).rows.count() == 0
