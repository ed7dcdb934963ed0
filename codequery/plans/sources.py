"""Queries of parsers, build files, chunkers and streams over small fixed files and the pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequery.functions import chunking as N
from codequery.sources import builds, code, config, files
from codequery.plans.views import DOCS, documents, table

CODE = {
    "app/src/main/java/shop/Cart.java": "package shop;\n\nimport java.util.List;\nimport shop.model.Item;\n\n/** A cart. */\n@Service\npublic class Cart extends Base implements Priced {\n  private final List<Item> items;\n  private int total;\n\n  public Cart(List<Item> items) {\n    this.items = items;\n  }\n\n  public int sum(Tax tax) {\n    int total = 0;\n    for (Item i : items) { total += i.price() + tax.of(i); }\n    report(total);\n    return total;\n  }\n\n  private void report(int n) { this.total = n; }\n}\n",
    "app/src/main/java/shop/Tax.java": "package shop;\n\npublic interface Tax {\n  int of(Item i);\n}\n",
    "tools/src/pkg/run.py": "import os\nfrom json import loads\n\n\nclass Runner(Base):\n    name: str\n\n    def __init__(self, n):\n        self.n = n\n\n    @cached\n    def go(self, x: int) -> str:\n        return str(loads(x)) + os.getcwd()\n\n\ndef main():\n    Runner(1).go(2)\n",
    "web/src/view.ts": "import { api } from './api';\n\n@Component({a: 1})\nexport class View extends Panel implements Shown {\n  draw(ctx: Ctx, n: number): void {\n    ctx.fill(n);\n  }\n}\n\nexport const load = async (id: string) => {\n  return api.get(id);\n};\n\ninterface Shown {\n  x: number;\n}\n",
    "lib/cache.rb": "require 'set'\n\nmodule Store\n  class Cache\n    def get(key, default = nil)\n      fetch(key) do\n        default\n      end\n    end\n\n    def self.open(path)\n      new(path)\n    end\n  end\nend\n",
    "lib/core.rs": "use std::fmt;\n\npub struct Node { v: i32 }\n\nimpl Node {\n    pub fn grow(&mut self, by: i32) -> i32 {\n        self.v += step(by);\n        self.v\n    }\n}\n",
    "lib/shape.kt": "package geo\n\nimport kotlin.math.sqrt\n\ndata class Shape(val a: Double) {\n    fun area(scale: Double): Double {\n        return sqrt(a) * scale\n    }\n}\n",
    "target/Old.java": "class Old {}\n",
}
TEXTS = {
    "docs/guide.md": "# Guide\nIntro text.\n\n## Setup\nRun it. See [the notes](notes.md#run) and [web](https://x.y).\n\n```\n# not a heading\n```\n\n### Linux\nUse apt.\n\n## Use\nCall [home](#guide).\n",
    "docs/notes.txt": "First para line one\nline two\n\nSecond para\n\n\nThird\n",
    "docs/old.rst": "Title\n=====\n\nBody here.\n\nNext part\n---------\n\nMore.\n",
    "conf/app.yaml": "name: x\nports:\n  - 1\n  - 2\nmode: fast\n",
}
BUILDS = {
    "a/pom.xml": "<project xmlns=\"http://maven.apache.org/POM/4.0.0\"><parent><groupId>org.p</groupId><artifactId>par</artifactId><version>2.0</version></parent><artifactId>a</artifactId><properties><lib.v>1.5</lib.v></properties><modules><module>core</module></modules><dependencies><dependency><groupId>${project.groupId}</groupId><artifactId>lib</artifactId><version>${lib.v}</version><scope>test</scope></dependency></dependencies></project>",
    "a/package.json": '{"name": "@org/web", "version": "1.0", "dependencies": {"react": "^18", "@x/y": "2"}}',
    "b/build.gradle": "group = 'g.b'\nversion = '0.1'\ndependencies {\n  implementation 'com.google:guava:31'\n  api project(':core')\n}\n",
    "c/pyproject.toml": '[project]\nname = "my-tool"\nversion = "3"\ndependencies = [\n  "requests>=2.0",\n  "numpy",\n]\n',
    "d/CMakeLists.txt": "project(Demo VERSION 1.2)\n",
}


MORE_CODE = {
    "lib/src/p/Outer.java": "package p;\n\nimport a.b.Store;\n\n/**\n * Keeps things.\n * See {@link Store}.\n */\npublic abstract class Outer<T> implements X<T> {\n  /** Opens it. */\n  @Override\n  public static synchronized Map<String, List<T>> open(final int a, String... rest) {\n    Store s = find(a);\n    s.put(a, more(1, two(3)), \"x, y\");\n    return null;\n  }\n\n  abstract void close();\n\n  static class Inner {\n    /** The size. */\n    int size() { return 1; }\n  }\n}\n",
    "lib/shape.swift": "import Foundation\n\n/// A shape.\n@objc(Shape) public class Shape {\n    /// Its area.\n    @discardableResult public func area(scale: Double) -> Double {\n        return scaled(scale)\n    }\n}\n",
    "lib/util.kt": "package u\n\nimport a.b.Old as New\n\n// Joins.\nfun join(a: String, b: String): String {\n    return glue(a, b)\n}\n",
    "web/box.ts": "/** A box. */\n@Injectable()\nexport abstract class Box<T> extends Base.Thing implements A {\n  /** Puts. */\n  static async put<K>(key: K, v: { a: number }): Promise<void> { store.set(key, v); }\n  get size(): number { return this.items.length; }\n}\nconst twice = (x, {y}) => mul(x, 2);\nlet late = function (z) { return twice(z); };\n",
    "tools/src/pkg/doc.py": "class A:\n    \"\"\"An A.\"\"\"\n\n    @staticmethod\n    async def make():\n        \"\"\"Makes one.\"\"\"\n        return A()\n",
}
SCRIPT_JSON = '[{"file": "a/b.rb", "package": "x.b", "classes": [{"name": "C", "bases": ["D"], "decorators": [], "line": 1, "end_line": 9}], "functions": [{"name": "go", "class_name": "C", "params": ["n"], "decorators": ["m"], "calls": ["run", "stop"], "line": 2, "end_line": 4}, {"name": "top", "class_name": null, "params": [], "calls": [], "line": 11, "end_line": 12}]}, {"file": "z.rb", "classes": [], "functions": [{"name": "solo", "line": 1, "end_line": 1}]}]'
GRADLE = {
    "settings.gradle": "rootProject.name = 'whole'\n",
    "gradle.properties": "group=org.whole\nversion=7.1\n",
    "gradle/libs.versions.toml": '[versions]\njson = "2.9"\n[libraries]\njson-core = { module = "org.json:core", version.ref = "json" }\nlog = "org.log:log4:1.2"\nhttp = { group = "net.http", name = "client", version = "5" }\n[bundles]\nbase = ["json-core", "log"]\n',
    "build.gradle": "dependencies {\n  implementation libs.json.core\n  testImplementation 'junit:junit:4.13'\n}\n",
    "app/build.gradle.kts": "dependencies {\n  implementation(libs.bundles.base)\n  api(libs.http)\n  implementation(project(\":core\"))\n}\n",
    "core/gradle.properties": "version=1.0-core\n",
    "core/build.gradle": "group = 'org.core'\n",
}
PIPELINES = "pipelines:\n\n  # words\n  - name: words\n    label: \"Words\"\n    retrievers: [keyword]\n\n  - name: both\n    requires: [vectors, ce]\n    retrievers: [keyword, vector]\n    oversample: 3\n    merger: rrf\n    rerankers: [ce, mmr]  # last\n\n  - name: _auto\n    visible: false\n    router: classifier\n    dispatch:\n      KEYWORD: words\n      default: both\n"


LANGUAGES = {
    'a.scala': 'package x.y\nimport a.b.C\n\n// Adds.\ncase class Point(x: Int) {\n  def add(other: Point, n: Int = 2): Point = {\n    make(x + n)\n  }\n}\nobject Run extends App {\n  override def main(args: Array[String]): Unit = {\n    start(args)\n  }\n}\n',
    'b.swift': 'import UIKit\n\nprotocol Drawn {\n}\n@objc public class View: Base {\n    private static func make(size s: Int) -> View {\n        return build(s)\n    }\n}\n',
    'C.cs': 'using System.Text;\nnamespace App.Core\n{\n    public sealed class Store\n    {\n        public async Task<int> Save(string key, int n)\n        {\n            return await Write(key, n);\n        }\n        private static void Clear() { Drop(); }\n    }\n}\n',
    'd.fs': 'module Shop.Cart\nopen System\n\ntype Cart() =\n    member this.Add(item, n) =\n        push item\n        total(n)\n\nlet rec sum xs =\n    fold xs\n',
    'E.hs': 'module Data.Tree where\nimport qualified Data.Map as M\n\ndata Tree = Leaf\nclass Shape a where\n  area :: a -> Int\ngrow :: Tree -> Tree\ngrow t = t\n',
    'f.ex': 'defmodule Shop.Cart do\n  alias Shop.Item\n\n  def add(cart, item) do\n    push(cart, item)\n  end\n\n  defp total(cart), do: sum(cart)\nend\n',
    'g.clj': '(ns shop.cart\n  (:require [clojure.set :as s]))\n\n(defrecord Cart [items])\n\n; Adds.\n(defn add [cart item]\n  (conj cart item))\n',
    'H.vb': 'Imports System.IO\nNamespace Shop\nPublic Class Cart\n    Public Function Add(ByVal n As Integer) As Integer\n        Return Total(n)\n    End Function\n    Private Sub Clear()\n        Drop()\n    End Sub\nEnd Class\nEnd Namespace\n',
}
MORE_BUILDS = {
    'p/setup.py': 'from setuptools import setup\nsetup(name=\'my-lib\', version="1.2", install_requires=[\'numpy>=1.2\', \'a.b[x]==3\', "six"])\n',
    'q/setup.cfg': '[metadata]\nname = conf-lib\nversion = 0.3\n[options]\ninstall_requires =\n    requests>=2\n    click\npackages = find:\n',
    'r/pyproject.toml': "[tool.poetry]\nname = 'poet'\nversion = '2.0'\n[tool.poetry.dependencies]\npython = '^3.9'\nrich = '^13.1'\nattrs = {version = '22'}\n",
    's/package.json': '{"name": "plain", "dependencies": {"left-pad": "1.0"}, "peerDependencies": {"@t/u": "^2"}}',
    'u/pyproject.toml': '[broken',
    'v/CMakeLists.txt': 'cmake_minimum_required(VERSION 3)\nPROJECT( Big.Thing LANGUAGES C )\n',
}


def _frame(spark, rows: dict[str, str]):
    return spark.createDataFrame(list(rows.items()), "path string, text string")


def s1_walk(spark, sf_dir):
    return files.kept(_frame(spark, {f"/r/{p}": t for p, t in CODE.items()}), ("java", "py")).select("path")


def s2_discovery(spark, sf_dir):
    paths = ["/w/a/pom.xml", "/w/a/core/pom.xml", "/w/b/x.csproj", "/w/node_modules/c/package.json", "/w/d/e/setup.py", "/w/d/readme.md"]
    return files.discovered(spark.createDataFrame([(p,) for p in paths], "path string"))


def s4_java(spark, sf_dir):
    rows = code.parsed(files.kept(_frame(spark, {f"/{p}": t for p, t in CODE.items()}), ("java",)))
    return rows.select("path", "kind", "owner", "name", F.array_join("params", ",").alias("params"), F.array_join("types", ",").alias("types"), "returns", "access", F.array_join("calls", ",").alias("calls"), "line", "end_line")


def s4_comments(spark, sf_dir):
    """Comments, flags, outer classes and full names of what the parsers find."""
    rows = code.parsed(_frame(spark, {**CODE, **MORE_CODE})).where("kind IN ('class', 'method')")
    name = F.when(F.col("kind") == "class", code.class_fqn()).otherwise(code.method_fqn())
    return rows.select(name.alias("fqn"), "comment", F.array_join("flags", ",").alias("flags")).where("comment <> '' OR flags <> ''")


def s11_script_json(spark, sf_dir):
    out = code.from_script_json(spark.createDataFrame([(SCRIPT_JSON,), ("no json",), ("[]",)], "json string"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("path", "kind", "owner", "name", joined("params"), joined("bases"), joined("annotations"), joined("calls"), "line", "package")


def s22_single_chunks(spark, sf_dir):
    out = files.single_chunks(_frame(spark, {**TEXTS, "a/Readme.cfg": "\n  x = 1\n" + "y" * 130, "b/empty.ini": " \n"}))
    return out.select("path", "start", "end", F.length("text").alias("size"), "title", "description", files.chunk_name(F.col("description")).alias("name"))


def s25_gradle(spark, sf_dir):
    """Gradle builds with settings, properties and a version catalog beside or above them."""
    rows = builds.modules(_frame(spark, GRADLE))
    deps = F.array_join(F.transform("deps", lambda d: F.concat_ws(":", d["group_id"], d["artifact_id"], d["version"])), ",")
    return rows.select("path", "group_id", "artifact_id", "version", deps.alias("deps"))


def s28_projects(spark, sf_dir):
    """Two projects' indexes, saved and read as one, and one project of them."""
    from codequery.api import CodeIndex
    from codequery.session import checkpointed, deleted, shared_dir

    folder = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    one = {p: t for p, t in CODE.items() if p.endswith(".java") and "target" not in p}
    CodeIndex.build(_frame(spark, one), "shop").save(f"{folder}/a")
    CodeIndex.build(_frame(spark, {p: t for p, t in CODE.items() if p.endswith(".py")}), "tools").save(f"{folder}/b")
    every = CodeIndex.load(spark, f"{folder}/a", f"{folder}/b")
    part = every.of_projects("tools").counts().select(F.lit("tools").alias("of"), "project", "doc_type", "n")
    out = checkpointed(every.counts().select(F.lit("all").alias("of"), "project", "doc_type", "n").unionByName(part))
    deleted(spark, folder)
    return out


def s30_synonyms(spark, sf_dir):
    lines = ["# rules", "", "car, Auto => vehicle", "big, large, huge  # sizes", "alone", "a => a, b"]
    return config.synonyms(spark.createDataFrame([(x,) for x in lines], "value string"))


def s30_pipelines(spark, sf_dir):
    out = config.pipeline_table(spark, PIPELINES)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("name", "visible", joined("retrievers"), "merger", joined("rerankers"), "oversample", joined("requires"), "dispatches")


def g19_package_hints(spark, sf_dir):
    return code.unresolved_refs(code.parsed(_frame(spark, {p: t for p, t in {**CODE, **MORE_CODE}.items() if p.endswith(".java")})))


def s5_resolved_calls(spark, sf_dir):
    return code.resolved_calls(code.parsed(_frame(spark, {p: t for p, t in CODE.items() if p.endswith(".java")})))


def s7_relationships(spark, sf_dir):
    return code.relationships(code.parsed(_frame(spark, {p: t for p, t in CODE.items() if p.endswith((".java", ".py"))})))


def s8_field_access(spark, sf_dir):
    return code.parsed(_frame(spark, CODE)).where("kind IN ('reads', 'writes')").select("owner", F.col("name").alias("field"), "kind", F.col("returns").alias("method"))


def s9_python(spark, sf_dir):
    return code.parsed(_frame(spark, {p: t for p, t in CODE.items() if p.endswith(".py")})).select("kind", "owner", "name", F.array_join("bases", ",").alias("bases"), F.array_join("annotations", ",").alias("annotations"), F.array_join("calls", ",").alias("calls"), "package", "line")


def s10_typescript(spark, sf_dir):
    return code.parsed(_frame(spark, {p: t for p, t in CODE.items() if p.endswith(".ts")})).select("kind", "owner", "name", F.array_join("params", ",").alias("params"), F.array_join("annotations", ",").alias("annotations"), "body", "line")


def s12_languages_by_rule(spark, sf_dir):
    return code.parsed(_frame(spark, {p: t for p, t in CODE.items() if p.startswith("lib/")})).select("path", "kind", "owner", "name", F.array_join("params", ",").alias("params"), F.array_join("calls", ",").alias("calls"), "line", "end_line")


def s12_more_languages(spark, sf_dir):
    rows = code.parsed(_frame(spark, LANGUAGES))
    return rows.select("path", "kind", "owner", "name", F.array_join("params", ",").alias("params"), F.array_join("calls", ",").alias("calls"), "package", F.array_join("imports", ",").alias("imports"), "comment", "line", "end_line")


def s26_python_node_cmake(spark, sf_dir):
    deps = F.array_join(F.transform("deps", lambda d: F.concat_ws(":", d["group_id"], d["artifact_id"], d["version"], d["scope"])), ",")
    return builds.modules(_frame(spark, MORE_BUILDS)).select("path", "tool", "group_id", "artifact_id", "version", deps.alias("deps"))


def s14_last_before(spark, sf_dir):
    """Each purchase with the user's last signup at or before it."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "signup", 0).otherwise(1), "event_id")
    rows = e.withColumn("signup", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w))
    return rows.where("event_type = 'purchase'").select("event_id", "user_id", F.coalesce("signup", F.lit(-1)).alias("signup"))


def s17_generic_documents(spark, sf_dir):
    return files.generic_documents(_frame(spark, TEXTS))


def s18_markdown_chunks(spark, sf_dir):
    return files.markdown_chunks(_frame(spark, {p: t for p, t in TEXTS.items() if p.endswith(".md")}))


def s19_rst_chunks(spark, sf_dir):
    return files.rst_chunks(_frame(spark, {p: t for p, t in TEXTS.items() if p.endswith(".rst")}))


def s20_paragraphs(spark, sf_dir):
    """Paragraphs of the documents: lines up to a blank one; every document's number and longest."""
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("body").alias("text"))
    return files.paragraph_chunks(d, 3).groupBy("path").agg(F.count("*").alias("n"), F.max(F.col("end") - F.col("start")).alias("longest"))


def s21_yaml_chunks(spark, sf_dir):
    return files.yaml_chunks(_frame(spark, {p: t for p, t in TEXTS.items() if p.endswith(".yaml")}))


def s23_links(spark, sf_dir):
    return files.markdown_links(_frame(spark, TEXTS))


def s23_page_links(spark, sf_dir):
    return files.page_links(table(spark, sf_dir, "pages"))


def s24_build_files(spark, sf_dir):
    return builds.modules(_frame(spark, BUILDS)).select("path", "tool", "group_id", "artifact_id", "version", F.array_join("modules", ",").alias("modules"), F.array_join(F.transform("deps", lambda d: F.concat_ws(":", d["group_id"], d["artifact_id"], d["version"], d["scope"])), ",").alias("deps"))


def s27_build_precedence(spark, sf_dir):
    return builds.first_of_folder(builds.modules(_frame(spark, BUILDS))).select("path", "tool", "artifact_id")


def n4_method_chunks(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "body", F.concat("name", F.lit("\n")).alias("prefix"))
    return N.chunked(d, "prefix").groupBy("id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"), F.max("end_line").alias("lines"))


def n5_class_chunks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class"), F.concat(F.element_at(F.split("p_name", " "), 1), F.initcap(F.element_at(F.split("p_name", " "), -1))).alias("name"))
    return N.class_groups(p.distinct()).select("class", "part", F.sha2("names", 256).alias("names"))


def n6_document_chunks(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "body")
    return N.chunked(d, None, True, 4000).groupBy("id").agg(F.count("*").alias("chunks"), F.max("end_line").alias("lines"))


def n7_text_chunks(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "body")
    return N.text_chunks(d, 2000).groupBy("id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))


def f18_segmented_words(spark, sf_dir):
    vocabulary = {"skip", "list", "skiplists", "graph", "node", "hash", "map", "a"}
    rows = [(w, " ".join(N.segmented(w, vocabulary))) for w in ("skiplist", "hashmapnode", "graph", "xyz", "alist")]
    return spark.createDataFrame(rows, "word string, parts string")


def oracle_sql() -> dict[str, str]:
    return {
        "s14_last_before": "SELECT p.event_id, p.user_id, coalesce((SELECT s.event_id FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND s.ts <= p.ts ORDER BY s.ts DESC, s.event_id DESC LIMIT 1), -1) AS signup FROM events p WHERE event_type = 'purchase'",
        "s20_paragraphs": f"WITH {DOCS}, l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS t, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM docs), b AS (SELECT *, trim(t) = '' AS blank, coalesce(lag(trim(t) = '') OVER (PARTITION BY doc_id ORDER BY line), TRUE) AS before FROM l), p AS (SELECT *, sum((NOT blank AND before)::INTEGER) OVER (PARTITION BY doc_id ORDER BY line) AS para FROM b), c AS (SELECT doc_id, para, line, (row_number() OVER (PARTITION BY doc_id, para ORDER BY line) - 1) // 3 AS cut FROM p WHERE NOT blank), s AS (SELECT doc_id, para, cut, max(line) - min(line) AS span FROM c GROUP BY ALL) SELECT doc_id::VARCHAR AS path, count(*) AS n, max(span)::INTEGER AS longest FROM s GROUP BY doc_id",
        "s23_page_links": "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY ALL",
    }


def queries():
    return {n: f for n, f in globals().items() if n[0] in "snfg" and n[1:2].isdigit()}
