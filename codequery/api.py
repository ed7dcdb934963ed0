"""The engine over source trees: an index of documents, words, edges and modules, and the questions that it answers."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codequery.functions import text as X
from codequery.operators import evaluation as E
from codequery.operators import fusion as U
from codequery.operators import graph as G
from codequery.operators import index as K
from codequery.operators import lookup as L
from codequery.operators import retrieval as R
from codequery.operators import routing as Q
from codequery.session import checkpointed
from codequery.sources import builds, code, files

FIELDS = tuple(R.BOOSTS)
#: What an index keeps, and the column that its folder is parted by.
TABLES = {"docs": "project", "edges": "project", "modules": "project", "lengths": "project", "refs": "project"}
CODE_ENDINGS = (*code.BY_ENDING, ".java", ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs")


@dataclass
class CodeIndex:
    """``docs``: one row for each class, method and document; ``edges``: (project, src, dst, edge_type) by full name;
    ``modules``: build files; ``refs``: calls of what no project declares; ``lengths`` (project, doc_id, field, len) and
    ``postings`` (field, term, doc_id, tf, positions, len, bucket): the inverted table of the documents' fields."""

    docs: DataFrame
    edges: DataFrame
    modules: DataFrame
    refs: DataFrame
    lengths: DataFrame
    postings: DataFrame

    # -- building and keeping ----------------------------------------------------------------------------------------

    @classmethod
    def build(cls, tree: DataFrame, project: str) -> CodeIndex:
        """From files (path, text)."""
        name = F.lit(project)
        rows = checkpointed(code.parsed(tree))
        calls = code.resolved_calls(rows).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("calls").alias("edge_type"))
        edges = calls.unionByName(code.relationships(rows).select("src", "dst", "edge_type"))
        docs = checkpointed(cls._documents(tree, rows, calls, project))
        modules = builds.first_of_folder(builds.modules(tree)).withColumn("project", name)
        tokens = R.field_tokens(docs, FIELDS)
        lengths = tokens.select(name.alias("project"), "doc_id", "field", "len")
        postings = R.postings(docs, FIELDS).withColumn("bucket", R.bucket(F.col("term")))
        refs = code.unresolved_refs(rows).withColumn("project", name)
        return cls(docs, edges.withColumn("project", name), modules, refs, lengths, postings)

    @staticmethod
    def _documents(tree: DataFrame, rows: DataFrame, calls: DataFrame, project: str) -> DataFrame:
        is_class = F.col("kind") == "class"
        names = calls.select(F.col("src").alias("node"), F.regexp_extract("src", r"#([^(]*)", 1).alias("name")).distinct()
        fields = K.call_fields(calls, names).withColumnRenamed("node", "fqn")
        signature = F.concat("name", F.lit("("), F.array_join("params", ", "), F.lit(")"))
        of_code = rows.where("kind IN ('class', 'method')").select(
            F.when(is_class, code.class_fqn()).otherwise(code.method_fqn()).alias("fqn"), F.col("kind").alias("doc_type"),
            "name", F.when(is_class, F.col("name")).otherwise(code.simple_owner()).alias("class_name"),
            F.when(is_class, "").otherwise(signature).alias("signature"),
            F.array_join("annotations", " ").alias("annotations"),
            F.when(is_class, F.coalesce("returns", F.lit("class"))).alias("class_type"), "access", "flags",
            F.col("comment").alias("javadoc"), "path", "line", "end_line", "body",
        )
        of_class = rows.where("kind = 'method'").select(
            F.concat_ws(".", F.nullif(F.col("package"), F.lit("")), "owner").alias("class"), "line", signature.alias("signature")
        )
        bodies = K.class_bodies(of_class).select(F.col("class").alias("fqn"), F.col("body").alias("_body"))
        of_code = of_code.join(bodies, "fqn", "left")
        own = F.when((F.col("doc_type") == "class") & (F.col("body") == ""), F.coalesce("_body", F.lit(""))).otherwise(F.col("body"))
        of_code = of_code.withColumn("body", own).drop("_body")
        known = "|".join(e.replace(".", r"\.") for e in CODE_ENDINGS)
        others = files.kept(tree.withColumn("path", F.concat(F.lit("/"), "path")), files.TEXT_EXTENSIONS)
        others = others.withColumn("path", F.substr("path", F.lit(2))).where(~F.rlike("path", F.lit(f"(?:{known})$")))
        of_text = files.generic_documents(others).join(others, "path").select(
            F.col("path").alias("fqn"), F.lit("doc").alias("doc_type"), F.col("title").alias("name"),
            F.col("stem").alias("class_name"), F.lit("").alias("signature"), F.lit("").alias("annotations"),
            F.lit(None).cast("string").alias("class_type"), F.lit("").alias("access"),
            F.array().cast("array<string>").alias("flags"), F.col("description").alias("javadoc"), "path",
            F.lit(1).alias("line"), F.size(F.split("text", "\n")).alias("end_line"), F.col("text").alias("body"),
        )
        docs = of_code.unionByName(of_text).join(fields, "fqn", "left")
        return docs.select(
            F.xxhash64(F.lit(project), "fqn", "path", "line").alias("doc_id"), F.lit(project).alias("project"), "fqn",
            "doc_type", F.concat_ws(" ", "name", X.split_identifier(F.col("name"))).alias("name"), "class_name", "javadoc",
            "signature", "annotations", F.coalesce("callers", F.lit("")).alias("caller_context"), "body", "class_type",
            "access", "flags", F.col("path").alias("file_path"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
            "line", "end_line",
        )

    def save(self, folder: str) -> None:
        for name, by in TABLES.items():
            getattr(self, name).write.mode("overwrite").partitionBy(by).parquet(f"{folder}/{name}")
        R.save_postings(self.postings.drop("bucket"), f"{folder}/postings")
        # An empty table has no files that tell its columns.
        kinds = [(name, getattr(self, name).schema.json()) for name in (*TABLES, "postings")]
        self.spark.createDataFrame(kinds, "name string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/kinds")

    @classmethod
    def load(cls, spark: SparkSession, *folders: str) -> CodeIndex:
        """The index of one folder, or several as one."""

        def tables(folder: str) -> dict[str, DataFrame]:
            kinds = {r.name: StructType.fromJson(json.loads(r.kind)) for r in spark.read.parquet(f"{folder}/kinds").collect()}
            return {name: spark.read.schema(kind).parquet(f"{folder}/{name}") for name, kind in kinds.items()}

        return cls.union([cls(**tables(f)) for f in folders])

    @classmethod
    def union(cls, parts: list[CodeIndex]) -> CodeIndex:
        join = lambda name: reduce(DataFrame.unionByName, (getattr(p, name) for p in parts))
        return cls(**{name: join(name) for name in (*TABLES, "postings")})

    def of_projects(self, *names: str) -> CodeIndex:
        """The rows of some projects; of a saved index the others are not read."""
        keep = {n: getattr(self, n).where(F.col("project").isin(*names)) for n in TABLES}
        ids = keep["docs"].select("doc_id")
        return CodeIndex(**keep, postings=self.postings.join(ids, "doc_id", "left_semi"))

    def without_project(self, name: str) -> CodeIndex:
        rest = {n: K.without_project(getattr(self, n), name) for n in TABLES}
        gone = self.docs.where(F.col("project") == name).select("doc_id")
        return CodeIndex(**rest, postings=self.postings.join(gone, "doc_id", "left_anti"))

    def updated(self, changed: DataFrame, gone: DataFrame, project: str) -> CodeIndex:
        """The index after some files (path, text) of a project have changed or come and others (path) have gone: their
        documents and words are replaced, all others stay as they are."""
        fresh = CodeIndex.build(changed, project)
        paths = changed.select("path").unionByName(gone.select("path")).distinct()
        mine = self.docs.where(F.col("project") == project)
        old = checkpointed(mine.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("doc_id", "fqn"))
        ids, names = old.select("doc_id"), old.select("fqn").distinct()
        own = lambda df, key: df.join(names.select(F.col("fqn").alias(key)), key, "left_anti")
        kept = lambda df, key: own(df.where(F.col("project") == project), key).unionByName(df.where(F.col("project") != project))
        docs = self.docs.join(ids, "doc_id", "left_anti").unionByName(fresh.docs)
        modules = self.modules.join(paths, "path", "left_anti").unionByName(fresh.modules)
        return CodeIndex(
            docs,
            kept(self.edges, "src").unionByName(fresh.edges),
            modules,
            kept(self.refs, "caller").unionByName(fresh.refs),
            self.lengths.join(ids, "doc_id", "left_anti").unionByName(fresh.lengths),
            self.postings.join(ids, "doc_id", "left_anti").unionByName(fresh.postings),
        )

    # -- questions ---------------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def _node(self, fqn: str, name: str = "root") -> DataFrame:
        """A full name as it stands, and those of the methods that it names without their parameters."""
        given = self.spark.createDataFrame([(fqn,)], f"{name} string")
        return given.unionByName(self.docs.where(F.col("fqn").startswith(fqn + "(")).select(F.col("fqn").alias(name))).distinct()

    @property
    def calls(self) -> DataFrame:
        return self.edges.where("edge_type = 'calls'")

    @property
    def stats(self) -> DataFrame:
        """(field, n_docs, avg_len) of the inverted table."""
        return R.field_stats(self.lengths)

    def search(self, text: str, limit: int = 20, doc_type: str | None = None, scope: str | None = None) -> DataFrame:
        """Ranked documents of a query, with the boosts of its hints."""
        words = [w.rstrip(":").partition(":")[0].lower() for w in text.split()]
        named = self.docs.select("project").where(F.lower("project").isin(words)).distinct()  # a query's words at most
        hints = Q.parse_hints(text, [r.project for r in named.collect()])
        keep = F.lit(True)
        if doc_type:
            keep = keep & (F.col("doc_type") == doc_type)
        if scope:
            keep = keep & (X.scope(F.col("file_path")) == scope)
        asked = R.batch(self.spark, [(1, hints.text)])
        hits = R.keyword(self.docs, asked, limit, keep=keep, index=(self.postings, self.stats)).join(self.docs, "doc_id")
        if hints.project:
            hits = U.boosted(hits, F.col("project") == hints.project, U.EXPLICIT if hints.project_explicit else U.IMPLICIT)
        if hints.language:
            hits = U.boosted(hits, F.col("file_path").endswith(hints.language), U.EXPLICIT if hints.language_explicit else U.IMPLICIT)
        found = R.ranked(hits).join(self.docs, "doc_id")
        return found.select("rank", "score", "fqn", X.label(F.col("doc_type")).alias("label"), "file_path", "line").orderBy("rank")

    def suggestions(self, text: str) -> DataFrame:
        names = self.docs.withColumn("name", F.split_part("name", F.lit(" "), F.lit(1)))
        return L.did_you_mean(names, R.batch(self.spark, [(1, text)]))

    def get(self, fqn: str) -> DataFrame:
        return self.docs.where((F.col("fqn") == fqn) | F.col("fqn").startswith(fqn + "(")).orderBy("fqn").limit(50)

    def callers(self, fqn: str) -> DataFrame:
        return G.neighbours(self.calls, self._node(fqn, "node"), "callers")

    def callees(self, fqn: str) -> DataFrame:
        return G.neighbours(self.calls, self._node(fqn, "node"), "callees")

    def impact(self, fqn: str, depth: int = 5, most: int = 2000) -> DataFrame:
        return G.impact(self.calls, self._node(fqn), min(depth, 10), most)

    def trace(self, fqn: str, depth: int = 2) -> DataFrame:
        return G.traced(self.calls, self._node(fqn), self.docs.select(F.col("fqn").alias("node"), "body"), min(depth, 4))

    def path(self, src: str, dst: str) -> DataFrame:
        both = self._node(src, "src").withColumn("k", F.lit(1)).join(self._node(dst, "dst").withColumn("k", F.lit(1)), "k")
        return G.shortest_path(self.calls, both.select("src", "dst"))

    def usages(self, fqn: str) -> DataFrame:
        return G.usages(self.edges, self._node(fqn, "node"))

    def subtypes(self, fqn: str) -> DataFrame:
        return G.subtypes(self.edges, self._node(fqn))

    def links(self) -> DataFrame:
        """Calls across projects: unresolved references and the best method of another project for each."""
        known = self.docs.where("doc_type = 'method'").select("project", "fqn", X.fqn_parts(F.col("fqn")).alias("p"), "class_name")
        known = known.select("project", "fqn", F.col("p.simple_name").alias("name"), F.col("class_name").alias("class"), F.col("p.package").alias("package"), F.col("p.n_params").alias("arity"))
        return G.linked(self.refs, known)

    def boundary(self, project: str, most: int = 200) -> tuple[DataFrame, DataFrame]:
        """A project's methods that others call, and its first calls of what nobody declares with their number."""
        own = self.docs.where((F.col("project") == project) & (F.col("doc_type") == "method")).select(F.col("fqn").alias("node"))
        links = checkpointed(self.links())
        cross = links.where((F.col("to_project") == project) & (F.col("project") != project)).select(F.col("fqn").alias("dst"))
        open_ = self.refs.where(F.col("project") == project).join(links.select("project", "caller", "name", "receiver"), ["project", "caller", "name", "receiver"], "left_anti")
        return G.boundary(own, cross, open_.select("caller", "name"), most)

    def skeleton(self, prefix: str = "", most: int = 500) -> DataFrame:
        shown = self.docs.where(F.col("doc_type") == "method")
        shown = shown.where(F.col("access").isin("public", "protected", "") & F.col("file_path").startswith(prefix))
        return shown.select("class_name", "signature", "line").orderBy("class_name", "line").limit(most)

    def languages(self) -> DataFrame:
        found = self.docs.groupBy(X.extension(F.col("file_path")).alias("extension")).agg(F.count("*").alias("n"))
        return found.orderBy(F.desc("n"), "extension")

    def counts(self) -> DataFrame:
        return self.docs.groupBy("project", "doc_type").agg(F.count("*").alias("n"))

    def stamps(self) -> DataFrame:
        """What tells whether the graph of a kind of edge has changed since."""
        return G.stamps(self.edges)

    def dependencies(self) -> DataFrame:
        d = self.modules.select(F.concat_ws(":", "group_id", "artifact_id").alias("src"), F.explode("deps").alias("d"))
        dst = F.concat_ws(":", "d.group_id", "d.artifact_id").alias("dst")
        return d.select("src", dst, "d.scope", F.col("d.version").alias("declared_version"))

    def module_listing(self) -> DataFrame:
        keys = self.modules.select(F.concat_ws(":", "group_id", "artifact_id").alias("module_key"), "version")
        return G.module_listing(keys, self.dependencies())

    def evaluated(self, run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
        return E.metrics(E.graded(run, qrels), qrels, k)
