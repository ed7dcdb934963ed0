"""Index maintenance: snapshots, dirty files, updates, derived fields, vectors and modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dirty(state: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of ``files`` (path, mtime_ms, sha256) that are new, or whose time and content both changed."""
    old = state.select("path", F.col("mtime_ms").alias("_m"), F.col("sha256").alias("_h"))
    both = files.join(old, "path", "left")
    changed = (F.col("mtime_ms") != F.col("_m")) & (F.col("sha256") != F.col("_h"))
    return both.where(F.col("_m").isNull() | changed).select("path")


def outdated(state: DataFrame, chunking: int, fingerprint: str) -> DataFrame:
    """Paths whose embeddings another version or model made."""
    return state.where((F.col("chunking_version") != chunking) | ~F.col("model_fingerprint").eqNullSafe(fingerprint)).select("path")


def deleted(state: DataFrame, files: DataFrame, root: str, pruned: tuple[str, ...] = ()) -> DataFrame:
    """Paths below ``root`` that are gone, those in pruned folders left alone."""
    inside = F.col("path").startswith(root)
    for p in pruned:
        inside = inside & ~F.contains(F.col("path"), F.lit(f"/{p}/"))
    return state.where(inside).join(files, "path", "left_anti").select("path")


def updated(docs: DataFrame, fresh: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """``docs`` without the rows of replaced and deleted paths, and the fresh rows."""
    out = gone.select(key).unionByName(fresh.select(key)).distinct()
    return docs.join(out, key, "left_anti").unionByName(fresh)


def call_fields(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, in_degree, callers): distinct callers and their simple names."""
    e = edges.select("src", "dst").distinct().join(names.select(F.col("node").alias("src"), "name"), "src", "left")
    return e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"), F.array_join(F.array_sort(F.collect_set("name")), " ").alias("callers"))


def class_bodies(members: DataFrame) -> DataFrame:
    """(class, body): the class's signatures in line order."""
    return members.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "signature"))), lambda x: x["signature"]), "\n").alias("body"))


def with_stubs(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """(node, owned): all methods, and callees that nothing declares."""
    own = methods.select("node").distinct()
    stubs = edges.select(F.col("dst").alias("node")).distinct().join(own, "node", "left_anti")
    return own.withColumn("owned", F.lit(True)).unionByName(stubs.withColumn("owned", F.lit(False)))


def knowledge_vertices(edges: DataFrame) -> DataFrame:
    """(node, kind): every end of an edge; a ``#`` makes a method."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return ends.withColumn("kind", F.when(F.contains("node", F.lit("#")), "Method").otherwise("CodeType"))


def evicted(edges: DataFrame, classes: DataFrame, owner: Column) -> DataFrame:
    """Edges without those whose source belongs to one of ``classes`` (class)."""
    return edges.withColumn("class", owner).join(classes, "class", "left_anti").drop("class")


def upserted(modules: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row for each module_key: the old one, except that INDEXED replaces EXTERNAL."""
    rows = modules.withColumn("_o", F.lit(0)).unionByName(fresh.withColumn("_o", F.lit(1)))
    order = Window.partitionBy("module_key").orderBy(F.desc(F.col("status") == "INDEXED"), "_o", "version")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_o")


def dependencies(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Dependencies once for (src, dst, scope); no scope is compile, no version unknown."""
    rows = old.withColumn("_o", F.lit(0)).unionByName(fresh.withColumn("_o", F.lit(1)))
    rows = rows.withColumn("scope", F.coalesce("scope", F.lit("compile"))).withColumn("declared_version", F.coalesce("declared_version", F.lit("unknown")))
    order = Window.partitionBy("src", "dst", "scope").orderBy("_o", "declared_version")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_o")


def linked_modules(modules: DataFrame, projects: DataFrame) -> DataFrame:
    """Modules with the registered project of the same group and artifact, where they are external."""
    p = projects.select(F.concat_ws(":", "group_id", "artifact_id").alias("module_key"), F.col("project").alias("_p"))
    out = modules.join(p, "module_key", "left")
    return out.withColumn("project", F.coalesce("project", "_p")).withColumn("status", F.when(F.col("_p").isNotNull(), "INDEXED").otherwise(F.col("status"))).drop("_p")


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (key, text) that the cache (key, vec) lacks; the key is the text's SHA-256."""
    return texts.select(F.sha2("text", 256).alias("key"), "text").distinct().join(cache, "key", "left_anti")


def cached(texts: DataFrame, cache: DataFrame, embed: Column) -> DataFrame:
    """``texts`` (id, text) with vectors from the cache, or embedded once for each text."""
    rows = texts.withColumn("key", F.sha2("text", 256))
    new = cache_misses(texts, cache).select("key", embed.alias("vec"))
    return rows.join(cache.select("key", "vec").unionByName(new), "key").select("id", "vec")


def with_model(vectors: DataFrame, texts: DataFrame, model: str, embed: Column) -> DataFrame:
    """``vectors`` (model, id, vec) and those of ``texts`` (id, text) by another model; ids that it has already are kept."""
    had = vectors.where(F.col("model") == model).select("id")
    new = texts.join(had, "id", "left_anti").select(F.lit(model).alias("model"), "id", embed.alias("vec"))
    return vectors.select("model", "id", "vec").unionByName(new)


def backfilled(vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """A cache (model, key, vec) of what an index holds: one vector for each text's hash, that of the least id."""
    rows = vectors.join(texts.select("id", F.sha2("text", 256).alias("key")), "id")
    return rows.groupBy("model", "key").agg(F.min_by("vec", "id").alias("vec"))


def refs_stamp(refs: DataFrame) -> DataFrame:
    """(project, refs, stamp) of unresolved references (project, caller, name, receiver): sums over their hashes, so that
    any that comes, goes or changes shows, in whatever order they are."""
    text = F.concat_ws("\u0001", F.coalesce("caller", F.lit("")), F.coalesce("name", F.lit("")), F.coalesce("receiver", F.lit("")))
    digits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return refs.groupBy("project").agg(F.count("*").alias("refs"), F.sum(digits).cast("string").alias("stamp"))


def without_project(docs: DataFrame, project: str) -> DataFrame:
    return docs.where(~F.col("project").eqNullSafe(project))


def invalidated(state: DataFrame, scope: str) -> DataFrame:
    """The file states whose embeddings go: docs, code or all."""
    is_doc = F.rlike("path", F.lit(r"\.(md|txt|rst|adoc|html|ya?ml|json|toml)$"))
    keep = {"docs": ~is_doc, "code": is_doc, "all": F.lit(False)}[scope]
    return state.withColumn("model_fingerprint", F.when(keep, F.col("model_fingerprint")))


def hashing_embedder(text: Column, dims: int = 16) -> Column:
    """A deterministic stand-in for an embedding model: hashed word counts, unit length."""
    from codequery.functions.text import bound, tokens

    slots = F.transform(tokens(text), lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(dims)))
    count = lambda s, d: (F.size(s) - F.size(F.array_remove(s, F.lit(d).cast("long")))).cast("double")
    counts = bound(slots, lambda s: F.array(*(count(s, d) for d in range(dims))))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda c, n: F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(c)
    return bound(counts, lambda c: bound(norm(c), lambda n: unit(c, n)))
