"""Queries of index maintenance over orders, parts and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codequery.operators import index as K
from codequery.plans.views import DOCS, EDGES, documents, part_edges, sql_tokens, table
from codequery.session import checkpointed, deleted, shared_dir


def _snapshots(spark, sf_dir):
    """Two snapshots of the documents as files: every 7th changed, every 11th only touched, every 13th gone, every 17th new."""
    d = documents(spark, sf_dir)
    path = F.concat(F.lit("root/"), F.when(F.col("doc_id") % 5 == 0, "target/").otherwise("src/"), F.col("doc_id").cast("string"))
    digest = F.sha2("body", 256)
    old = d.where("doc_id % 17 <> 0").select(path.alias("path"), F.lit(1).cast("long").alias("mtime_ms"), digest.alias("sha256"), (F.col("doc_id") % 3).cast("int").alias("chunking_version"), F.when(F.col("doc_id") % 4 == 0, "m1").when(F.col("doc_id") % 4 == 1, "m2").alias("model_fingerprint"))
    touched = (F.col("doc_id") % 7 == 0) | (F.col("doc_id") % 11 == 0)
    new = d.where("doc_id % 13 <> 0").select(path.alias("path"), F.when(touched, 2).otherwise(1).cast("long").alias("mtime_ms"), F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("body", F.lit("x")), 256)).otherwise(digest).alias("sha256"))
    return old, new


_SNAP = "d AS (SELECT doc_id, 'root/' || CASE WHEN doc_id % 5 = 0 THEN 'target/' ELSE 'src/' END || doc_id AS path FROM documents)"


def k2_incremental(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    fresh = new.join(K.dirty(old, new), "path", "left_semi")
    return K.updated(old.select("path", "mtime_ms", "sha256"), fresh, K.deleted(old, new, "root/")).select("path", "mtime_ms", "sha256")


def k3_dirty(spark, sf_dir):
    return K.dirty(*_snapshots(spark, sf_dir))


def k4_outdated(spark, sf_dir):
    return K.outdated(_snapshots(spark, sf_dir)[0], 1, "m1")


def k5_deleted(spark, sf_dir):
    return K.deleted(*_snapshots(spark, sf_dir), "root/", ("target",))


def k6_documents(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", "project", "name", "class_name", "doc_type", "class_type", "access", "file_path")


def k7_call_fields(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("name"))
    return K.call_fields(part_edges(spark, sf_dir), names)


def k8_class_bodies(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class"), F.col("p_partkey").alias("line"), F.col("p_name").alias("signature"))
    return K.class_bodies(p).select("class", F.sha2("body", 256).alias("digest"))


def k9_removed_project(spark, sf_dir):
    return K.without_project(documents(spark, sf_dir), "src1").groupBy("project").agg(F.count("*").alias("n"))


def k10_stubs(spark, sf_dir):
    own = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("node"))
    return K.with_stubs(part_edges(spark, sf_dir), own)


def k11_vertices(spark, sf_dir):
    e = part_edges(spark, sf_dir)
    name = lambda c: F.when(F.col(c) % 2 == 0, F.concat(F.lit("C#"), F.col(c).cast("string"))).otherwise(F.concat(F.lit("T"), F.col(c).cast("string")))
    return K.knowledge_vertices(e.select(name("src").alias("src"), name("dst").alias("dst")))


def k12_evicted(spark, sf_dir):
    return K.evicted(part_edges(spark, sf_dir), spark.createDataFrame([(0,), (3,)], "class long"), F.col("src") % 5)


def _modules(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    old = c.select(F.concat(F.lit("g:a"), (F.col("c_custkey") % 50).cast("string")).alias("module_key"), F.col("c_custkey").cast("string").alias("version"), F.when(F.col("c_nationkey") % 2 == 0, "EXTERNAL").otherwise("INDEXED").alias("status"))
    new = s.select(F.concat(F.lit("g:a"), F.col("s_suppkey").cast("string")).alias("module_key"), F.lit("9").alias("version"), F.when(F.col("s_suppkey") % 3 == 0, "INDEXED").otherwise("EXTERNAL").alias("status"))
    return old, new


_MODS = "old AS (SELECT 'g:a' || (c_custkey % 50) AS module_key, c_custkey::VARCHAR AS version, CASE WHEN c_nationkey % 2 = 0 THEN 'EXTERNAL' ELSE 'INDEXED' END AS status, 0 AS o FROM customer), new AS (SELECT 'g:a' || s_suppkey AS module_key, '9' AS version, CASE WHEN s_suppkey % 3 = 0 THEN 'INDEXED' ELSE 'EXTERNAL' END AS status, 1 AS o FROM supplier)"


def k13_modules(spark, sf_dir):
    return K.upserted(*_modules(spark, sf_dir))


def k13_dependencies(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    row = lambda d, v: d.select((F.col("o_custkey") % 20).alias("src"), (F.col("o_orderkey") % 20).alias("dst"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("scope"), v.alias("declared_version"))
    return K.dependencies(row(o.where("o_orderkey % 2 = 0"), F.lit(None).cast("string")), row(o.where("o_orderkey % 2 = 1"), F.col("o_orderpriority")))


def k14_linked_modules(spark, sf_dir):
    m = _modules(spark, sf_dir)[0].groupBy("module_key").agg(F.min("status").alias("status")).withColumn("project", F.lit(None).cast("string"))
    p = table(spark, sf_dir, "supplier").select(F.lit("g").alias("group_id"), F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("artifact_id"), F.col("s_name").alias("project"))
    return K.linked_modules(m, p)


def k15_cache(spark, sf_dir):
    """Vectors of all texts, a third of them from a cache."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("javadoc").alias("text"))
    cache = d.where("id % 3 = 0").select(F.sha2("text", 256).alias("key"), K.hashing_embedder(F.col("text")).alias("vec")).dropDuplicates(["key"])
    return K.cached(d, cache, K.hashing_embedder(F.col("text"))).select("id", F.size("vec").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def _models(spark, sf_dir):
    """The stored vectors as those of a first model, and vectors of lengths as those of a second, a tenth of them there
    already."""
    e = table(spark, sf_dir, "embeddings").select(F.lit("m1").alias("model"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("body").alias("text"))
    had = texts.where("id % 10 = 0").select(F.lit("m2").alias("model"), "id", F.array(F.lit(0.5), F.lit(0.5)).alias("vec"))
    embed = F.array(F.length("text").cast("double"), F.lit(1.0))
    return K.with_model(e.unionByName(had), texts, "m2", embed), texts


def k16_second_model(spark, sf_dir):
    """A second model's vectors beside the first's."""
    return _models(spark, sf_dir)[0].select("model", "id", F.size("vec").alias("dims"), F.round(F.get("vec", F.lit(0)), 6).alias("first"))


def k17_backfill(spark, sf_dir):
    """A cache made of the vectors of both models, by text."""
    out = K.backfilled(*_models(spark, sf_dir))
    return out.select("model", "key", F.size("vec").alias("dims"), F.round(F.get("vec", F.lit(0)), 6).alias("first"))


def k18_invalidated(spark, sf_dir):
    old = _snapshots(spark, sf_dir)[0].withColumn("path", F.concat("path", F.when(F.col("chunking_version") == 1, ".md").otherwise(".java")))
    return K.invalidated(old, "docs").select("path", "model_fingerprint")


def k19_usage_log(spark, sf_dir):
    """Events appended to a JSON log in two writes and read back."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    folder = f"{shared_dir(spark).rstrip('/')}/usage-{uuid.uuid4().hex}"
    for half in (0, 1):
        e.where(F.col("user_id") % 2 == half).write.mode("append").json(folder)
    out = checkpointed(spark.read.schema("user_id long, event_type string, event_id long").json(folder))
    deleted(spark, folder)
    return out


_MODELS = "models AS (SELECT 'm1' AS model, vec_id AS id, len(embedding)::INTEGER AS dims, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings UNION ALL SELECT 'm2', doc_id, 2, CASE WHEN doc_id % 10 = 0 THEN 0.5 ELSE length(coalesce(text, '')) END::DOUBLE FROM documents)"


def oracle_sql() -> dict[str, str]:
    has = "doc_id % 17 <> 0"
    return {
        "k19_usage_log": "SELECT user_id, event_type, event_id FROM events",
        "k2_incremental": f"WITH {_SNAP}, f AS (SELECT doc_id, path, text FROM d JOIN documents USING (doc_id)) SELECT path, CASE WHEN ({has}) AND doc_id % 7 <> 0 THEN 1 WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 2 ELSE 1 END::BIGINT AS mtime_ms, CASE WHEN doc_id % 7 = 0 THEN sha256(coalesce(text, '') || 'x') ELSE sha256(coalesce(text, '')) END AS sha256 FROM f WHERE doc_id % 13 <> 0",
        "k3_dirty": f"WITH {_SNAP} SELECT path FROM d WHERE doc_id % 13 <> 0 AND (doc_id % 17 = 0 OR doc_id % 7 = 0)",
        "k4_outdated": f"WITH {_SNAP} SELECT path FROM d WHERE {has} AND (doc_id % 3 <> 1 OR doc_id % 4 <> 0)",
        "k5_deleted": f"WITH {_SNAP} SELECT path FROM d WHERE {has} AND doc_id % 13 = 0 AND doc_id % 5 <> 0",
        "k6_documents": f"WITH {DOCS} SELECT doc_id, project, name, class_name, doc_type, class_type, access, file_path FROM docs",
        "k7_call_fields": f"WITH {EDGES} SELECT dst AS node, count(*) AS in_degree, string_agg(DISTINCT p_brand, ' ' ORDER BY p_brand) AS callers FROM edges LEFT JOIN part ON p_partkey = src GROUP BY dst",
        "k8_class_bodies": "SELECT p_brand AS class, sha256(string_agg(p_name, chr(10) ORDER BY p_partkey)) AS digest FROM part GROUP BY p_brand",
        "k9_removed_project": "SELECT source AS project, count(*) AS n FROM documents WHERE source IS DISTINCT FROM 'src1' GROUP BY source",
        "k10_stubs": f"WITH {EDGES}, own AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 3 <> 0) SELECT node, TRUE AS owned FROM own UNION ALL SELECT DISTINCT dst, FALSE FROM edges WHERE dst NOT IN (SELECT node FROM own)",
        "k11_vertices": f"WITH {EDGES}, n AS (SELECT src AS k FROM edges UNION SELECT dst FROM edges) SELECT CASE WHEN k % 2 = 0 THEN 'C#' || k ELSE 'T' || k END AS node, CASE WHEN k % 2 = 0 THEN 'Method' ELSE 'CodeType' END AS kind FROM n",
        "k12_evicted": f"WITH {EDGES} SELECT src, dst FROM edges WHERE src % 5 NOT IN (0, 3)",
        "k13_modules": f"WITH {_MODS} SELECT module_key, version, status FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY module_key ORDER BY (status = 'INDEXED') DESC, o, version) = 1",
        "k13_dependencies": "WITH r AS (SELECT o_custkey % 20 AS src, o_orderkey % 20 AS dst, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE 'compile' END AS scope, CASE WHEN o_orderkey % 2 = 0 THEN 'unknown' ELSE o_orderpriority END AS declared_version, o_orderkey % 2 AS o FROM orders) SELECT src, dst, scope, declared_version FROM r QUALIFY row_number() OVER (PARTITION BY src, dst, scope ORDER BY o, declared_version) = 1",
        "k14_linked_modules": f"WITH {_MODS}, m AS (SELECT module_key, min(status) AS status FROM old GROUP BY module_key), p AS (SELECT 'g:a' || s_suppkey AS module_key, s_name FROM supplier) SELECT m.module_key, CASE WHEN s_name IS NOT NULL THEN 'INDEXED' ELSE status END AS status, s_name AS project FROM m LEFT JOIN p USING (module_key)",
        "k15_cache": f"WITH {DOCS} SELECT doc_id AS id, 16 AS dims, CASE WHEN len({sql_tokens('javadoc')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM docs",
        "k16_second_model": f"WITH {_MODELS} SELECT model, id, dims, first FROM models",
        "k17_backfill": f"WITH {_MODELS} SELECT model, sha256(coalesce(text, '')) AS key, arg_min(dims, id) AS dims, arg_min(first, id) AS first FROM models JOIN documents ON doc_id = id GROUP BY ALL",
        "k18_invalidated": f"WITH {_SNAP} SELECT path || CASE WHEN doc_id % 3 = 1 THEN '.md' ELSE '.java' END AS path, CASE WHEN doc_id % 3 <> 1 THEN CASE doc_id % 4 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' END END AS model_fingerprint FROM d WHERE {has}",
    }


def queries():
    return {n: f for n, f in globals().items() if n[0] == "k" and n[1:2].isdigit()}
