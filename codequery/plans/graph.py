"""Queries of the graph operators over parts that follow each other, regions and nations, and page links."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequery.operators import graph as G
from codequery.plans.views import EDGES, part_edges, table

ROOTS = (1, 17)


def _roots(spark):
    return spark.createDataFrame([(r,) for r in ROOTS], "root long")


def g1_callers_callees(spark, sf_dir):
    e, n = part_edges(spark, sf_dir), _roots(spark).withColumnRenamed("root", "node")
    side = lambda d: G.neighbours(e, n, d).withColumn("direction", F.lit(d))
    return side("callers").unionByName(side("callees"))


def g2_callers_with_documents(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("other"), F.col("p_name").alias("name"))
    out = G.neighbours(part_edges(spark, sf_dir), _roots(spark).withColumnRenamed("root", "node"), "callers").join(p, "other", "left")
    return out.select("node", "other", "name")


def g3_bfs(spark, sf_dir):
    return G.bfs(part_edges(spark, sf_dir), _roots(spark), 2, "both")


def g3_bfs_capped(spark, sf_dir):
    return G.capped(G.bfs(part_edges(spark, sf_dir), _roots(spark), 2), 50)


def g4_trace(spark, sf_dir):
    bodies = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("body"))
    out = G.traced(part_edges(spark, sf_dir), _roots(spark), bodies, 2, 50, 8)
    return out.select("root", "node", "depth", "truncated", "body", F.size("children").alias("n_children"), F.array_min("children").alias("first_child"))


def g5_impact(spark, sf_dir):
    return G.impact(part_edges(spark, sf_dir), _roots(spark), 2, 120)


def g6_shortest_path(spark, sf_dir):
    pairs = spark.createDataFrame([(1, 2), (1, 17), (17, 17), (5, 60), (1, 10**9)], "src long, dst long")
    return G.shortest_path(part_edges(spark, sf_dir), pairs, 8).select("src", "dst", F.array_join("path", ">").alias("path"))


def g7_called_targets(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("node"))
    return G.called_targets(part_edges(spark, sf_dir), parts)


def g8_counts(spark, sf_dir):
    e = part_edges(spark, sf_dir)
    return e.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("callers"), F.countDistinct("dst").alias("callees"))


def _types(spark, sf_dir):
    """Suppliers below nations below regions, as a hierarchy of types."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = n.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("inherits").alias("edge_type"))
    return one.unionByName(s.select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"), F.lit("implements_iface").alias("edge_type")))


def g9_direct_subtypes(spark, sf_dir):
    return _types(spark, sf_dir).where("dst IN ('r0', 'n3')").select(F.col("dst").alias("type"), F.col("src").alias("subtype"), "edge_type")


def g10_subtypes(spark, sf_dir):
    return G.subtypes(_types(spark, sf_dir), spark.createDataFrame([("r0",), ("n3",)], "root string"))


def _knowledge(spark, sf_dir):
    """Edges of several kinds among orders' fields: customers read, parts write, suppliers declare."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    reads = o.select(key("c", "o_custkey").alias("src"), key("p", "o_orderpriority").alias("dst"), F.lit("reads_field").alias("edge_type"))
    writes = o.select(key("c", "o_custkey").alias("src"), key("p", "o_orderstatus").alias("dst"), F.lit("writes_field").alias("edge_type"))
    takes = li.select(key("s", "l_suppkey").alias("src"), key("p", "l_returnflag").alias("dst"), F.lit("takes_type").alias("edge_type"))
    return reads.unionByName(writes).unionByName(takes)


def g11_field_access(spark, sf_dir):
    e = _knowledge(spark, sf_dir).where("edge_type IN ('reads_field', 'writes_field')").distinct()
    return e.groupBy(F.col("dst").alias("field"), "edge_type").agg(F.count("*").alias("methods"), F.min("src").alias("first_method"))


def g12_types_of_methods(spark, sf_dir):
    return _knowledge(spark, sf_dir).where("edge_type = 'takes_type' AND dst = 'pR'").select("src").distinct()


def g13_usages(spark, sf_dir):
    return G.usages(_knowledge(spark, sf_dir), spark.createDataFrame([("pF",), ("pR",), ("p1-URGENT",)], "node string"))


def g14_class_context(spark, sf_dir):
    """Nations as classes: their suppliers as members, customers as callers, ten at most."""
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    members = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("members"))
    first = F.slice(F.array_sort(F.collect_list("c_name")), 1, 10)
    callers = c.groupBy(F.col("c_nationkey").alias("j")).agg(F.array_join(first, ",").alias("callers"), F.count("*").alias("n_callers"))
    return n.join(members, F.col("n_nationkey") == F.col("k"), "left").join(callers, F.col("n_nationkey") == F.col("j"), "left").select("n_name", "members", "callers", "n_callers")


def _owner(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("class"))


def g15_class_rollup(spark, sf_dir):
    return G.class_rollup(part_edges(spark, sf_dir), _owner(spark, sf_dir))[0]


def g15_class_degrees(spark, sf_dir):
    return G.class_rollup(part_edges(spark, sf_dir), _owner(spark, sf_dir))[1]


def g16_induced_subgraph(spark, sf_dir):
    return G.induced(part_edges(spark, sf_dir), 100)[1]


def g17_cross_project_links(spark, sf_dir):
    """Customers refer to suppliers by the last digit of their key; segment, nation and region stand for receiver and package."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    refs = c.select(F.col("c_mktsegment").alias("project"), F.col("c_name").alias("caller"), (F.expr("c_custkey div 10") % 10).cast("string").alias("name"), (F.col("c_nationkey") % 5).cast("string").alias("receiver"), (F.col("c_nationkey") % 3).cast("long").alias("arity"), (F.col("c_nationkey") % 4).cast("string").alias("package_hint"))
    m = s.select(F.lit("SUPPLIERS").alias("project"), F.col("s_name").alias("fqn"), (F.col("s_suppkey") % 10).cast("string").alias("name"), (F.col("s_nationkey") % 5).cast("string").alias("class"), (F.col("s_nationkey") % 7).cast("string").alias("package"), (F.col("s_suppkey") % 3).cast("long").alias("arity"))
    return G.linked(refs, m)


def g18_freshness(spark, sf_dir):
    """A stamp of each type graph, equal as long as its edges are."""
    return G.stamps(_types(spark, sf_dir))


def _deps(spark, sf_dir):
    """Nations need their region's other nations with a larger key, two steps away at most."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("src"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k")), n.select(F.col("n_name").alias("dst"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("j"))
    return a.join(b, "r").where("j > k AND j - k <= 5").select("src", "dst")


_DEPS = "deps AS (SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b USING (n_regionkey) WHERE b.n_nationkey > a.n_nationkey AND b.n_nationkey - a.n_nationkey <= 5)"


def g20_module_dependencies(spark, sf_dir):
    d = _deps(spark, sf_dir)
    return d.select(F.col("src").alias("module"), F.col("dst").alias("other"), F.lit("needs").alias("kind")).unionByName(d.select("dst", "src", F.lit("used_by")).toDF("module", "other", "kind"))


def g21_module_closure(spark, sf_dir):
    d = _deps(spark, sf_dir)
    return G.bfs(d, d.select(F.col("src").alias("root")).distinct(), None).where("depth > 0")


def g22_module_path(spark, sf_dir):
    d = _deps(spark, sf_dir)
    return G.shortest_path(d, d.select("src", "dst"), 6).select("src", "dst", F.array_join("path", ">").alias("path"))


def g23_module_listing(spark, sf_dir):
    return G.module_listing(table(spark, sf_dir, "nation").select(F.col("n_name").alias("module_key"), F.col("n_regionkey").alias("status")), _deps(spark, sf_dir))


def g24_module_resolve(spark, sf_dir):
    """A module by key or, failing that, by project name."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = n.select(F.col("n_name").alias("q")).unionByName(r.select(F.col("r_name").alias("q"))).distinct()
    by_name = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("q")).agg(F.min("n_name").alias("first"))
    out = names.join(n.select(F.col("n_name").alias("q"), F.col("n_name").alias("key")), "q", "left").join(by_name, "q", "left")
    return out.select("q", F.coalesce("key", "first").alias("module_key"))


def g25_module_boundary(spark, sf_dir):
    own = table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("node"))
    cross = part_edges(spark, sf_dir).join(own, F.col("src") == F.col("node"), "left_anti")
    return G.boundary(own, cross, _unresolved(spark, sf_dir))[0]


def _unresolved(spark, sf_dir):
    """Parts that no order line has as their second one or later, as references to what nothing declares."""
    e = part_edges(spark, sf_dir)
    p = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("dst"))
    return e.join(p, "dst", "left_semi").select(F.lpad(F.col("src").cast("string"), 9, "0").alias("caller"), F.lpad(F.col("dst").cast("string"), 9, "0").alias("name"))


def g25_module_exits(spark, sf_dir):
    """The first unresolved references, and how many there are."""
    own = spark.createDataFrame([], "node long")
    return G.boundary(own, part_edges(spark, sf_dir), _unresolved(spark, sf_dir))[1]


def g26_project_links(spark, sf_dir):
    return G.symmetric(_deps(spark, sf_dir).toDF("a", "b"))


_BFS = """{name} AS (
  SELECT root, node, min(depth) AS depth FROM (
    WITH RECURSIVE t AS (SELECT root, root AS node, 0 AS depth FROM (VALUES {roots}) v(root) UNION SELECT root, b, depth + 1 FROM t JOIN {steps} ON node = a WHERE depth < {depth})
    SELECT * FROM t) GROUP BY root, node)"""
_OUT = "(SELECT src AS a, dst AS b FROM edges)"
_BACK = "(SELECT dst AS a, src AS b FROM edges)"
_TYPES = "types AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'inherits' AS edge_type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'implements_iface' FROM supplier)"
_KNOWN = "known AS (SELECT 'c' || o_custkey AS src, 'p' || o_orderpriority AS dst, 'reads_field' AS edge_type FROM orders UNION ALL SELECT 'c' || o_custkey, 'p' || o_orderstatus, 'writes_field' FROM orders UNION ALL SELECT 's' || l_suppkey, 'p' || l_returnflag, 'takes_type' FROM lineitem)"


def _bfs(steps: str, depth: int, roots=ROOTS, name: str = "found") -> str:
    return _BFS.format(name=name, roots=", ".join(f"({r}::BIGINT)" if isinstance(r, int) else f"('{r}')" for r in roots), steps=steps, depth=depth)


def _capped(most: int, where: str = "TRUE") -> str:
    return f"SELECT root, node, depth, truncated FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS k, count(*) OVER (PARTITION BY root) > {most} AS truncated FROM found WHERE {where}) WHERE k <= {most}"


def _path(steps: str, pairs: str, depth: int, join: str) -> str:
    return f"""w AS (WITH RECURSIVE t AS (SELECT DISTINCT p.src, p.src AS node, [p.src] AS path, 0 AS d FROM {pairs} p UNION ALL
  SELECT src, node, min(path), d FROM (SELECT t.src, b AS node, list_append(t.path, b) AS path, t.d + 1 AS d FROM t JOIN {steps} ON t.node = a WHERE t.d < {depth}) GROUP BY src, node, d) SELECT * FROM t)
SELECT p.src, p.dst, array_to_string(arg_min(path, (d, path)), '>') AS path FROM {pairs} p JOIN w ON w.src = p.src AND w.node = p.dst {join} GROUP BY p.src, p.dst"""


def oracle_sql() -> dict[str, str]:
    roots = f"({', '.join(map(str, ROOTS))})"
    refs = "refs AS (SELECT c_mktsegment AS project, c_name AS caller, ((c_custkey // 10) % 10)::VARCHAR AS name, (c_nationkey % 5)::VARCHAR AS receiver, (c_nationkey % 3)::BIGINT AS arity, (c_nationkey % 4)::VARCHAR AS hint FROM customer)"
    m = "m AS (SELECT 'SUPPLIERS' AS to_project, s_name AS fqn, (s_suppkey % 10)::VARCHAR AS c_name, (s_nationkey % 5)::VARCHAR AS class, (s_nationkey % 7)::VARCHAR AS package, (s_suppkey % 3)::BIGINT AS c_arity FROM supplier)"
    both = "(SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"
    walk = "(SELECT src AS a, dst AS b FROM deps)"
    closure = "WITH " + _DEPS + ", t AS (WITH RECURSIVE x AS (SELECT DISTINCT src AS root, src AS node, 0 AS depth FROM deps UNION SELECT root, dst, depth + 1 FROM x JOIN deps ON node = src WHERE depth < 25) SELECT * FROM x) SELECT root, node, min(depth) AS depth FROM t GROUP BY root, node HAVING min(depth) > 0"
    return {
        "g1_callers_callees": f"WITH {EDGES} SELECT dst AS node, src AS other, 'callers' AS direction FROM edges WHERE dst IN {roots} UNION ALL SELECT src, dst, 'callees' FROM edges WHERE src IN {roots}",
        "g2_callers_with_documents": f"WITH {EDGES} SELECT dst AS node, src AS other, p_name AS name FROM edges LEFT JOIN part ON p_partkey = src WHERE dst IN {roots}",
        "g3_bfs": f"WITH {EDGES}, {_bfs(both, 2)} SELECT * FROM found",
        "g3_bfs_capped": f"WITH {EDGES}, {_bfs(_OUT, 2)} {_capped(50)}",
        "g4_trace": f"WITH {EDGES}, {_bfs(_OUT, 2)}, c AS ({_capped(50)}), k AS (SELECT src, count(*) AS n, min(dst) AS f FROM edges GROUP BY src) SELECT root, node, depth, truncated, substr(p_name, 1, 8) AS body, coalesce(n, 0)::INTEGER AS n_children, f AS first_child FROM c LEFT JOIN part ON p_partkey = node LEFT JOIN k ON k.src = node",
        "g5_impact": f"WITH {EDGES}, {_bfs(_BACK, 2)} {_capped(120, 'depth > 0')}",
        "g6_shortest_path": f"WITH {EDGES}, pairs AS (SELECT * FROM (VALUES (1, 2), (1, 17), (17, 17), (5, 60), (1, 1000000000)) v(src, dst) WHERE dst IN (SELECT src FROM edges UNION SELECT dst FROM edges)), p AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM pairs), "
        + _path(_OUT, "p", 4, ""),
        "g7_called_targets": f"WITH {EDGES} SELECT p_partkey AS node FROM part WHERE p_size <= 10 AND p_partkey IN (SELECT dst FROM edges)",
        "g8_counts": f"WITH {EDGES} SELECT count(*) AS edges, count(DISTINCT src) AS callers, count(DISTINCT dst) AS callees FROM edges",
        "g9_direct_subtypes": f"WITH {_TYPES} SELECT dst AS type, src AS subtype, edge_type FROM types WHERE dst IN ('r0', 'n3')",
        "g10_subtypes": f"WITH {_TYPES}, {_bfs('(SELECT dst AS a, src AS b FROM types)', 9, ('r0', 'n3'))} SELECT * FROM found WHERE depth > 0",
        "g11_field_access": f"WITH {_KNOWN} SELECT dst AS field, edge_type, count(DISTINCT src) AS methods, min(src) AS first_method FROM known WHERE edge_type <> 'takes_type' GROUP BY ALL",
        "g12_types_of_methods": f"WITH {_KNOWN} SELECT DISTINCT src FROM known WHERE edge_type = 'takes_type' AND dst = 'pR'",
        "g13_usages": f"WITH {_KNOWN} SELECT DISTINCT dst AS node, edge_type AS kind, src AS user FROM known WHERE dst IN ('pF', 'pR', 'p1-URGENT')",
        "g14_class_context": "SELECT n_name, (SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS members, (SELECT string_agg(c_name, ',' ORDER BY c_name) FROM (SELECT c_name FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_name LIMIT 10)) AS callers, nullif((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey), 0) AS n_callers FROM nation",
        "g15_class_rollup": f"WITH {EDGES} SELECT a.p_brand AS src, b.p_brand AS dst, count(*) AS n FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY ALL",
        "g15_class_degrees": f"WITH {EDGES}, l AS (SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand), d AS (SELECT dst, count(*) AS n FROM l GROUP BY dst) SELECT p_brand AS class, count(*) AS methods, coalesce(max(n), 0) AS in_degree FROM part LEFT JOIN d ON dst = p_brand GROUP BY p_brand",
        "g16_induced_subgraph": f"WITH {EDGES}, t AS (SELECT dst AS node FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 100) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)",
        "g17_cross_project_links": f"WITH {refs}, {m}, p AS (SELECT *, starts_with(package, hint) AS fits FROM refs JOIN m ON name = c_name), a AS (SELECT *, bool_or(fits) OVER (PARTITION BY project, caller, name, receiver, arity, to_project) AS anyfit FROM p), s AS (SELECT *, (CASE WHEN class = receiver THEN 2 ELSE 0 END + CASE WHEN arity > 0 AND arity = c_arity THEN 1 ELSE 0 END)::INTEGER AS points FROM a WHERE fits OR NOT anyfit) SELECT project, caller, name, receiver, arity, to_project, fqn, points FROM s QUALIFY row_number() OVER (PARTITION BY project, caller, name, receiver, arity, to_project ORDER BY points DESC, length(fqn), fqn) = 1",
        "g18_freshness": f"WITH {_TYPES} SELECT edge_type, count(*) AS edges, sum(('0x' || substr(md5(src || '>' || dst), 1, 12))::BIGINT)::VARCHAR AS stamp FROM types GROUP BY edge_type",
        "g20_module_dependencies": f"WITH {_DEPS} SELECT src AS module, dst AS other, 'needs' AS kind FROM deps UNION ALL SELECT dst, src, 'used_by' FROM deps",
        "g21_module_closure": closure,
        "g22_module_path": f"WITH {_DEPS}, " + _path(walk, "deps", 6, ""),
        "g23_module_listing": f"WITH {_DEPS} SELECT n_name AS module_key, n_regionkey AS status, (SELECT count(DISTINCT dst) FROM deps WHERE src = n_name) AS needs, (SELECT count(DISTINCT src) FROM deps WHERE dst = n_name) AS used_by FROM nation",
        "g24_module_resolve": "WITH q AS (SELECT n_name AS q FROM nation UNION SELECT r_name FROM region) SELECT q, coalesce((SELECT any_value(n_name) FROM nation WHERE n_name = q), (SELECT min(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = q)) AS module_key FROM q",
        "g25_module_boundary": f"WITH {EDGES}, own AS (SELECT p_partkey AS node FROM part WHERE p_size <= 10) SELECT node FROM own WHERE node IN (SELECT dst FROM edges WHERE src NOT IN (SELECT node FROM own))",
        "g25_module_exits": f"WITH {EDGES}, u AS (SELECT lpad(src::VARCHAR, 9, '0') AS caller, lpad(dst::VARCHAR, 9, '0') AS name FROM edges WHERE dst IN (SELECT p_partkey FROM part WHERE p_size > 45)) SELECT *, (SELECT count(*) FROM u) AS total FROM u ORDER BY caller, name LIMIT 200",
        "g26_project_links": f"WITH {_DEPS} SELECT src AS a, dst AS b FROM deps UNION SELECT dst, src FROM deps",
    }


def queries():
    return {n: f for n, f in globals().items() if n[0] == "g" and n[1:2].isdigit()}
