"""Graph operators over edge tables (src, dst[, edge_type]).

Traversal goes hop by hop: one join for each depth, each hop's new nodes kept in the shared folder once. Nodes keep their
least depth; caps keep the first nodes by (depth, node). Only the count of new nodes reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequery.session import checkpointed, parts

SUBTYPE = ("inherits", "implements_iface")


def steps_of(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b): steps from a to b along calls (callees), against them (callers), or both; repeats stay."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"callees": out, "callers": back, "both": out.unionByName(back)}[direction]


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """The steps (a, b), once each."""
    return steps_of(edges, direction).distinct()


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str) -> DataFrame:
    """(node, other): direct neighbours of each of ``nodes`` (node)."""
    # repeats go after the join, from the few rows that are left
    return steps_of(edges, direction).join(nodes.select(F.col("node").alias("a")).distinct(), "a").select(F.col("a").alias("node"), F.col("b").alias("other")).distinct()


def bfs(edges: DataFrame, roots: DataFrame, max_depth: int | None, direction: str = "callees") -> DataFrame:
    """(root, node, depth): least depths from each of ``roots`` (root), the root itself at 0; to the end if max_depth is None."""
    steps = checkpointed(steps_of(edges, direction))  # each hop drops repeats from what it reaches, so no task holds all steps
    front = checkpointed(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    hops = Hops(front)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = front.join(steps, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        new = reached.join(hops.all().select("root", "node"), ["root", "node"], "left_anti")
        front = checkpointed(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        hops.add(front)
    return hops.all()


class Hops:
    """The kept tables of a traversal's hops. Sixteen are merged into one, so that a long walk has a short plan and a row
    is written a few times at most."""

    def __init__(self, first: DataFrame, width: int = 16) -> None:
        self.tables, self.width = [[first]], width

    def add(self, hop: DataFrame, level: int = 0) -> None:
        if level == len(self.tables):
            self.tables.append([])
        self.tables[level].append(hop)
        if len(self.tables[level]) > self.width:
            merged = checkpointed(reduce(DataFrame.unionByName, self.tables[level]))
            self.tables[level] = []
            self.add(merged, level + 1)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (t for level in self.tables for t in level))


def capped(reached: DataFrame, most: int, root_counts: bool = True) -> DataFrame:
    """The first ``most`` nodes of each root by (depth, node), and whether more were reached."""
    rows = reached if root_counts else reached.where("depth > 0")
    w = Window.partitionBy("root")
    rows = rows.withColumn("_k", F.row_number().over(w.orderBy("depth", "node"))).withColumn("truncated", F.count("*").over(w) > most)
    return rows.where(F.col("_k") <= most).drop("_k")


def traced(edges: DataFrame, roots: DataFrame, bodies: DataFrame, depth: int = 2, most: int = 50, shown: int = 500) -> DataFrame:
    """The call chain below each root with bodies (node, body) shortened, and all callees of each node."""
    rows = capped(bfs(edges, roots, depth), most)
    children = directed(edges, "callees").groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_set("b")).alias("children"))
    none = F.array().cast(children.schema["children"].dataType)
    return rows.join(bodies.select("node", F.substring("body", 1, shown).alias("body")), "node", "left").join(children, "node", "left").withColumn("children", F.coalesce("children", none))


def impact(edges: DataFrame, roots: DataFrame, depth: int = 5, most: int = 2000) -> DataFrame:
    """Transitive callers of each root."""
    return capped(bfs(edges, roots, depth, "callers"), most, root_counts=False)


def shortest_path(edges: DataFrame, pairs: DataFrame, max_depth: int = 32) -> DataFrame:
    """(src, dst, path): of the shortest paths between ``pairs`` (src, dst) the least; no row without one."""
    steps = checkpointed(directed(edges, "callees"))
    nodes = steps.select(F.col("a").alias("n")).unionByName(steps.select("b").withColumnRenamed("b", "n")).distinct()
    ends = pairs.join(nodes.withColumnRenamed("n", "src"), "src", "left_semi").join(nodes.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    front = checkpointed(ends.select("src", F.col("src").alias("node"), F.array("src").alias("path")).distinct())
    hops = Hops(front.select("src", "node"))
    found = checkpointed(front.join(ends, (front.src == ends.src) & (front.node == ends.dst)).select(front.src, "dst", "path"))
    for _ in range(max_depth):
        open_ = ends.join(found, ["src", "dst"], "left_anti").select("src").distinct()
        reached = front.join(open_, "src", "left_semi").join(steps, F.col("node") == F.col("a")).select("src", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        new = reached.join(hops.all(), ["src", "node"], "left_anti").groupBy("src", "node").agg(F.min("path").alias("path"))
        front = checkpointed(new)
        if front.isEmpty():
            break
        hops.add(front.select("src", "node"))
        hit = front.join(ends, (front.src == ends.src) & (front.node == ends.dst)).select(front.src, "dst", "path")
        found = checkpointed(found.unionByName(hit))
    return found


def called_targets(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of ``candidates`` (node) those that something calls: one pass over the edges."""
    return candidates.join(edges.select(F.col("dst").alias("node")), "node", "left_semi")


def subtypes(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): all types below, along inheritance and implementation, without the root."""
    return bfs(edges.where(F.col("edge_type").isin(*SUBTYPE)), roots, None, "callers").where("depth > 0 AND node <> root")


def usages(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, kind, user): everything that points at each node, by kind of edge."""
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("node"), F.col("edge_type").alias("kind"), F.col("src").alias("user")).distinct()


def class_rollup(edges: DataFrame, owner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class edges (src, dst, n) and classes (class, in_degree, methods, external) of method edges; ``owner`` is (node, class)."""
    o = lambda side: owner.select(F.col("node").alias(side), F.col("class").alias(f"{side}_class"))
    rows = edges.join(o("src"), "src", "left").join(o("dst"), "dst", "left").where("src_class IS NOT NULL AND dst_class IS NOT NULL AND src_class <> dst_class")
    links = rows.groupBy(F.col("src_class").alias("src"), F.col("dst_class").alias("dst")).agg(F.count("*").alias("n"))
    methods = owner.groupBy("class").agg(F.count("*").alias("methods"))
    degree = links.groupBy(F.col("dst").alias("class")).agg(F.count("*").alias("in_degree"))
    return links, methods.join(degree, "class", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))


def induced(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes of the highest in-degree (node, in_degree) and the edges among them."""
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("in_degree"))
    top = degree.orderBy(F.desc("in_degree"), "node").limit(most)
    keep = lambda side: top.select(F.col("node").alias(side))
    return top, edges.join(keep("src"), "src", "left_semi").join(keep("dst"), "dst", "left_semi").select("src", "dst").distinct()


def linked(refs: DataFrame, methods: DataFrame) -> DataFrame:
    """Unresolved references joined to their best candidate in another project.

    ``refs``: (project, caller, name, receiver, arity, package_hint); ``methods``: (project, fqn, name, class, package,
    arity). Where a package hint fits any candidate, only those that it fits count; then two points for the receiver's
    class and one for a positive arity; then the shortest and least fqn.
    """
    c = methods.select(
        F.col("project").alias("to_project"), "fqn", F.col("name").alias("c_name"), "class", "package",
        F.col("arity").alias("c_arity"),
    )
    # What is alike in all that counts meets once; a name like get or toString has many callers and many methods.
    kinds = ["project", "name", "receiver", "arity", "package_hint"]
    asked = refs.select(*kinds).distinct()
    c = c.groupBy("to_project", "c_name", "class", "package", "c_arity").agg(F.min(F.struct(F.length("fqn").alias("length"), "fqn")).alias("c"))
    pairs = asked.join(c, (F.col("name") == F.col("c_name")) & (F.col("project") != F.col("to_project")))
    fits = F.coalesce(F.startswith("package", "package_hint"), F.lit(False))
    points = F.when(F.col("class") == F.col("receiver"), 2).otherwise(0) + F.when((F.col("arity") > 0) & (F.col("arity") == F.col("c_arity")), 1).otherwise(0)
    # One that fits is before any that does not, so the least of this order is the best: no task sorts a key's candidates.
    best = F.min(F.struct((~fits).alias("misfit"), (-points).alias("loss"), "c.length", "c.fqn")).alias("best")
    rows = pairs.groupBy(*kinds, "to_project").agg(best)
    rows = rows.select(*(F.col(k).alias(f"_{k}") for k in kinds), "to_project", "best.fqn", (-F.col("best.loss")).alias("points"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in kinds))
    out = ["project", "caller", "name", "receiver", "arity", "to_project", "fqn", "points"]
    n = parts(refs.sparkSession, refs.count())
    return refs.join(rows, same).select(*out).repartition(n, *out).distinct()


def package_hint(imports, name):
    """The package of the first import that ends in a class's name."""
    hit = F.get(F.filter(imports, lambda i: F.endswith(i, F.concat(F.lit("."), name))), F.lit(0))
    return F.regexp_replace(hit, r"\.[^.]*$", "")


def module_listing(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """Modules with the numbers of what they need and what needs them."""
    needs = deps.groupBy(F.col("src").alias("module_key")).agg(F.countDistinct("dst").alias("needs"))
    used = deps.groupBy(F.col("dst").alias("module_key")).agg(F.countDistinct("src").alias("used_by"))
    return modules.join(needs, "module_key", "left").join(used, "module_key", "left").fillna(0, ["needs", "used_by"])


def boundary(own: DataFrame, cross: DataFrame, unresolved: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(entries, exits): own methods (node) that linked projects call, and the first unresolved references with their
    total."""
    entries = own.join(cross.select(F.col("dst").alias("node")), "node", "left_semi")
    exits = unresolved.orderBy("caller", "name").limit(most).withColumn("total", F.lit(unresolved.count()).cast("long"))
    return entries, exits


def stamps(edges: DataFrame) -> DataFrame:
    """(edge_type, edges, stamp): sums over hashes of all edges, so that any edge added, removed or changed shows."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(">", "src", "dst")), 1, 12), 16, 10).cast("decimal(38,0)")
    return edges.groupBy("edge_type").agg(F.count("*").alias("edges"), F.sum(digits).cast("string").alias("stamp"))


def symmetric(links: DataFrame) -> DataFrame:
    """Project links (a, b) both ways, once."""
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
