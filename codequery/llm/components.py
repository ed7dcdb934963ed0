"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequery.llm._support import checkpointed, packed


#: The most edges that one task labels, at some 100 bytes each.
LABELLED = 1 << 21


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of some edges, by the same rounds."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(i):
        near = np.minimum(root[i], root[j])
        for end in (i, j):
            np.minimum.at(root, root[end], near)
        while (root != (jump := root[root])).any():
            root = jump
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches if b.num_rows]
        if held:
            both = np.concatenate(held, axis=1)
            made = [pa.array(x) for x in _least(both[0], both[1])]
            yield pa.RecordBatch.from_arrays(made, ["node", "root"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, rows: int | None = None, whole: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node it is linked to, directly or not.

    A round gives each node the least label among its neighbours, then the label of its label. Labels only fall, so
    the rounds end; their number grows with the logarithm of a chain's length. Each round is kept in the shared folder,
    in as many partitions as about ``rows`` edges fill (counted if not given); only counts reach the driver. A table of at
    most ``whole`` edges is labelled by one task instead, which spares the driver the jobs of the rounds. An empty table
    gives an empty one.
    """
    if whole:
        edges = checkpointed(edges.where("a <> b"))
        if edges.count() <= whole:
            return checkpointed(_in_one_task(edges))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(both.where("a <> b").distinct())
    n = both.count() if rows is None else 2 * rows
    both = packed(both, n)
    least = packed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")), n)
    labels = checkpointed(least.select("node", F.least("node", "_b").alias("root")))
    while True:
        near = packed(both.join(labels.select(F.col("node").alias("b"), "root"), "b"), n)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        low = packed(labels.join(near, "node"), n)
        low = low.select("node", F.col("root").alias("_was"), F.least("root", "_near").alias("_low"))
        # A label is a node, so its own label is at hand: one jump for each round.
        jump = labels.select(F.col("node").alias("_low"), F.col("root").alias("_next"))
        now = packed(low.join(jump, "_low"), n).select("node", "_was", F.least("_low", "_next").alias("root"))
        now = checkpointed(now)
        changed = now.where("root <> _was").limit(1).count()
        labels = now.select("node", "root")
        if not changed:
            return labels
