"""Nearest neighbours by a block matrix join of int8 products with quantisation error bounds.

Vectors are quantised to int8 with a scale each and packed into blocks. Every block of queries meets every block of
candidates at one cell of a grid. There one matrix product of the int8 values (whole numbers, exact in float32 up to
1,024 dimensions, in float64 beyond) gives approximate products for all pairs, and
``|<q, c> - <q', c'>| <= |q - q'| |c'| + |q| |c - c'|`` bounds their errors. A pair survives if its upper bound
reaches the k-th largest lower bound of its query; survivors are recomputed in double precision, dimension by
dimension, and kept in a heap for each query. The heaps' contents of all cells of a query are merged last. The
result is exact: a pair that does not survive has k better ones. Norms are taken of vectors scaled to one, and pairs
whose products may leave the range of doubles survive without a bound.

Edge cases: vectors that are null, empty, zero or hold a null, NaN or infinity take no part; vectors meet only those
of their own dimension; every row is a candidate, also rows that share an id, but a query's own id is none of its
candidates; a query id that occurs more than once asks once, with its least vector; null ids take no part, nor do pairs
whose product is no number; ties go to the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequery.llm._support import checkpointed

NEAREST, EVERY = 20, 20
#: Rows of a block: at least, and at most. In between, a dozen candidate blocks or more share the work.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1_024, 32_768, 24
#: Rows of a tile of the product that is held at once.
TILE = 2_048
#: What products are off by at the small end, and the logarithm of norms' products from which they may overflow.
TINY, MOST_LOG2 = 1e-300, 1000.0


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL").where(fine)


def _norm(x: np.ndarray) -> np.ndarray:
    """The norms of the rows of x, whatever their size."""
    top = np.abs(x).max(1)
    top[top == 0] = 1.0
    with np.errstate(over="ignore"):
        return np.linalg.norm(x / top[:, None], axis=1) * top


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their scales, the norms of the rounded vectors and of the errors, for the rows of x (double)."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = np.finfo(float).tiny  # a subnormal vector
    whole = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    near = whole * scale[:, None]
    return whole, scale, _norm(near), _norm(x - near)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, added up dimension by dimension."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, product) of each query's k best candidates."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    q8, qs, q_norm, q_off = quantised(q)
    whole = np.float32 if q.shape[1] <= 1024 else np.float64
    full = _norm(q)
    q8 = q8.astype(whole)
    lowest = np.full(len(q_ids), -np.inf)
    with np.errstate(all="ignore"):
        for at in range(0, len(c_ids), TILE):
            ids, part = c_ids[at : at + TILE], c[at : at + TILE]
            c8, cs, c_norm, c_off = quantised(part)
            c8 = c8.astype(whole)
            c_full = np.log2(np.maximum(c_norm + c_off, TINY))
            for row in range(0, len(q_ids), TILE):
                mine = slice(row, row + TILE)
                near = (q8[mine] @ c8.T).astype(np.float64)
                near *= qs[mine, None]
                near *= cs
                off = q_off[mine, None] * c_norm + full[mine, None] * (c_off + 1e-9 * (c_norm + c_off)) + TINY
                low, high = near - off, near + off
                large = np.log2(np.maximum(full[mine, None], TINY)) + c_full > MOST_LOG2
                if large.any():
                    low[large], high[large] = -np.inf, np.inf
                own = q_ids[mine, None] == ids
                low[own] = -np.inf
                if low.shape[1] > k:
                    bound = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
                    lowest[mine] = np.maximum(lowest[mine], bound)
                i, j = np.nonzero((high >= lowest[mine, None]) & ~own)
                i += row
                for lo in range(0, len(i), 1 << 17):
                    a, b = i[lo : lo + (1 << 17)], j[lo : lo + (1 << 17)]
                    for x, s, y in zip(a.tolist(), exact(q[a], part[b]).tolist(), (-ids[b]).tolist(), strict=True):
                        heap = heaps[x]
                        if s != s:
                            continue
                        if len(heap) < k:
                            heapq.heappush(heap, (s, y))
                        elif (s, y) > heap[0]:
                            heapq.heapreplace(heap, (s, y))
                full_heaps = [x for x in range(row, min(row + TILE, len(q_ids))) if len(heaps[x]) == k]
                lowest[full_heaps] = np.maximum(lowest[full_heaps], [heaps[x][0][0] for x in full_heaps])
    flat = [(i, -y, s) for i, heap in zip(q_ids.tolist(), heaps, strict=True) for s, y in heap]
    one, two, three = zip(*flat, strict=True) if flat else ((), (), ())
    return np.array(one, np.int64), np.array(two, np.int64), np.array(three, np.float64)


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id, v) as blocks (dim, ids, vectors) of up to ``most`` rows of one dimension, made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            raw = [pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *raw], ["dim", "ids", "vectors"])

        for b in batches:
            ids, column = b.column(0).to_numpy(), b.column(1)
            starts, flat = column.offsets.to_numpy()[:-1], column.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(column.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                for lo in range(0, len(at), most):
                    some = at[lo : lo + most]
                    if sum(len(x[0]) for x in held.get(dim, [])) + len(some) > most:
                        yield block(dim)
                    held.setdefault(dim, []).append((ids[some], flat[starts[some][:, None] + np.arange(dim)]))
        for dim in list(held):
            yield block(dim)

    return rows.select("id", "v").mapInArrow(run, "dim int, ids binary, vectors binary")


def nearest(df: DataFrame, k: int = NEAREST, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by ``every``."""
    rows = checkpointed(usable(df, id_col, vector_col))
    n = rows.count()
    most = min(max(n // BLOCKS, LEAST_BLOCK), MOST_BLOCK)
    spread = max(1, -(-n // most))
    candidates = _packed(rows.repartition(spread, "id"), most)
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = _packed(asked.repartition(max(1, spread // every), "id"), most)
    # A grid of cells: a block of candidates has one row of it and goes to every column, a block of queries the other way
    # about. So many rows and columns, as many cells as candidate blocks, copy the least where queries are 1 in ``every``.
    across = min(spread, math.ceil(math.sqrt(spread * every)))
    down = -(-spread // across)
    slot = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("h", slot(down)).withColumn("g", each(across)).withColumnsRenamed({"ids": "q_ids", "vectors": "q"})
    right = candidates.withColumn("g", slot(across)).withColumn("h", each(down)).withColumnsRenamed({"ids": "c_ids", "vectors": "c"})
    grid = left.join(right, ["g", "h", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim, *raw = (b.column(name)[r].as_py() for name in ("dim", "q_ids", "q", "c_ids", "c"))
                q_ids, q, c_ids, c = (np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.float64) * 2, strict=True))
                found = search_block(q_ids, q.reshape(-1, dim), c_ids, c.reshape(-1, dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    best = grid.select("dim", "q_ids", "q", "c_ids", "c").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
