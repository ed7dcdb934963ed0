"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. The anchors are the words of the perfect Hamming code on its lower 63 bits: every
63-bit word is within distance 1 (the covering radius) of exactly one of the 2^57 anchors. Two fingerprints that
differ by at most two bits have a word midway, at most one bit from either, whose anchor is thus within two bits
of both. So a fingerprint is copied to every anchor within ``1 + ceil(2 / 2) = 2`` bits, 32 anchors at most, and
any linked pair meets at an anchor; radius plus the whole threshold would copy it to 652 and find the same pairs.
An anchor's ball holds at most 4,034 different fingerprints whatever the input, so comparing within an anchor is
bounded. Equal fingerprints are merged before that, and an anchor gives the edges of a spanning forest, not pairs.

Two bits catch exact copies and the lightest edits. For documents that share most of their 5-word shingles (Jaccard
similarity of 0.8 and more) the fingerprint is wider: 640 bits, so that its distance tells the similarity. Its twenty
32-bit blocks are covered each by the Hamming code on 31 bits in the same way, 16 anchors a block; a pair whose blocks
come within two bits in any of the twenty and that is near as a whole is a candidate. The whole distance is taken at
the anchor, so that what leaves an anchor is a forest of candidates that joins what all of its candidates would. A pair
of blocks so near has several anchors in common and is met at the least of them alone. Two blocks are compared first;
what they join is one group already, so that in the other eighteen only classes of different groups still meet, which
keeps a large group of near copies from meeting in every block. Candidates only gather documents into groups; within a group the exact similarity of the shingle sets decides, every pair of it. A pair of
similarity 0.8 is a candidate with a chance of about 0.92 by this arithmetic, one of 0.85 of 0.99.

Edge cases: a null or blank text has fingerprint zero, linked like any other by ``clustered``; as near-duplicates blank
texts are copies of each other and near nothing else. Fewer words than a shingle form one shingle. A null id keeps its
row, and the least id of a component leaves nulls out (null if it has no other); repeated rows share their component.
``deduplicated`` judges rows, not ids: of a group the row with the least id stays, nulls last, ties by a hash of all
columns; unlike rows that share an id or have none are judged each for itself. Texts of any length are read whole; a
group's work is dealt out by numbers of shingles. An empty table gives no rows; other columns pass through
``deduplicated`` whatever their names, and are not read by the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequery.llm._support import checkpointed, packed
from codequery.llm.components import LABELLED, components

SHINGLE, SEED, THRESHOLD = 3, 42, 2
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    grams = [words] if len(words) < size else zip(*(words[k:] for k in range(size)), strict=False)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def anchors(fp: np.ndarray, width: int = 63) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fp, flips) for every anchor within two bits of the lower ``width`` bits; fp is unsigned.

    ``width`` is one less than a power of two. Bit i - 1 of a word stands for column i of the parity check, so the
    syndrome is the xor of the set bits' numbers; a word one or two flips from the code has their numbers xor to it.
    Flips are the numbers of the bits, 0 for none, as ``i * (width + 1) + j``.
    """
    low = fp & np.uint64(2**width - 1)
    syndrome = np.zeros(len(fp), np.int64)
    for i in range(1, width + 1):
        syndrome ^= np.where((low >> np.uint64(i - 1)) & np.uint64(1), i, 0)
    bit = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(width, dtype=np.uint64))]).astype(np.uint64)
    made, index, flips = [low ^ bit[syndrome]], [np.arange(len(fp))], [syndrome * (width + 1)]
    for i in range(1, width + 1):
        # flips i and i ^ syndrome, once for each pair; neither may be the empty flip 0
        j = syndrome ^ i
        at = np.flatnonzero((syndrome != 0) & (j > i))
        made.append(low[at] ^ bit[i] ^ bit[j[at]])
        index.append(at)
        flips.append(i * (width + 1) + j[at])
    return np.concatenate(made), np.concatenate(index), np.concatenate(flips)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fp: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that join the fingerprints of one anchor as all their links would."""
    left, edges = np.arange(len(fp)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            k = todo.pop()
            near = _bits(fp[left] ^ fp[k]) <= threshold
            edges += [(k, j) for j in left[near]]
            todo += list(left[near])
            left = left[~near]
    return edges


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): edges between different fingerprints of ``distinct`` (fp) that join what links of at most ``threshold``
    <= 2 bits join."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            anchor, index, _ = anchors(fp)
            rows = [pa.array(anchor.view(np.int64)), pa.array(fp[index].view(np.int64))]
            yield pa.RecordBatch.from_arrays(rows, ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64))

        def found(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            counts = np.diff(np.r_[starts, len(anchor)])
            pairs = starts[counts == 2]
            pairs = pairs[_bits(fp[pairs] ^ fp[pairs + 1]) <= threshold]
            a, b = [fp[pairs]], [fp[pairs + 1]]
            for s, n in zip(starts[counts > 2], counts[counts > 2], strict=True):
                if edges := _forest(fp[s : s + n], threshold):
                    one, two = np.array(edges).T
                    a.append(fp[s + one])
                    b.append(fp[s + two])
            both = np.stack([np.concatenate(a), np.concatenate(b)]).view(np.int64)
            both = np.unique(np.sort(both, axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in batches:
            anchor = np.r_[held[0], batch.column(0).to_numpy()]
            fp = np.r_[held[1], batch.column(1).to_numpy().view(np.uint64)]
            if not len(anchor):
                continue
            cut = np.searchsorted(anchor, anchor[-1])  # the last anchor may go on in the next batch
            held = (anchor[cut:], fp[cut:])
            if cut:
                yield found(anchor[:cut], fp[:cut])
        if len(held[0]):
            yield found(*held)

    placed = distinct.select("fp").mapInArrow(spread, "anchor long, fp long")
    placed = placed.repartition("anchor").sortWithinPartitions("anchor")
    return placed.mapInArrow(compare, "a long, b long").distinct()


def clustered(df: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    found = checkpointed(fingerprints(df, size))
    classes = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    return _labelled_rows(found, classes, components(links(classes, threshold)), "fp").select("doc_id", "fp", "component_id")


def _labelled_rows(found: DataFrame, classes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``found`` with ``component_id``; only classes that hold several rows or are linked need a lookup, all others are
    their own."""
    near = classes.join(roots, F.col(key) == F.col("node")).select(key, "least", "root")
    lowest = near.groupBy("root").agg(F.min("least").alias("lowest"))
    alone = classes.where("n > 1").join(roots, F.col(key) == F.col("node"), "left_anti")
    alone = alone.select(key, F.col("least").alias("lowest"))
    known = checkpointed(near.join(lowest, "root").select(key, "lowest").unionByName(alone))
    known = known.select(F.col(key).alias("_key"), "lowest", F.lit(True).alias("_known"))
    out = found.join(known, F.col(key) == F.col("_key"), "left")
    return out.withColumn("component_id", F.when(F.col("_known"), F.col("lowest")).otherwise(F.col("doc_id")))


def report(df: DataFrame) -> DataFrame:
    """Fingerprint and component of every document."""
    return clustered(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- wide fingerprints -------------------------------------------------------------------------------------------------

WIDE_SHINGLE, SIMILARITY, WORDS = 5, 0.8, 10
#: Standard deviations of the measured distance that a candidate may lie beyond its similarity's.
LEEWAY = 2.0
#: Classes, and shingles, of one part of a group; two parts are compared at a time.
CELL, CELL_SHINGLES = 512, 1 << 20
#: Classes of a group of several parts that meet all of its parts first, on average.
LEADERS = 32
#: Values of the filter of texts that may matter, the bits of its broadcast; and those of one row of it.
SLOTS, SLOT_BITS = 1 << 20, 1 << 15
#: Blocks in which classes meet first.
FIRST = 2

_LANES = np.uint64(0x0101010101010101)


def shingles(text: str | None, size: int = WIDE_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [words] if len(words) < size else zip(*(words[k:] for k in range(size)), strict=False)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64))


def wide_fingerprint(text: str | None, size: int = WIDE_SHINGLE) -> np.ndarray:
    """Ten words of 64 bits over the distinct shingles of a text; zeros without a word."""
    return _wide(shingles(text, size))


def _wide(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(WORDS, np.uint64)
    ones = np.zeros((WORDS, 8, 8), np.int64)  # by word, byte and bit
    for k in range(0, len(hashes), 255 << 5):
        # one hash gives all words, each from a mix of its own
        z = hashes[k : k + (255 << 5), None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        # Eight counters side by side in each word: 255 rows at a time can't overflow a byte.
        starts = np.arange(0, len(z), 255)
        for bit in range(8):
            lanes = np.add.reduceat((z >> np.uint64(bit)) & _LANES, starts, axis=0)
            ones[:, :, bit] += lanes.view(np.uint8).reshape(len(starts), WORDS, 8).sum(0, dtype=np.int64)
    return np.packbits(2 * ones.reshape(WORDS, 64) > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def most_bits(similarity: float) -> int:
    """The distance up to which a pair is a candidate: that of sets of equal size so similar, and the leeway."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WORDS
    return round(p * n + LEEWAY * math.sqrt(n * p * (1 - p)))


def _by_key(run, width: int, drop: int = 0):
    """``run`` over the rows of whole keys: batches sorted by their first column, a long, are cut where it changes but
    for its lowest ``drop`` bits. ``run`` gets ``width`` arrays, the last being a matrix where the column is a list."""

    def column(c: pa.Array) -> np.ndarray:
        if pa.types.is_list(c.type):
            return c.flatten().to_numpy().view(np.uint64).reshape(len(c), -1)
        return c.to_numpy()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            now = [column(c) for c in b.columns[:width]]
            now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            cut = int(np.searchsorted(now[0], now[0][-1] >> drop << drop))  # the last key may go on in the next batch
            held = [x[cut:] for x in now]
            if cut:
                yield run(*(x[:cut] for x in now))
        if held:
            yield run(*held)

    return over


def _all_anchors(words: np.ndarray) -> np.ndarray:
    """The anchors of 31-bit words, sixteen a row; -1 where a word has fewer."""
    anchor, index, _ = anchors(words, 31)
    order = np.argsort(index, kind="stable")
    anchor, index = anchor[order].astype(np.int64), index[order]
    out = np.full((len(words), 16), -1, np.int64)
    out[index, np.arange(len(index)) - np.searchsorted(index, index)] = anchor
    return out


def _least_common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least anchor that each row of ``one`` and of ``two`` have in common."""
    none = np.iinfo(np.int64).max
    same = (one[:, :, None] == two[:, None, :]) & (one[:, :, None] >= 0)
    return np.where(same.any(2), one, none).min(1, initial=none)


def _meeting(classes: DataFrame, blocks: range) -> DataFrame:
    """(anchor, k): classes (k, w array, label) at each anchor of ``blocks`` where one of another label comes within two
    bits of their block, and which is the least that the two blocks have in common."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                w = b.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
                k, label = b.column(0).to_numpy(), b.column(2).to_numpy()
                for block in blocks:
                    word = (w[:, block // 2] >> np.uint64(32 * (block % 2))) & np.uint64(2**31 - 1)
                    anchor, index, flips = anchors(word, 31)
                    key = (anchor.astype(np.int64) | block << 31) << 10 | flips
                    # most classes are a label of their own: zeros, which take no room once packed
                    made = [pa.array(key), pa.array(k[index]), pa.array((k ^ label)[index])]
                    yield pa.RecordBatch.from_arrays(made, ["key", "k", "other"])

    bit = np.concatenate([[0], np.left_shift(1, np.arange(31))]).astype(np.uint64)

    def met(key: np.ndarray, k: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        some = np.diff(np.r_[first, len(key)])  # rows of each (anchor, word)
        block, flips = key[first] >> 10, key[first] & 1023
        at = block & (2**31 - 1)
        words = at.astype(np.uint64) ^ bit[flips >> 5] ^ bit[flips & 31]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        counts = np.diff(np.r_[starts, len(block)])
        low, high = np.minimum.reduceat(k ^ other, first), np.maximum.reduceat(k ^ other, first)  # labels
        unlike = np.minimum.reduceat(low, starts) != np.maximum.reduceat(high, starts)
        asked = np.flatnonzero((low != high) | np.repeat((counts > 1) & unlike, counts))
        of = np.full(len(words), -1)
        of[asked] = np.arange(len(asked))
        every = _all_anchors(words[asked])
        active = np.zeros(len(words), bool)
        equal = np.flatnonzero(low != high)
        active[equal] = np.where(every[of[equal]] < 0, at[equal, None], every[of[equal]]).min(1, initial=2**31) == at[equal]

        def paired(i: np.ndarray, j: np.ndarray) -> None:
            near = (_bits(words[i] ^ words[j]) <= THRESHOLD) & (np.minimum(low[i], low[j]) != np.maximum(high[i], high[j]))
            i, j = i[near], j[near]
            for lo in range(0, len(i), 1 << 14):
                a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
                here = _least_common(every[of[a]], every[of[b]]) == at[a]
                active[a[here]] = active[b[here]] = True

        two = starts[(counts == 2) & unlike]
        paired(two, two + 1)
        many = (counts > 2) & unlike
        for s, n in zip(starts[many], counts[many], strict=True):
            # an anchor's ball holds 497 words at most
            i, j = np.triu_indices(n, 1)
            paired(s + i, s + j)
        left = np.repeat(active, some)
        return pa.RecordBatch.from_arrays([pa.array((key >> 10)[left]), pa.array(k[left])], ["anchor", "k"])

    placed = classes.select("k", "w", "label").mapInArrow(spread, "key long, k long, other long")
    placed = placed.repartition(F.shiftright("key", 10)).sortWithinPartitions("key")
    return placed.mapInArrow(_by_key(met, 3, 10), "anchor long, k long")


def _wide_forest(w: np.ndarray, most: int) -> list[tuple[int, int]]:
    """As ``_forest``, over the whole of wide fingerprints."""
    left, edges = np.arange(len(w)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            k = todo.pop()
            near = _bits(w[left] ^ w[k]).sum(1, dtype=np.int64) <= most
            edges += [(k, j) for j in left[near]]
            todo += left[near].tolist()
            left = left[~near]
    return edges


def wide_links(classes: DataFrame, most: int, blocks: range = range(2 * WORDS)) -> DataFrame:
    """(a, b): edges between classes (k, w array), each at most ``most`` bits long, that join what all pairs so near would
    that meet in one of ``blocks``. Where classes have a ``label``, those of one label count as joined. The whole fingerprint goes to the anchors where a class meets another, and each anchor gives a
    spanning forest of its links; a forest over the blocks alone would lose links behind a far centre."""

    def found(anchor: np.ndarray, k: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        counts = np.diff(np.r_[starts, len(anchor)])
        two = starts[counts == 2]
        two = two[_bits(w[two] ^ w[two + 1]).sum(1, dtype=np.int64) <= most]
        edges = [np.stack([k[two], k[two + 1]])]
        for s, n in zip(starts[counts > 2], counts[counts > 2], strict=True):
            if near := _wide_forest(w[s : s + n], most):
                edges.append(k[s:][np.array(near).T])
        both = np.unique(np.sort(np.concatenate(edges, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    # At most 16 anchors a block and class, gathered so that its fingerprint is fetched once.
    labelled = classes if "label" in classes.columns else classes.withColumn("label", F.col("k"))
    met = _meeting(labelled, blocks).groupBy(F.col("k").alias("_k")).agg(F.collect_list("anchor").alias("_at"))
    rows = classes.join(met, F.col("k") == F.col("_k")).select(F.explode("_at").alias("anchor"), "k", "w")
    # In order of k, so that anchors that hold the same classes hang them on the same one.
    rows = rows.repartition("anchor").sortWithinPartitions("anchor", "k")
    return rows.mapInArrow(_by_key(found, 3), "a long, b long").distinct()


def wide_groups(classes: DataFrame, most: int, rows: int | None = None) -> DataFrame:
    """(node, root) of the classes (k, w array), about ``rows``, that candidates join. What meets in the first blocks is
    joined first, and only what is still apart meets in the others; the second round's edges are between whole groups."""
    rows = classes.count() if rows is None else rows
    first = components(packed(wide_links(classes, most, range(FIRST)), rows), rows, LABELLED)
    first = checkpointed(packed(first.select(F.col("node").alias("_node"), F.col("root").alias("_root")), rows))
    labelled = classes.join(first, F.col("k") == F.col("_node"), "left").select("k", "w", F.coalesce("_root", "k").alias("label"))
    edges = packed(wide_links(labelled, most, range(FIRST, 2 * WORDS)), rows)
    for end in ("a", "b"):
        edges = packed(edges.join(first, F.col(end) == F.col("_node"), "left"), rows)
        edges = edges.withColumn(end, F.coalesce("_root", end)).select("a", "b")
    second = components(edges, rows, LABELLED)
    # A node of the second round is a group of the first or a class that was alone in it.
    told = packed(first.join(second, F.col("_root") == F.col("node"), "left"), rows)
    told = told.select(F.col("_node").alias("node"), F.coalesce("root", "_root").alias("root"))
    alone = packed(second.join(first.select("_node"), F.col("node") == F.col("_node"), "left_anti"), rows)
    return checkpointed(told.unionByName(alone.select("node", "root")))


def _similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges, each between sets of at least that Jaccard similarity, that join what all such pairs would."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.r_[0, np.cumsum(sizes)]
    owners = np.repeat(np.arange(n, dtype=np.int32), sizes)[np.argsort(ids, kind="stable")]
    at = np.r_[0, np.cumsum(np.bincount(ids))] if len(ids) else np.zeros(1, np.int64)
    left, edges = np.ones(n, bool), []
    for first in range(n):
        if not left[first]:
            continue
        todo, left[first] = [first], False
        while todo:
            k = todo.pop()
            if not left.any():
                return edges
            shared = np.zeros(n, np.int64)
            own = ids[ends[k] : ends[k + 1]]
            for lo in range(0, len(own), 1 << 12):
                lists = [owners[at[i] : at[i + 1]] for i in own[lo : lo + (1 << 12)]]
                shared += np.bincount(np.concatenate(lists), minlength=n)
            near = np.flatnonzero(left & (shared >= similarity * (sizes[k] + sizes - shared) - 1e-9) & (shared > 0))
            edges += [(k, j) for j in near]
            todo += list(near)
            left[near] = False
    return edges


def _in_cells(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): edges that join what all pairs so similar within a cell would; rows (cell, k, hashes)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def found() -> pa.RecordBatch:
            edges = _similar([h for _, h in held], similarity)
            ends = [pa.array([held[x[i]][0] for x in edges], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, ["a", "b"])

        for b in batches:
            for cell, k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if cell != key:
                    if len(held) > 1:
                        yield found()
                    key, held = cell, []
                held.append((k, np.frombuffer(h.as_py(), np.uint64)))
        if len(held) > 1:
            yield found()

    rows = rows.select("cell", "k", "hashes").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def _slot(t: str):
    return F.pmod(F.col(t), F.lit(SLOTS))


def _within(rows: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """Those of ``rows`` (t) whose hash has a slot that ``wanted`` (t) has too, or not (how: left_semi, left_anti). The
    slots are broadcast as bits, 128 KB at most whatever the input; a filter that spares rows a shuffle, no more."""
    part, place = F.floor(_slot("t") / SLOT_BITS), _slot("t") % SLOT_BITS
    maps = wanted.select(part.alias("_part"), place.alias("_place")).distinct()
    maps = maps.groupBy("_part").agg(F.bitmap_construct_agg("_place").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0
    return rows.join(F.broadcast(maps), (part == F.col("_part")) & held, how)


def exact_links(
    members: DataFrame,
    texts: DataFrame,
    similarity: float,
    size: int = WIDE_SHINGLE,
    most: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """(a, b): edges between classes of one group, each of at least that exact Jaccard similarity, that join what all
    such pairs of the group would. ``members`` (k, root, t, size) gives each class, its group, its text's hash and its
    number of shingles; ``texts`` (t, text).

    A group of more than ``most`` classes is dealt into parts. A few of its classes, chosen by hash, meet every part,
    which joins the copies of a large group at a cost that grows with its size alone. What is apart after that is dealt
    anew, each large cluster into bins of its own, and bins meet two at a time unless they are of one cluster.
    """
    most, few = most or CELL, members.count() if rows is None else rows
    cells = lambda n, total: F.ceil(F.greatest(n / most, total / CELL_SHINGLES)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t.as_py(), size).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["_k", "hashes"])

    groups = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    groups = groups.select(F.col("root").alias("_root"), F.col("n").alias("_n"), cells(F.col("n"), F.col("total")).alias("parts"))
    placed = checkpointed(packed(members.join(groups, F.col("root") == F.col("_root")).drop("_root"), few))
    # Copies are merged before the join, as one text can be most of the rows.
    once = _within(texts, members, "left_semi").dropDuplicates(["t"])
    sets = once.join(placed.select(F.col("t").alias("_t"), "k"), F.col("t") == F.col("_t")).select("k", "text")
    sets = checkpointed(sets.mapInArrow(run, "_k long, hashes binary"))

    leader = (F.col("parts") > 1) & (F.pmod(F.xxhash64("k", F.lit(7)), F.col("_n")) < LEADERS)
    own = F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")
    part = F.explode(F.when(leader, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))
    rows = placed.select("k", "root", part.alias("part")).select("k", F.xxhash64("root", "part").alias("cell"))
    edges = _in_cells(rows.join(sets, F.col("k") == F.col("_k")), similarity)
    large = placed.where("parts > 1")
    if not large.limit(1).count():
        return edges

    edges = packed(checkpointed(edges), few)
    joined = components(edges, few, LABELLED).select("node", F.col("root").alias("_c"))
    large = large.join(joined, F.col("k") == F.col("node"), "left")
    large = checkpointed(packed(large.select("k", "root", "size", F.coalesce("_c", "k").alias("c")), few))
    clusters = large.groupBy("root", "c").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    big = (2 * F.col("n") > most) | (2 * F.col("total") > CELL_SHINGLES)
    clusters = clusters.withColumn("own", F.when(big, cells(F.col("n"), F.col("total"))))
    rest = clusters.where("own IS NULL").groupBy(F.col("root").alias("_root"))
    rest = rest.agg(cells(F.sum("n"), F.sum("total")).alias("rest"))
    clusters = clusters.join(rest, F.col("root") == F.col("_root"), "left")
    clusters = clusters.select(F.col("root").alias("_root"), F.col("c").alias("_c"), "own", "rest")
    mine = F.when(F.col("own").isNotNull(), F.struct(F.col("c").alias("c"), F.pmod(F.xxhash64("k"), F.col("own")).alias("i")))
    mine = mine.otherwise(F.struct(F.lit(None).cast("long").alias("c"), F.pmod(F.xxhash64("c"), F.col("rest")).alias("i")))
    dealt = large.join(clusters, (F.col("root") == F.col("_root")) & (F.col("c") == F.col("_c")))
    dealt = checkpointed(packed(dealt.select("k", "root", mine.alias("bin")), few))
    bins = dealt.select("root", "bin").distinct()
    one = bins.select("root", F.col("bin").alias("one"))
    two = bins.select(F.col("root").alias("_root"), F.col("bin").alias("two"))
    apart = F.col("one.c").isNull() | F.col("two.c").isNull() | (F.col("one.c") != F.col("two.c"))
    pairs = one.join(two, (F.col("root") == F.col("_root")) & (F.col("one") <= F.col("two")) & apart)
    pairs = pairs.select(F.col("root").alias("_root"), "one", "two", F.xxhash64("root", "one.c", "one.i", "two.c", "two.i").alias("cell"))
    both = pairs.select("_root", F.col("one").alias("_bin"), "cell").unionByName(
        pairs.where("one <> two").select("_root", F.col("two").alias("_bin"), "cell")
    )
    rows = dealt.join(both, (F.col("root") == F.col("_root")) & F.col("bin").eqNullSafe(F.col("_bin"))).select("k", "cell")
    return edges.unionByName(_in_cells(rows.join(sets, F.col("k") == F.col("_k")), similarity)).distinct()


def _clusters(rows: DataFrame, similarity: float, size: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(found, classes, roots, number of classes) of rows (doc_id, text, t, r): found (doc_id, t, r, h) has the hash h of every row's shingle
    set; classes (h, k, least, n) are the rows of one set, k a number that takes less room than a hash where it is
    copied; roots (node, root) of the numbers of classes that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a text's hashes are let go before the next one's are made
            flat, keys = np.zeros((b.num_rows, WORDS), np.uint64), np.zeros(b.num_rows, np.uint64)
            sizes = np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column(1)):
                hashes = shingles(t.as_py(), size)
                flat[i], keys[i], sizes[i] = _wide(hashes), xxhash.xxh64_intdigest(hashes.tobytes(), SEED), len(hashes)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * WORDS)
            lists = pa.ListArray.from_arrays(ends, pa.array(flat.ravel().view(np.int64)))
            made = [b.column(0), b.column(2), b.column(3), pa.array(keys.view(np.int64)), pa.array(sizes), lists]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "t", "r", "h", "size", "w"])

    found = rows.select("doc_id", "text", "t", "r")
    found = checkpointed(found.mapInArrow(run, "doc_id long, t long, r long, h long, size long, w array<long>"))
    least = lambda c: F.min(c).alias(c)
    classes = found.groupBy("h").agg(least("w"), least("t"), least("size"), F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = checkpointed(classes.withColumn("k", F.monotonically_increasing_id()))
    n = classes.count()
    groups = wide_groups(classes.select("k", "w"), most_bits(similarity), n)
    members = packed(classes.join(groups, F.col("k") == F.col("node")), n).select("k", "root", "t", "size")
    pairs = exact_links(checkpointed(members), rows.select("t", "text"), similarity, size, rows=n)
    return found, classes, components(packed(pairs, n), n, LABELLED), n


def near_clusters(df: DataFrame, similarity: float = SIMILARITY, size: int = WIDE_SHINGLE) -> DataFrame:
    """(doc_id, component_id) of every row: rows as similar as that, directly or by way of others, share the least id.

    The distance only gathers classes into groups; within a group the sets decide.
    """
    t = F.xxhash64("text")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", t.alias("t"), F.lit(0).cast("long").alias("r"))
    found, classes, roots, _ = _clusters(rows, similarity, size)
    named = classes.join(roots, F.col("k") == F.col("node")).select(F.col("h").alias("node"), "root")
    return _labelled_rows(found, classes, checkpointed(named), "h").select("doc_id", "component_id")


def deduplicated(df: DataFrame, similarity: float = SIMILARITY, size: int = WIDE_SHINGLE) -> DataFrame:
    """One row of each cluster of near-duplicates: that with the least id, nulls last, ties by a hash of its columns."""
    own = df.columns
    every = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.xxhash64("text").alias("t"), F.xxhash64(*every).alias("r"),
    )
    found, classes, roots, n = _clusters(rows.drop("row"), similarity, size)
    # Rows that have a class to themselves that is not linked stay as they are; the others are judged.
    linked = packed(classes.join(roots, F.col("k") == F.col("node"), "left"), n).where("n > 1 OR root IS NOT NULL")
    linked = linked.select(F.col("h").alias("_h"), F.coalesce("root", "k").alias("component"))
    judged = found.join(linked, F.col("h") == F.col("_h"))
    judged = judged.groupBy("component", "t", "r").agg(F.min("doc_id").alias("doc_id"))
    judged = packed(checkpointed(judged), n)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "r")).alias("best")
    stays = judged.groupBy("component").agg(best).select(F.col("best.t").alias("_t"), F.col("best.r").alias("_r"))
    goes = judged.join(stays, (F.col("t") == F.col("_t")) & (F.col("r") == F.col("_r")), "left_anti")
    goes = goes.select(F.col("t").alias("_t"), F.col("r").alias("_r"))
    rows = rows.select("row", "t", "r")
    alone = _within(rows, judged, "left_anti").select("row")
    # Rows alike in all columns are merged before they move.
    few = _within(rows, judged, "left_semi").groupBy("t", "r").agg(F.first("row").alias("row"))
    few = few.join(goes, (F.col("t") == F.col("_t")) & (F.col("r") == F.col("_r")), "left_anti").select("row")
    return alone.unionByName(few).select("row.*")
