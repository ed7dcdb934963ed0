"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, in numpy batches.

A text becomes a marker and the text with every space as a marker. It is cut before each run of markers; the parts
are segmented alone, because no piece of the trie holds a marker after another character. The best segmentation of a
part has the largest sum of log scores. A character that no piece covers costs the lowest score less ten and is
written as the pieces of its UTF-8 bytes. Equal parts of a batch are segmented once, all parts side by side.

A part of more than LONG bytes is first cut where no piece that occurs in it crosses: the best segmentation is that of
the stretches between such places. A stretch that is long for all that is walked once, place by place, over the pieces
found at all places at once. So the time of a text grows with its length whether it has blanks or not.

Pieces come from a public model file. A model of merges stores ranks, not probabilities: the log score of the piece of
rank r is then that of a Zipf law, ``-ln(r + 1) - ln(sum 1 / (r + 1))``. Decoding joins the pieces' bytes, markers as
spaces, and drops the first one. A marker character that the text itself holds is no space: it is written as bytes.
So decoding gives back every text exactly.

Edge cases: null text gives null ids; an empty text gives no ids; long words without blanks are segmented whole; a
model without pieces for bytes writes its unknown piece, or 0 without one, and such a text does not come back; repeated
rows are encoded each; an empty table gives no rows; other columns pass through, but those called ``ids``, ``n_bytes``,
``round_trip`` or ``decoded`` give way to those made here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
_MARK = MARK.encode()
#: What a character without a piece costs beyond the lowest score.
UNKNOWN = 10.0
#: Bytes of text that are segmented side by side.
BATCH_BYTES = 2 << 20
#: Bytes of a part beyond which it is cut first, and bytes of it that are searched for pieces at a time.
LONG, STRETCH = 1 << 10, 1 << 18


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + n]
            at += n


@dataclass
class Vocabulary:
    """Pieces by id, their log scores, the ids of the bytes, and the trie of the others."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    ids: np.ndarray
    decoded: list[bytes]

    @classmethod
    def of(cls, pieces: list[bytes], scores: list[float], kinds: list[int]) -> Vocabulary:
        """``kinds``: 1 normal, 4 given by the user, 6 byte; pieces of other kinds are control symbols that no text gives."""
        byte_ids = np.full(256, -1, np.int32)
        words: dict[bytes, int] = {}
        unknown = 0
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == 6:
                byte_ids[int(piece[3:5], 16)] = i
            elif kind == 2:
                unknown = i
            elif kind in (1, 4) and b" " not in piece:
                word = piece.replace(_MARK, b" ")
                if word and b" " not in word.lstrip(b" "):
                    words.setdefault(word, i)
        byte_ids[byte_ids < 0] = unknown
        base, check, ids = double_array(words)
        plain = lambda p, k: p.replace(_MARK, b" ") if k in (1, 4) else b""
        decoded = [bytes([int(p[3:5], 16)]) if k == 6 else plain(p, k) for p, k in zip(pieces, kinds, strict=True)]
        return cls(pieces, np.array(scores), byte_ids, base, check, ids, decoded)


def load(raw: bytes) -> Vocabulary:
    """The vocabulary of a model file's bytes."""
    pieces, scores, kinds, merges = [], [], [], False
    for number, value in _fields(raw):
        if number == 1:
            found = dict(_fields(value))
            pieces.append(found[1])
            scores.append(float(np.frombuffer(found[2], "<f4")[0]) if 2 in found else 0.0)
            kinds.append(found.get(3, 1))
        elif number == 2:
            merges = dict(_fields(value)).get(3, 1) == 2
    if merges:
        normal = sorted((i for i, k in enumerate(kinds) if k == 1), key=lambda i: (-scores[i], i))
        whole = math.log(sum(1 / (r + 1) for r in range(len(normal))))
        scores = [0.0] * len(pieces)
        for r, i in enumerate(normal):
            scores[i] = -math.log(r + 1) - whole
    return Vocabulary.of(pieces, scores, kinds)


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, id) of the trie of ``words``: the child of s by byte c is t = base[s] + c + 1 if check[t] == s."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for word, i in words.items():
        s = 0
        for c in word:
            t = children[s].get(c)
            if t is None:
                t = children[s][c] = len(children)
                children.append({})
                value.append(-1)
            s = t
        value[s] = i
    size = 1 << 12
    base, check, ids = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    slot, queue, first = {0: 0}, [0], {True: 1, False: 1}
    for node in queue:
        keys = np.array(sorted(children[node]), np.int64) + 1
        if not len(keys):
            continue
        # The first place from which on all children are free; nodes with one child look from a mark of their own.
        at = max(first[len(keys) == 1] - int(keys[0]), 0)
        while True:
            if at + (1 << 12) + 258 >= len(check):
                base, check, ids = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (ids, -1)))
            free = check[at : at + (1 << 12) + 258] < 0
            fits = np.logical_and.reduce([free[k : k + (1 << 12)] for k in keys.tolist()])
            if fits.any():
                break
            at += 1 << 12
        at += int(fits.argmax())
        first[len(keys) == 1] = max(first[len(keys) == 1], at + int(keys[0]) - (0 if len(keys) == 1 else 512))
        s = slot[node]
        base[s] = at
        check[at + keys] = s
        for c, child in sorted(children[node].items()):
            slot[child] = at + c + 1
            ids[at + c + 1] = value[child]
            queue.append(child)
    pad = np.zeros(258, np.int32)
    return np.concatenate([base, pad]), np.concatenate([check, pad - 1]), np.concatenate([ids, pad - 1])


def _places(text: bytes, v: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, id) of every piece that occurs in a text, by start and end, a stretch of starts at a time."""
    raw = np.frombuffer(text + b"\0" * 256, np.uint8).astype(np.int32)
    for lo in range(0, len(text), STRETCH):
        who = np.arange(lo, min(lo + STRETCH, len(text)))
        state, found, j = np.zeros(len(who), np.int32), [], 0
        while len(who):
            at = who + j
            step = v.base[state] + raw[np.minimum(at, len(raw) - 1)] + 1
            good = (v.check[step] == state) & (at < len(text))
            who, state, j = who[good], step[good], j + 1
            hit = v.ids[state] >= 0
            found.append((who[hit], np.full(int(hit.sum()), j), v.ids[state[hit]]))
        start, size, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((size, start))
        yield start[order], (start + size)[order], ids[order]


def _char_sizes(text: bytes) -> np.ndarray:
    """The bytes of the character at each place, 0 inside of one."""
    lead = np.frombuffer(text, np.uint8)
    return np.where(lead < 0x80, 1, np.where(lead < 0xC0, 0, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))))


def _cut(word: bytes, v: Vocabulary) -> list[bytes]:
    """The stretches of a word between places that no piece crosses."""
    crossing = np.zeros(len(word) + 1, np.int64)
    for start, end, _ in _places(word, v):
        np.add.at(crossing, start + 1, 1)
        np.add.at(crossing, end, -1)
    safe = np.flatnonzero((np.cumsum(crossing)[:-1] == 0) & (_char_sizes(word) > 0))
    ends = np.r_[safe[safe > 0], len(word)].tolist()
    return [word[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _walk(word: bytes, v: Vocabulary) -> np.ndarray:
    """The ids of the best segmentation of one word, place by place."""
    n, sizes, scores = len(word), _char_sizes(word).tolist(), v.scores.tolist()
    best, piece, back = [-math.inf] * (n + 1), [-2] * (n + 1), [0] * (n + 1)
    best[0], unknown = 0.0, min(scores) - UNKNOWN

    def as_bytes(i: int) -> None:
        end = min(i + max(sizes[i], 1), n)
        if best[i] + unknown > best[end]:
            best[end], piece[end], back[end] = best[i] + unknown, -2, i

    for lo, (starts, ends, ids) in zip(range(0, n, STRETCH), _places(word, v), strict=True):
        k, rows = 0, list(zip(starts.tolist(), ends.tolist(), ids.tolist(), strict=True))
        for i in range(lo, min(lo + STRETCH, n)):
            known = best[i] == -math.inf
            while k < len(rows) and rows[k][0] == i:
                _, end, number = rows[k]
                k += 1
                if best[i] > -math.inf:
                    known |= end - i == sizes[i]
                    if best[i] + scores[number] > best[end]:
                        best[end], piece[end], back[end] = best[i] + scores[number], number, i
            if not known:
                as_bytes(i)
    out: list[int] = []
    at = n
    while at:
        i = back[at]
        out += [piece[at]] if piece[at] >= 0 else [int(v.byte_ids[c]) for c in reversed(word[i:at])]
        at = i
    return np.array(out[::-1], np.int32)


def segment(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the best segmentation of each word, offsets having one more entry than words."""
    parts = [_cut(w, v) if len(w) > LONG else [w] for w in words]
    ids, offsets = _side_by_side([x for p in parts for x in p], v)
    return ids, offsets[np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)]


def _side_by_side(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(order):
        # Words of like length side by side, no more than a bounded rectangle of them.
        end = int(np.searchsorted(ranked, ranked[at] + 1 + ranked[at] // 8, "right"))
        end = max(at + 1, min(end, at + (1 << 20) // max(int(ranked[end - 1]), 1)))
        some = order[at:end]
        at = end
        if ranked[end - 1] > LONG and len(some) < 16:
            for i in some.tolist():
                made = _walk(words[i], v)
                parts.append((np.array([i]), made, np.array([len(made)])))
        else:
            parts.append((some, *_segment([words[i] for i in some.tolist()], v)))
    counts = np.zeros(len(words), np.int64)
    for some, _, n in parts:
        counts[some] = n
    offsets = np.r_[0, np.cumsum(counts)]
    ids = np.zeros(offsets[-1], np.int32)
    for some, flat, n in parts:
        starts = np.cumsum(n) - n
        ids[np.repeat(offsets[some] - starts, n) + np.arange(len(flat))] = flat
    return ids, offsets


def _segment(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    n, width = len(words), int(sizes.max(initial=0))
    text = np.zeros((width + 1, n), np.int32)
    flat = np.frombuffer(b"".join(words), np.uint8)
    column = np.repeat(np.arange(n), sizes)
    row = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[row, column] = flat
    best = np.full((width + 1, n), -np.inf)
    best[0] = 0
    # The piece that best ends at a place: its id (-2: a character as bytes) and its length.
    piece, back = np.full((width + 1, n), -1, np.int32), np.zeros((width + 1, n), np.int32)
    unknown = v.scores.min() - UNKNOWN
    for i in range(width):
        lead = text[i]
        alive = np.flatnonzero((best[i] > -np.inf) & (i < sizes))
        size = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        known = np.zeros(n, bool)
        who, state = alive, np.zeros(len(alive), np.int32)
        for j in range(i, width):
            step = v.base[state] + text[j, who] + 1
            good = (v.check[step] == state) & (j < sizes[who])
            who, state = who[good], step[good]
            if not len(who):
                break
            found = v.ids[state]
            hit = np.flatnonzero(found >= 0)
            to, ids = who[hit], found[hit]
            known[to] |= size[to] == j + 1 - i
            score = best[i, to] + v.scores[ids]
            better = score > best[j + 1, to]
            to, ids = to[better], ids[better]
            best[j + 1, to], piece[j + 1, to], back[j + 1, to] = score[better], ids, j + 1 - i
        to = alive[~known[alive]]
        end = np.minimum(i + size[to], sizes[to])
        score = best[i, to] + unknown
        better = score > best[end, to]
        to, end = to[better], end[better]
        best[end, to], piece[end, to], back[end, to] = score[better], -2, end - i
    # Back from the ends: pieces come last first.
    at, who, made = sizes.copy(), np.flatnonzero(sizes > 0), []
    while len(who):
        ids, length = piece[at[who], who], back[at[who], who]
        plain = ids >= 0
        made.append((who[plain], at[who[plain]], ids[plain]))
        for k in range(4):
            w = who[~plain & (length > k)]
            made.append((w, at[w] - k, v.byte_ids[text[at[w] - k - 1, w]]))
        at[who] -= length
        who = who[at[who] > 0]
    if not made:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    owner, place, ids = (np.concatenate(x) for x in zip(*made, strict=True))
    return ids[np.lexsort((place, owner))].astype(np.int32), np.bincount(owner, minlength=n)


def encode(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts; a null text has none."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(filled, " ")
    ends = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(word):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    # Between two spaces lies an empty word: it adds its marker to the next word, or to a part of its own at the end.
    blank = np.array([not x for x in names])[word]
    place = np.arange(len(word))
    first = np.repeat(ends[:-1], np.diff(ends))
    seen = np.maximum.accumulate(np.where(blank, -1, place))
    markers = place - np.maximum(np.r_[-1, seen[:-1]] + 1, first)
    ended = np.zeros(len(word), bool)
    ended[ends[1:] - 1] = True
    part = ~blank | ended
    part &= ~np.repeat(np.asarray(pc.equal(pc.binary_length(filled), 0)), np.diff(ends))
    which = word[part]
    more = np.flatnonzero(markers[part] > 0)
    keys, which[more] = np.unique(markers[part][more] * len(names) + which[more], return_inverse=True)
    which[more] += len(names)
    made = [b" " + x for x in names] + [b" " * (k // len(names) + 1) + names[k % len(names)] for k in keys.tolist()]
    ids, offsets = segment(made, v)
    counts = np.diff(offsets)[which]
    starts = np.cumsum(counts) - counts
    flat = ids[np.repeat((offsets[:-1][which] - starts).astype(np.int32), counts) + np.arange(counts.sum(), dtype=np.int32)]
    parts = np.r_[0, np.cumsum(part)][ends]
    return flat, np.r_[0, np.cumsum(counts)][parts]


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of the texts that the ids stand for."""
    sizes = np.array([len(x) for x in v.decoded], np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = sizes[ids]
    starts = np.cumsum(counts) - counts
    flat = np.frombuffer(b"".join(v.decoded), np.uint8)[np.repeat(begins[ids] - starts, counts) + np.arange(counts.sum())]
    ends = np.r_[0, np.cumsum(counts)][offsets]
    some = ends[1:] > ends[:-1]
    heads = ends[:-1][some]
    heads = heads[flat[heads] == 0x20]  # the first marker is not the text's
    keep = np.ones(len(flat), bool)
    keep[heads] = False
    return flat[keep], np.r_[0, np.cumsum(keep)][ends]


def _slices(b: pa.RecordBatch, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BATCH_BYTES, one row at least."""
    at = 0
    total = np.cumsum(size)
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_BYTES)))
        yield b.slice(at, end - at)
        at = end


def _ids(flat: np.ndarray, offsets: np.ndarray, null: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()), mask=null)


def encoded(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int), ``n_bytes`` (ids that stand for bytes) and ``round_trip`` (decoding gave the
    text back)."""
    spark = df.sparkSession
    with open(model, "rb") as file:  # on the driver; the pieces go to the executors
        shared = spark.sparkContext.broadcast(load(file.read()))
    schema = T.StructType([f for f in df.schema.fields if f.name not in ("ids", "n_bytes", "round_trip")])
    schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("n_bytes", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        is_byte = np.zeros(len(v.pieces), np.int64)
        is_byte[v.byte_ids[v.byte_ids >= 0]] = 1
        names = schema.names[:-3]
        for whole in batches:
            length = pc.fill_null(pc.binary_length(whole.column(text_col)), 0).to_numpy(zero_copy_only=False)
            for b in _slices(whole, length):
                texts = b.column(text_col).cast(pa.large_string())
                flat, offsets = encode(texts, v)
                raw, ends = decode(flat, offsets, v)
                buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]
                given = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), buffers)
                same = pc.equal(given, texts.cast(pa.large_binary()))
                n_bytes = np.diff(np.r_[0, np.cumsum(is_byte[flat])][offsets])
                null = pc.is_null(texts)
                made = [_ids(flat, offsets, null), pa.array(n_bytes), same]
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *made], schema.names)

    return df.select(*(F.col(f"`{x}`") for x in schema.names[:-3])).mapInArrow(run, schema)


def decoded(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text that its ids stand for; bytes that are no UTF-8 become replacement characters."""
    with open(model, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(load(file.read()))
    schema = T.StructType([f for f in df.schema.fields if f.name != "decoded"]).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for whole in batches:
            length = pc.fill_null(pc.list_value_length(whole.column(ids_col)), 0).to_numpy(zero_copy_only=False) * 4
            for b in _slices(whole, length):
                lists = b.column(ids_col)
                null = pc.is_null(lists).to_numpy(zero_copy_only=False)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                raw, ends = decode(lists.flatten().to_numpy(), np.r_[0, np.cumsum(counts)], v)
                data = raw.tobytes()
                bounds = zip(null, ends[:-1], ends[1:], strict=True)
                texts = [None if gone else data[i:j].decode("utf-8", "replace") for gone, i, j in bounds]
                columns = [*(b.column(x) for x in schema.names[:-1]), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(*(F.col(f"`{x}`") for x in schema.names[:-1])).mapInArrow(run, schema)
