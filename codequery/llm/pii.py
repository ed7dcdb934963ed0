"""Personal data: pattern matches, and further spans from a linear-chain conditional random field.

Patterns give the base spans of four kinds. The field reads the runs of tokens around digits and at-signs, sees each
token as its word shape, and tags it as the beginning or inside of a kind or as neither. It is trained on the driver
from a small labelled table, by the gradient of its log-likelihood: lines written by hand (``pii_labels``), and as many
made of the usual forms of each kind and of near misses. Runs are decoded by Viterbi, all runs of a batch side by side.
What it finds must touch no base span and must still have a kind's number of digits and, for cards and addresses, its
check sum or ranges; it adds phones without a plus or cards with other separators, say.

Positions are code points, ends exclusive. Edge cases: a null or empty text has no spans; texts, tokens and runs of any
length are read whole, in time that grows with their length; matches that fail their check are dropped without a retry;
overlapping base spans of different kinds all count; repeated rows are each searched; an empty table gives no rows;
other columns pass through ``redacted`` untouched, but for ``n_chars``, and are not read by ``found``.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequery.llm import pii_labels

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A token that holds a digit or an at-sign.
_SIGNAL = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_TOKEN = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def valid(kind: int, text: str) -> bool:
    """Whether a text can be of a kind."""
    if kind == 0:
        at = text.find("@")
        return at > 0 and bool(_DOMAIN.fullmatch(text, at + 1))
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """The pattern matches, by kind and then start."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            found.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return found
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return found


# -- the field ---------------------------------------------------------------------------------------------------------

#: Tag 0 is outside; 1 + 2 k begins and 2 + 2 k continues kind k.
TAGS = 1 + 2 * len(KINDS)


def shape(token: str) -> str:
    """Classes of a token's characters, with runs' lengths up to four."""
    out, run, last = [], 0, ""
    for c in token:
        k = "9" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else c
        run = run + 1 if k == last else 1
        last = k
        if run <= 4:
            out.append(k)
    return "".join(out)


def observed(tokens: list[str]) -> list[list[str]]:
    """The features of each token of a run."""
    shapes = [shape(t) for t in tokens]
    brief = [re.sub(r"(.)\1+", r"\1", s) for s in shapes]
    out = []
    for i, t in enumerate(tokens):
        n = sum(c.isdigit() for c in t)
        before, after = brief[i - 1] if i else "^", brief[i + 1] if i + 1 < len(tokens) else "$"
        own = [f"s={shapes[i]}", f"b={brief[i]}", f"n={min(n, 20)}", f"l={min(len(t), 24) // 3}"]
        beside = [f"-1={before}", f"+1={after}", f"-1b={before}|{brief[i]}", f"+1b={brief[i]}|{after}"]
        out.append([*own, *beside, f"dots={t.count('.')}", f"at={'@' in t}"])
    return out


def by_hand(lines: str = pii_labels.TRAIN) -> list[tuple[list[str], list[int]]]:
    """The lines of a written table as token runs and their tags; what a line has outside of runs is left out."""
    out = []
    for line in lines.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+):([^}]*)\}", line):
            text += line[at : m.start()]
            spans.append((KINDS.index(m[1]), len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        text += line[at:]
        for run in _runs(text):
            tags, last = [], None
            for a, b in run:
                of = next((x for x in spans if a < x[2] and x[1] < b), None)
                tags.append(0 if of is None else (2 if of == last else 1) + 2 * of[0])
                last = of
            out.append(([text[a:b] for a, b in run], tags))
    return out


def made(seed: int = 11, rows: int = 300) -> list[tuple[list[str], list[int]]]:
    """Token runs and their tags, written out from a few forms of each kind and of none."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda a=2, b=9: "".join(rng.choice("aeionrstlcdmpubghvfw") for _ in range(rng.randint(a, b)))
    end = lambda: rng.choice(["", "", "", ",", ".", ";"])

    def card() -> str:
        n = rng.choice([13, 14, 15, 16, 16, 16, 16, 19])
        body = rng.choice("3456") + d(n - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(sep: str) -> str:
        c = card()
        return sep.join(c[i : i + 4] for i in range(0, len(c), 4))

    part = lambda: str(rng.randint(0, 255))
    kinds = [
        [lambda: f"{w()}.{d(2)}@{w()}{d(1)}.{w()}.com", lambda: f"{w()}@{w()}.{rng.choice(['org', 'net', 'de', 'fr'])}", lambda: f"{w()}_{w()}+{w()}@{w()}-{w()}.co.uk"],
        [lambda: ".".join(part() for _ in range(4))],
        [card, lambda: grouped(" "), lambda: grouped("-"), lambda: grouped("."), lambda: grouped("  ")],
        [
            lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{d(2)} {d(2)} {d(4)} {d(4)}",
            lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(6)}", lambda: f"0{d(2)}/{d(7)}", lambda: f"+{d(11)}",
        ],
    ]
    neither = [
        lambda: str(rng.randint(1800, 2030)), lambda: d(rng.randint(1, 3)), lambda: f"{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(4)}-{d(2)}-{d(2)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40]))), lambda: f"${d(2)}.{d(2)}", lambda: f"#{d(3)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{w().upper()}-{d(4)}", lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{d(5)}", lambda: f"{d(7)}", lambda: f"{w()}{d(2)}", lambda: f"@{w()}", lambda: f"{d(2)}%", lambda: f"{d(21)}", lambda: f"{w()}={d(12)}", lambda: f"https://{w()}.com/{d(9)}", lambda: f"{d(10)}{w()}", lambda: f"{d(3)}.{d(3)}",
    ]
    out = []
    for _ in range(rows):
        tokens, tags = [], []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice([None, None, 0, 1, 2, 3])
            if kind is None:
                some = [rng.choice(neither)() + end()]
                mark = [0]
            else:
                some = (rng.choice(kinds[kind])() + end()).split()
                mark = [1 + 2 * kind] + [2 + 2 * kind] * (len(some) - 1)
            plain = [w() for _ in range(rng.randint(0, 2))]
            tokens += plain + some
            tags += [0] * len(plain) + mark
        out.append((tokens, tags))
    return out


def labelled() -> list[tuple[list[str], list[int]]]:
    """The small labelled table that the field is trained from."""
    return by_hand() + made()


@dataclass
class Field:
    """Weights of features by tag, and of a tag after another; ``index`` numbers the features seen in training."""

    index: dict[str, int]
    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        none = len(self.index)
        at = np.array([[self.index.get(f, none) for f in r] for r in rows], np.int64)
        return np.concatenate([self.emit, np.zeros((1, TAGS))])[at].sum(1)


#: A kind goes on only after it has begun or gone on.
_ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b - 1, b) for b in range(TAGS)] for a in range(TAGS)])
_STARTS = np.array([b == 0 or b % 2 == 1 for b in range(TAGS)])


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    out = np.zeros((len(parts), sizes.max(), *parts[0].shape[1:]), parts[0].dtype)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out, sizes


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(table: list[tuple[list[str], list[int]]], rounds: int = 80, rate: float = 0.1, decay: float = 0.02) -> Field:
    """The field of the largest regularised log-likelihood, approached by Adam; forward and backward sums over all runs
    at once."""
    rows = [observed(tokens) for tokens, _ in table]
    index: dict[str, int] = {}
    for r in rows:
        for fs in r:
            for f in fs:
                index.setdefault(f, len(index))
    feats, sizes = _padded([np.array([[index[f] for f in fs] for fs in r]) for r in rows])
    tags, _ = _padded([np.array(t) for _, t in table])
    n, width = tags.shape
    real = np.arange(width) < sizes[:, None]
    field = Field(index, np.zeros((len(index), TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS))
    params = [field.emit, field.step, field.first]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    truth = np.eye(TAGS)[tags] * real[..., None]
    pairs = np.einsum("nia,nib->ab", truth[:, :-1], truth[:, 1:] * real[:, 1:, None])
    for t in range(1, rounds + 1):
        e = field.emit[feats].sum(2)
        step, first = np.where(_ALLOWED, field.step, -1e4), np.where(_STARTS, field.first, -1e4)
        fore, back = np.zeros((n, width, TAGS)), np.zeros((n, width, TAGS))
        fore[:, 0] = first + e[:, 0]
        for i in range(1, width):
            fore[:, i] = _logsum(fore[:, i - 1, :, None] + step, 1) + e[:, i]
        for i in range(width - 2, -1, -1):
            went = _logsum(step + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2)
            back[:, i] = np.where(real[:, i + 1, None], went, 0)
        whole = _logsum(fore[np.arange(n), sizes - 1], 1)
        odds = np.exp(fore + back - whole[:, None, None]) * real[..., None]
        joint = np.zeros((TAGS, TAGS))
        for i in range(1, width):
            both = fore[:, i - 1, :, None] + step + (e[:, i] + back[:, i])[:, None, :] - whole[:, None, None]
            joint += (np.exp(both) * real[:, i, None, None]).sum(0)
        off = (odds - truth) / n
        g_emit = np.zeros_like(field.emit)
        np.add.at(g_emit, feats[real], off[real][:, None, :])
        grads = [g_emit + decay * field.emit / n, (joint - pairs) / n + decay * field.step / n, off[:, 0].sum(0)]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    field.step, field.first = np.where(_ALLOWED, field.step, -1e4), np.where(_STARTS, field.first, -1e4)
    return field


def viterbi(parts: list[np.ndarray], field: Field) -> list[np.ndarray]:
    """The best tags of each run, from its tokens' emissions; runs of like length side by side."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    at = 0
    while at < len(order):
        end = at + 1
        least = len(parts[order[at]])
        while end < len(order) and (n := len(parts[order[end]])) <= least + 2 and (end - at) * n < 1 << 16:
            end += 1
        some, at = order[at:end], end
        e, sizes = _padded([parts[i] for i in some])
        n, width, _ = e.shape
        came = np.zeros((n, width, TAGS), np.int8)
        best = field.first + e[:, 0]
        final = best.copy()
        for i in range(1, width):
            through = best[:, :, None] + field.step
            came[:, i] = through.argmax(1)
            best = through.max(1) + e[:, i]
            final = np.where((sizes > i)[:, None], best, final)
        tag = final.argmax(1)
        tags = np.zeros((n, width), np.int64)
        for i in range(width - 1, -1, -1):
            on = sizes > i
            tags[on, i] = tag[on]
            tag = np.where(on, came[np.arange(n), i, tag], tag)
        for k, i in enumerate(some):
            out[i] = tags[k, : sizes[k]]
    return out


def _runs(text: str) -> list[list[tuple[int, int]]]:
    """Token places of each run: tokens with a digit or an at-sign, and what stands between two that are near on a
    line."""
    spots: list[tuple[int, int]] = []
    for m in _SIGNAL.finditer(text):
        if spots and m.start() - spots[-1][1] <= 24 and "\n" not in text[spots[-1][1] : m.start()]:
            spots[-1] = (spots[-1][0], m.end())
        else:
            spots.append((m.start(), m.end()))
    return [[x.span() for x in _TOKEN.finditer(text, a, b)] for a, b in spots]


class _Taken:
    """Whether spans overlap any of the base spans."""

    def __init__(self, spans: list[Span]) -> None:
        self.joined: list[list[int]] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.joined and a <= self.joined[-1][1]:
                self.joined[-1][1] = max(self.joined[-1][1], b)
            else:
                self.joined.append([a, b])
        self.ends = [b for _, b in self.joined]

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.ends, start + 1)
        return k < len(self.joined) and self.joined[k][0] < end


def spans_of(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind and then start."""
    base = [base_spans(t) for t in texts]
    taken = [_Taken(b) for b in base]
    owner, places, parts = [], [], []
    for k, text in enumerate(texts):
        if "@" in text or _DIGIT.search(text):
            for run in _runs(text):
                owner.append(k)
                places.append(run)
                parts.append(observed([text[a:b] for a, b in run]))
    flat = [r for p in parts for r in p]
    scores = np.split(field.emissions(flat), np.cumsum([len(p) for p in parts])[:-1]) if flat else []
    more: list[list[Span]] = [[] for _ in texts]
    for k, run, tags in zip(owner, places, viterbi(scores, field), strict=True):
        i = 0
        while i < len(run):
            if not tags[i]:
                i += 1
                continue
            kind, j = (int(tags[i]) - 1) // 2, i + 1
            while j < len(run) and tags[j] == 2 + 2 * kind:
                j += 1
            start, end, i = run[i][0], run[j - 1][1], j
            piece = texts[k][start:end]
            after = ",.;:!?\"')]}>" if piece.count("(") < piece.count(")") else ",.;:!?\"']}>"
            start += len(piece) - len(piece.lstrip(",.;:!?\"'[{<"))
            end -= len(piece) - len(piece.rstrip(after))
            if start < end and valid(kind, texts[k][start:end]) and not taken[k].meets(start, end):
                more[k].append((kind, start, end))
    return [(b, sorted(b + m)) for b, m in zip(base, more, strict=True)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _model(df: DataFrame):
    return df.sparkSession.sparkContext.broadcast(train(labelled()))


def found(df: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row of (doc_id, text)."""
    shared = _model(df)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = spans_of([t.as_py() or "" for t in b.column(1)], shared.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in both], pa.string())
            spans = pa.array([written(x) for _, x in both], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, spans], names)

    schema = df.select("doc_id").schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return df.select("doc_id", "text").mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string"))


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, or group of overlapping spans, as its first one's kind in angle brackets."""
    out, done, joined = [], 0, []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if joined and a < joined[-1][2]:
            joined[-1] = (*joined[-1][:2], max(b, joined[-1][2]))
        else:
            joined.append((k, a, b))
    for k, a, b in joined:
        out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = b
    return "".join(out) + text[done:]


def redacted(df: DataFrame) -> DataFrame:
    """``df`` with personal data masked in ``text``; ``n_chars``, if there, follows."""
    shared = _model(df)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            texts = columns["text"].to_pylist()
            every = [spans for _, spans in spans_of([t or "" for t in texts], shared.value)]
            new = [t if t is None or not spans else masked(t, spans) for t, spans in zip(texts, every, strict=True)]
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                old = columns["n_chars"]
                counts = [o if t == s else len(t) for o, s, t in zip(old.to_pylist(), texts, new, strict=True)]
                columns["n_chars"] = pa.array(counts, old.type)
            yield pa.RecordBatch.from_arrays([columns[x] for x in names], names)

    return df.mapInArrow(run, df.schema)
