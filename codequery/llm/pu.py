"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are rows labelled 1; the unlabelled rows are a mixture of both classes. With class prior p the risk is
``p R+(positives) + max(0, R-(unlabelled) - p R-(positives))``; while the last term is below zero, a step goes against
it instead (the non-negative correction). The prior is estimated from the two samples alone: over the regions where a
first classifier of positives against unlabelled rows, fitted on the other half of them, scores high, the least ratio of
unlabelled to positive mass bounds it, and does so tightly where negatives are absent.

The model is a network of one hidden layer over the whole text: counts of its shape, and the frequencies of its words
and of its runs of three bytes, hashed. It is fitted on the driver on samples whose sizes are parameters; every row is
read once more and scored.

Edge cases: a null text counts as empty and is scored; a null id is never held out and never learned from; several
labels of one id all count; of several rows of a sampled id one is learned from; texts of any length are read whole;
without positives or unlabelled rows every score is 0.5; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of the samples that the model is fitted on, chosen by a hash of their id.
POSITIVES, UNLABELLED = 8_000, 16_000
HIDDEN, STEPS, RATE, DECAY = 16, 200, 0.02, 1e-4
CUT = 0.3
FOLDS = 5

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"[0-9]")
_STOPS = re.compile(r"[.!?]")
_OTHER = re.compile(r"[^\w\s]")
#: Counts of a feature vector, its slots for words and as many for runs of bytes.
COUNTS, SLOTS = 18, 128
SIZE = COUNTS + 2 * SLOTS


def statistics(text: str | None) -> list[float]:
    """The counts of a text; an empty one has zeros."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * COUNTS
    sizes = np.fromiter(map(len, words), np.int64, n)
    chars = int(sizes.sum())
    lines = [x for x in text.split("\n") if x.strip()]
    grams = len(set(zip(words, words[1:], words[2:], strict=False)))
    count = lambda pattern: len(pattern.findall(text)) / chars
    return [
        math.log1p(n), float(n < 50), chars / n, math.log1p(int(sizes.max())), float((sizes <= 3).mean()),
        float((sizes >= 10).mean()), count(_SYMBOLS), count(_UPPER), count(_DIGITS), count(_STOPS), count(_OTHER),
        text.count("!") / n, text.count("|") / n, len(set(words)) / n, 1 - grams / max(n - 2, 1) if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), float(sizes.std()),
    ]


def frequencies(text: str | None) -> np.ndarray:
    """Roots of the shares of a text's words, and of its runs of three bytes, by slot; an empty one has zeros."""
    raw = (text or "").lower().encode("utf-8", "replace")
    out = np.zeros(2 * SLOTS)
    words = raw.split()
    if words:
        slots = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % SLOTS
        out[:SLOTS] = np.sqrt(np.bincount(slots, minlength=SLOTS) / len(words))
    if len(raw) > 2:
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        runs = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(15)
        out[SLOTS:] = np.sqrt(np.bincount(runs % SLOTS, minlength=SLOTS) / len(runs))
    return out


def features(texts: list[str | None]) -> np.ndarray:
    """The feature vectors of texts, a row each."""
    out = np.zeros((len(texts), SIZE))
    for row, t in zip(out, texts, strict=True):
        row[:COUNTS], row[COUNTS:] = statistics(t), frequencies(t)
    return out


def described(df: DataFrame) -> DataFrame:
    """(doc_id, x) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features([t.as_py() for t in b.column(1)]).astype(np.float32)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * SIZE)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "x"])

    return df.select("doc_id", "text").mapInArrow(run, df.select("doc_id").schema.add("x", T.ArrayType(T.FloatType())))


def held_out(id_col: str = "doc_id"):
    """Whether a row's label may not be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.a + self.b) @ self.c + self.d

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(z: np.ndarray, weights, seed: int, steps: int) -> list[np.ndarray]:
    """Adam on a network whose outputs' gradients ``weights(margins)`` gives."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    p = [x.astype(z.dtype) for x in p]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for t in range(1, steps + 1):
        h = np.tanh(z @ p[0] + p[1])
        g = weights((h @ p[2] + p[3][0]).astype(np.float64)).astype(z.dtype)
        back = np.outer(g, p[2]) * (1 - h * h)
        grads = [z.T @ back + DECAY * p[0], back.sum(0), h.T @ g + DECAY * p[2], np.array([g.sum()])]
        for i, x in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * x
            v[i] = 0.999 * v[i] + 0.001 * x * x
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from the first classifier's margins of both."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.5, 26))
    p = np.array([(positive >= t).mean() for t in cuts])
    u = np.array([(unlabelled >= t).mean() for t in cuts])
    return float(np.clip(np.min(u / p), 0.05, 0.95))


def risk(margin: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part of the risk, and the rest that must not be negative, with the logistic loss."""
    as_negative = np.logaddexp(0, margin)
    rest = as_negative[~is_p].mean() - prior * as_negative[is_p].mean()
    return prior * np.logaddexp(0, -margin[is_p]).mean(), rest


def risk_gradient(margin: np.ndarray, is_p: np.ndarray, prior: float) -> np.ndarray:
    """The step's gradient by margins: that of the whole risk, or, where the rest is negative, against the rest."""
    s = _sigmoid(margin)
    n = is_p.sum()
    rest_grad = np.where(is_p, -prior * s / n, s / (len(margin) - n))
    if risk(margin, is_p, prior)[1] < 0:
        return -rest_grad
    return np.where(is_p, prior * (s - 1) / n, 0) + rest_grad


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> Model:
    both = np.concatenate([positive, unlabelled]).astype(np.float32)
    mean, scale = both.mean(0), both.std(0) + np.float32(1e-6)
    z = np.clip((both - mean) / scale, -8, 8)
    is_p = np.arange(len(z)) < len(positive)

    # The first classifier judges rows that it has not seen: each half by the other.
    first, half = np.zeros(len(z)), np.arange(len(z)) % 2 == 0
    for mine in (half, ~half):
        kind = is_p[~mine]

        def ordinary(margin: np.ndarray, kind: np.ndarray = kind) -> np.ndarray:
            return np.where(kind, (_sigmoid(margin) - 1) / kind.sum(), _sigmoid(margin) / (~kind).sum()) / 2

        p = _descend(z[~mine], ordinary, seed, STEPS // 4) if kind.any() and not kind.all() else None
        first[mine] = np.tanh(z[mine] @ p[0] + p[1]) @ p[2] + p[3][0] if p else 0.0
    prior = estimated_prior(first[is_p], first[~is_p])
    a, b, c, d = _descend(z, lambda margin: risk_gradient(margin, is_p, prior), seed, STEPS)
    return Model(mean, scale, a, b, c, float(d[0]), prior)


def _bounded(ids: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of distinct ids (doc_id) by their hash. Hashes beyond a mark that leaves about a quarter more
    are dropped where they are, so that no task or driver gathers more, however many partitions there are."""
    share = min(1.0, (1.25 * most + 1000) / max(ids.count(), 1))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    return ids.where(slot < int(share * (1 << 30))).orderBy(slot, "doc_id").limit(most)


def _sample(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """The feature vectors of at most as many rows as there are ``ids``, which are bounded and are broadcast."""
    rows = described(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"))
    rows = rows.groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").toPandas()
    return np.stack(rows.x.to_numpy()) if len(rows) else np.zeros((0, SIZE), np.float32)


def trained(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """The model, fitted on at most so many rows of either kind."""
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chosen = labels.where(F.col("quality") == 1).where(~held_out()).select("doc_id").distinct()
    chosen = chosen.join(known, "doc_id", "left_semi")
    p = _sample(docs, _bounded(chosen, positives))
    u = _sample(docs, _bounded(known.join(labels.select("doc_id").distinct(), "doc_id", "left_anti"), unlabelled))
    return fit(p, u) if len(p) and len(u) else None


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = trained(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(features([t.as_py() for t in b.column(1)])) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
