"""Embedding providers: none, a model on the executor, and one that asks a service over HTTP; several side by side.

A service is asked for batches of texts. A batch that it finds too long is halved and the smaller size kept; a single text
that is too long is halved until it fits or is too short to be worth it, and then has no vector; other failures are tried
again after a pause. The transport is a parameter, so that tests need no network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS, LEAST_CHARS, RETRIES, PAUSE_S = 24_000, 512, 3, 0.5
#: Words of an error that mean a text was too long.
TOO_LONG = ("token", "length", "context", "too long", "maximum")
Answer = tuple[int, list[list[float]] | str]
Transport = Callable[[list[str]], Answer]


class Unavailable(LookupError):
    """A search needs vectors and there is no provider."""


class NoProvider:
    """Stands for a missing model: nothing is embedded, and searches fall back to words."""

    available, dimensions = False, 0

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [None] * len(texts)


def masked_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors (n, d): the mean of each text's token vectors (n, tokens, d), padding left out."""
    weight = mask[..., None].astype(np.float64)
    mean = (hidden * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def positive(logits: np.ndarray) -> np.ndarray:
    """A pair model's scores (n,) from its outputs (n, labels): the sigmoid of one, else the last one's share of a
    softmax."""
    if logits.shape[1] == 1:
        return 1 / (1 + np.exp(-logits[:, 0]))
    raised = np.exp(logits - logits.max(1, keepdims=True))
    return raised[:, -1] / raised.sum(1)


def _padded(encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, encoded), default=0)
    ids = np.array([e + [0] * (width - len(e)) for e in encoded], np.int64).reshape(len(encoded), width)
    return ids, np.array([[1] * len(e) + [0] * (width - len(e)) for e in encoded], np.int64).reshape(ids.shape)


@dataclass
class LocalProvider:
    """A model on the executor: ``encode`` gives a text's token ids, ``run`` an array (n, tokens, d) of (ids, mask), as a
    session of an ONNX runtime does. Texts of like length are run side by side."""

    encode: Callable[[str], list[int]]
    run: Callable[[np.ndarray, np.ndarray], np.ndarray]
    dimensions: int
    batch: int = 32
    available: bool = True

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        tokens = [self.encode(t) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: len(tokens[i]))
        out: list[list[float] | None] = [None] * len(texts)
        for at in range(0, len(order), self.batch):
            some = order[at : at + self.batch]
            ids, mask = _padded([tokens[i] for i in some])
            for i, v in zip(some, masked_mean(self.run(ids, mask), mask), strict=True):
                out[i] = v.tolist()
        return out

    @classmethod
    def of_files(cls, model: str, tokenizer: str, dimensions: int, most_tokens: int = 512) -> LocalProvider:
        """From an ONNX file and a tokenizer's JSON."""
        import onnxruntime
        from tokenizers import Tokenizer

        session, words = onnxruntime.InferenceSession(model), Tokenizer.from_file(tokenizer)
        words.enable_truncation(most_tokens)
        names = {x.name for x in session.get_inputs()}

        def run(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            return session.run(None, {k: v for k, v in given.items() if k in names})[0]

        return cls(lambda t: words.encode(t).ids, run, dimensions)


def pair_scores(pairs: DataFrame, make: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]], batch: int = 32) -> DataFrame:
    """(query_id, doc_id, score) of (query_id, doc_id, query, passage) by a cross-encoder: ``make`` gives, once a task, what
    turns a batch of pairs into outputs (n, labels)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            both = list(zip(b["query"], b.passage, strict=True))
            parts = [positive(model(both[at : at + batch])) for at in range(0, len(both), batch)]
            yield pd.DataFrame({"query_id": b.query_id, "doc_id": b.doc_id, "score": np.concatenate(parts) if parts else []})

    schema = pairs.select("query_id", "doc_id").schema.add("score", T.DoubleType())
    return pairs.select("query_id", "doc_id", "query", "passage").mapInPandas(run, schema)


@dataclass
class HttpTransport:
    """Asks an endpoint that takes ``{"model", "input"}`` and answers ``{"data": [{"index", "embedding"}]}``."""

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)
    timeout_s: float = 60.0

    def __call__(self, texts: list[str]) -> Answer:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **self.headers})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as got:
                data = json.load(got)["data"]
            return 200, [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode(errors="replace")
        except OSError as e:
            return 503, str(e)


@dataclass
class HttpProvider:
    transport: Transport
    dimensions: int
    batch: int = 32
    pause_s: float = PAUSE_S
    available: bool = True

    def checked(self) -> HttpProvider:
        """The provider, once a first text has come back with the dimensions that are asked for."""
        (probe,) = self.embed(["a first text"])
        if probe is None or len(probe) != self.dimensions:
            raise ValueError(f"the service answers {len(probe or [])} dimensions, {self.dimensions} are configured")
        return self

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """A vector for each text, in order; None for one that the service can't take."""
        out: list[list[float] | None] = [None] * len(texts)
        # texts of like length side by side
        todo = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        while todo:
            some, todo = todo[: self.batch], todo[self.batch :]
            got = self._asked([texts[i][:MAX_CHARS] for i in some])
            if got is None and len(some) > 1:
                self.batch = max(1, len(some) // 2)
                todo = some + todo
            elif got is None:
                out[some[0]] = self._shortened(texts[some[0]][:MAX_CHARS])
            else:
                for i, v in zip(some, got, strict=True):
                    out[i] = v
        return out

    def _shortened(self, text: str) -> list[float] | None:
        while len(text) // 2 >= LEAST_CHARS:
            text = text[: len(text) // 2]
            if got := self._asked([text]):
                return got[0]
        return None

    def _asked(self, texts: list[str]) -> list[list[float]] | None:
        """The vectors, or None if the texts are too long; other failures are tried again, then raised."""
        for k in range(RETRIES + 1):
            status, said = self.transport(texts)
            if status == 200:
                return said
            if 400 <= status < 500 and status != 429:
                if any(w in str(said).lower() for w in TOO_LONG):
                    return None
                raise RuntimeError(f"the service refused: {status} {said}")
            if k < RETRIES:
                time.sleep(self.pause_s * 2**k)
        raise RuntimeError(f"the service failed: {status} {said}")


def embedded(texts: DataFrame, make: Callable[[], HttpProvider]) -> DataFrame:
    """(id, vec) of (id, text), a provider for each task; texts that can't be embedded have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for b in batches:
            yield pd.DataFrame({"id": b.id, "vec": provider.embed([t or "" for t in b.text])})

    schema = texts.select("id").schema.add("vec", T.ArrayType(T.DoubleType()))
    return texts.select("id", "text").mapInPandas(run, schema).where("vec IS NOT NULL")


@dataclass(frozen=True)
class Models:
    """Models side by side: each with its own vectors, one of them the default; indexing and search may use others."""

    by_name: dict[str, object]
    default: str

    def get(self, name: str | None = None):
        found = self.by_name.get(name or self.default)
        if found is None or not found.available:
            raise Unavailable(f"no model {name or self.default!r}")
        return found

    def vectors(self, every: DataFrame, name: str | None = None) -> DataFrame:
        """The vectors (id, vec) of one model of a table (model, id, vec)."""
        self.get(name)
        return every.where(F.col("model") == (name or self.default)).select("id", "vec")
