"""Chunkers: texts cut to a budget at good places, with some overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequery.functions.text import first_word

BUDGET, RESERVE, SINGLE_RESERVE, OVERLAP_CHARS = 8000, 400, 10, 200
MARK = "// ..."
#: Characters of chunks that a worker gathers before it hands them on.
OUT_CHARS = 4_000_000
CHUNK = "id long, chunk int, start_line int, end_line int, text string"


def pack_lines(body: str, prefix: str = "", tail: bool = False, budget: int = BUDGET) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of chunks of a body: methods repeat their first two lines, documents the last three before."""
    if len(body) <= budget - len(prefix) - SINGLE_RESERVE:
        return [(1, body.count("\n") + 1, prefix + body)]
    lines, room, out, at = body.split("\n"), max(1, budget - len(prefix) - RESERVE), [], 0
    head = [x for x in lines if x.strip()][:2]
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) + 1 <= room):
            size += len(lines[end]) + 1
            end += 1
        if end < len(lines):
            blank = next((i for i in range(end - 1, at, -1) if not lines[i].strip()), None)
            if blank and sum(len(x) + 1 for x in lines[at:blank]) > room / 2:
                end = blank + 1
        over = (lines[max(0, at - 3) : at] if tail else head) if at else []
        kept = "\n".join([*over, MARK, ""]) if over else ""
        out.append((at + 1, end, prefix + kept + "\n".join(lines[at:end])))
        at = end
    return out


def split_text(text: str, budget: int = BUDGET, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Pieces of a text, cut at a blank line, else a line end, a sentence end, a space, or where it must."""
    out, at = [], 0
    while len(text) - at > budget:
        window = text[at : at + budget]
        cut = next((k + len(s) for s in ("\n\n", "\n", ". ", " ") if (k := window.rfind(s)) > budget // 2), budget)
        out.append(text[at : at + cut])
        at += max(cut - overlap, 1)
    return [*out, text[at:]]


def chunked(docs: DataFrame, prefix: str | None = None, tail: bool = False, budget: int = BUDGET) -> DataFrame:
    """Line chunks of (id, body[, prefix])."""

    cut = lambda row: [(k, *c) for k, c in enumerate(pack_lines(row["body"] or "", row["prefix"] or "", tail, budget))]
    return _each(docs.select("id", "body", F.col(prefix).alias("prefix") if prefix else F.lit("").alias("prefix")), cut, CHUNK)


def _each(docs: DataFrame, cut: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``cut`` makes of each document, its id before them and their text last. Documents are taken one by one
    and what they give leaves every ``OUT_CHARS``, so that a worker holds no second copy of a batch."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for at in range(b.num_rows):
                row = {n: b.column(k)[at].as_py() for k, n in enumerate(b.schema.names)}
                for r in cut(row):
                    rows.append((row["id"], *r))
                    held += len(r[-1]) + 100
                    if held >= OUT_CHARS:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)

    return docs.mapInArrow(run, schema)


def text_chunks(docs: DataFrame, budget: int = BUDGET, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Character chunks of (id, body)."""

    return _each(docs.select("id", "body"), lambda row: list(enumerate(split_text(row["body"] or "", budget, overlap))), "id long, chunk int, text string")


def class_groups(members: DataFrame) -> DataFrame:
    """(class, part, names): members by the first word of their name where two or more share it, the others as the header."""
    word = F.when(F.col("name") == "<init>", "").otherwise(first_word(F.col("name")))
    sizes = members.withColumn("part", word).groupBy("class", "part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
    part = F.when(F.col("n") >= 2, F.col("part")).otherwise("(header)")
    rows = sizes.withColumn("part", part).groupBy("class", "part").agg(F.flatten(F.collect_list("names")).alias("names"))
    return rows.select("class", "part", F.array_join(F.array_sort("names"), ",").alias("names"))


def segmented(word: str, vocabulary: set[str]) -> list[str]:
    """The fewest vocabulary words that make up a word, longest first; the word itself if none do."""
    best: list[list[str] | None] = [[]] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if best[start] is not None and word[start:end] in vocabulary and (best[end] is None or len(best[start]) + 1 < len(best[end])):
                best[end] = [*best[start], word[start:end]]
    return best[-1] or [word]
