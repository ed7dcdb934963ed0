"""The pipeline's stages one by one against plain Python versions, each on what the one before kept."""

import os

import pytest

import corpus_pipeline
from codequery.llm import pii, quality
from codequery.llm.queries import TOKENIZER
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(DIR) and os.path.exists(TOKENIZER)), reason="tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    def ran(name, number):
        stages[name](spark, docs, DIR).write.parquet(str(tmp_path / str(number)))
        return spark.read.parquet(str(tmp_path / str(number)))

    def rows(df):
        return sorted(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())

    before = rows(docs)
    kept = brute.quality_kept([(r[2], r[3], r[1]) for r in before], dict(quality.RATES), quality.FENCE, quality.LEAST_ROWS)
    docs = ran("quality rules", 0)
    want = [r for r, k in zip(before, kept) if k]
    assert rows(docs) == want
    docs = ran("simhash near-dedup", 1)
    left = {r[0] for r in rows(docs)}
    texts = {r[0]: r[1] for r in want}
    for a in texts:
        for b in texts:
            if a < b and abs(len(texts[a]) - len(texts[b])) < 0.2 * len(texts[a]) + 50:
                j = brute.jaccard(texts[a], texts[b])
                assert j < 0.9 or not {a, b} <= left
    # what went has a smaller document near it, and a document without one stays
    for a in texts:
        best = max((brute.jaccard(texts[a], texts[b]) for b in texts if b < a and abs(len(texts[a]) - len(texts[b])) < len(texts[a])), default=0)
        assert a in left if best < 0.6 else True
        assert a not in left if best >= 0.9 else True
    want = [r for r in want if r[0] in left]
    assert rows(docs) == want
    field = pii.train(pii.labelled())
    clean = [pii.masked(r[1], spans) for r, (_, spans) in zip(want, pii.spans_of([r[1] for r in want], field))]
    want = [(r[0], t, r[2], r[3], r[4] if t == r[1] else len(t)) for r, t in zip(want, clean)]
    docs = ran("pii", 2)
    assert rows(docs) == want
    size, _, taken = brute.mix_taken([(r[0], r[3], r[1]) for r in want])
    docs = ran("source mixing", 3)
    words = {}
    for r in docs.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
    assert words == {r[0]: t for r, t in zip(want, taken) if t}
    whole = {r[0]: r[1] for r in want}
    assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text != whole[r.doc_id])
    assert sum(r.text != whole[r.doc_id] for r in docs.collect()) <= len({r[3] for r in want})
    last = ran("sentencepiece", 4)
    assert last.count() == docs.count() and last.where("NOT round_trip OR ids IS NULL").count() == 0
    assert set(docs.columns) < set(last.columns)


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0 and "ids" in out.columns
