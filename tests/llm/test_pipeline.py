"""Each stage against brute force over its own input."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tablelens.llm import quality  # noqa: E402
from tablelens.llm.common import store  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(store(stage(spark, frames[-1], SF)))
    return frames


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_columns_and_lengths(stages):
    for frame in stages[1:5]:
        assert frame.columns == stages[0].columns
        assert frame.filter("n_chars <> length(text)").count() == 0


def test_quality_stage(stages, spark):
    before, after = texts(stages[0]), texts(stages[1])
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(stages[0]).collect()}
    assert after == {d: t for d, t in before.items() if verdict[d]}
    assert not any(brute.quality(t)[-1] for t in after.values())
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    clean = {d for d in good if not brute.quality(before[d])[-1]}
    assert len(clean & set(after)) >= 0.99 * len(clean)


def test_simhash_stage(stages):
    before = sorted(texts(stages[1]).items())
    prints = [brute.simhash(t) for _, t in before]
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = brute.components(near, len(prints))
    assert texts(stages[2]) == {d: t for i, (d, t) in enumerate(before) if roots[i] == i}


def test_repeats_stage(stages):
    before = sorted(texts(stages[2]).items())
    lost = {d: n for d, _, n, _, _ in brute.repeats(before, corpus_pipeline.REPEAT_BYTES)}
    after = texts(stages[3])
    for d, t in before:
        gone = len(t.encode()) - len(after[d].encode())
        assert lost[d] <= gone <= lost[d] + 12 * bool(lost[d])  # characters cut at either end of a span go whole
        if not lost[d]:
            assert after[d] == t


def test_secrets_stage(stages):
    before, after = texts(stages[3]), texts(stages[4])
    for d, t in before.items():
        assert not brute.secrets(after[d])
        if after[d] != t:
            assert "[SECRET]" in after[d]
        elif brute.secrets(t):
            raise AssertionError(d)


def test_packing_stage(stages):
    tokenizer = brute.word_tokenizer()
    expected = [p for d, t in texts(stages[4]).items() for p in brute.pieces(d, t, tokenizer, 4096)]
    assert sorted(tuple(r)[:5] for r in stages[5].collect()) == sorted(expected)


def test_run(stages, spark):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()
