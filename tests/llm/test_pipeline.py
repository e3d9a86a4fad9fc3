"""The pipeline stage by stage against brute force on the smallest tables."""

import collections

import corpus_pipeline
import pytest
from sylva.llm import packing
from sylva.llm.common import materialize
from test_training import linked, measured, secret_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_quality_drops_what_fails(stages):
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        n, _, _, _, again = measured(r["text"])
        if n < 50 or 100 * again > 50 * n:
            assert r["doc_id"] not in kept
    assert len(kept) > 0.6 * before.count()


def test_one_of_each_group(stages):
    _, before, after = stages[1]
    want = linked([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_secrets_are_gone(stages):
    _, before, after = stages[2]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        if secret_spans(old[r["doc_id"]]):
            assert "[SECRET]" in r["text"] and not secret_spans(r["text"])
        else:
            assert r["text"] == old[r["doc_id"]]


def test_mix_only_repeats_rows(stages):
    _, before, after = stages[3]
    old = {tuple(r) for r in before.collect()}
    times = collections.Counter(tuple(r) for r in after.collect())
    assert set(times) <= old and max(times.values()) <= 3


def test_packing_holds_every_copy(stages):
    _, before, after = stages[4]
    n = collections.Counter(r["doc_id"] for r in before.collect())
    whole = collections.Counter()
    for r in after.collect():
        whole[r["doc_id"]] += r["length"] / r["doc_tokens"]
    assert {i: round(x, 6) for i, x in whole.items()} == {i: float(k) for i, k in n.items()}
    assert packing.LENGTH == 2048


def test_run_is_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert found["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in found if n[:2] == "op" and n[2:3].isdigit()) == list(range(1, 11))
