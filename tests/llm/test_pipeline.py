"""The pipeline's stages against brute force on the smallest tables."""

import re

import corpus_pipeline as pipeline
from corvane.llm.store import settle
from tests_llm_support import components


def test_stages(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    words = lambda x: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower()))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {}
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, data), name)
        assert docs.schema == before.schema
        out[name] = [r["doc_id"] for r in docs.collect()]
    assert len(out["language_id"]) >= 0.98 * len(texts)
    group = components({k: texts[k] for k in out["language_id"]})
    assert sorted(out["near_duplicates"]) == sorted({c for _, c in group.values()})
    leaks = {k for k in out["near_duplicates"] if any(f" {words(i)} " in f" {words(texts[k])} " for i in items)}
    assert set(out["decontamination"]) == set(out["near_duplicates"]) - leaks
    assert set(out["mix_sources"]) <= set(out["decontamination"])
    rows = pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(out["mix_sources"])
    assert max(r["start"] + r["n_tokens"] for r in rows) == sum(r["n_tokens"] for r in rows)
