import re

import corpus_pipeline
from strandgraph.llm import rules

DIR = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    given, texts = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, given, DIR)
        out.write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            texts[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        given = out
    first = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = texts["toxicity"]
    assert not [i for i in first.keys() - clean.keys() if i in labels and not labels[i]["toxic"]]
    good = texts["quality rules"]
    assert good.keys() <= clean.keys()
    for i in clean:
        n, *_, rep = rules.statistics(clean[i].encode())[:5]
        if n < 20 or 100 * rep > 30 * n:
            assert i not in good
    lines = texts["line dedup"]
    assert lines.keys() == good.keys()
    assert all(set(lines[i].split("\n")) <= set(good[i].split("\n")) | {""} for i in lines)
    unique = texts["simhash near-dedup"]
    assert all(unique[i] == lines[i] for i in unique)
    assert len({re.sub(r"\s+", " ", t.lower()) for t in unique.values()}) == len(unique)
    assert {r["doc_id"] for r in given.collect()} == unique.keys()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
