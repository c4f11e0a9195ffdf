"""The near-duplicate stage of the pipeline against brute force over five-word shingles."""

import re

import corpus_pipeline
import duckdb
import numpy as np
from strandgraph.llm import nearcopies, simhash


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def _classes(docs):
    sets = {d: _shingles(t) for d, t in docs}
    root = {d: d for d in sets}
    pairs = []
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and common / (len(sets[a]) + len(sets[b]) - common) >= 0.8:
                pairs.append((a, b))
    for _ in sets:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root, pairs


def _edited(rng, words, n):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = f"x{rng.integers(10**9)}"
    return " ".join(out)


def test_stage_links_copies_that_differ_in_many_bits(spark):
    rng = np.random.default_rng(4)
    docs = []
    for _ in range(40):
        words = [f"w{i}" for i in rng.integers(0, 5000, 150)]
        docs += [(len(docs) + k, _edited(rng, words, n)) for k, n in enumerate((0, 2, 6))]
    words = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    docs += [(len(docs) + k, _edited(rng, words, 2)) for k in range(60)]  # most of these pairs are alike, some only by others
    root, pairs = _classes(docs)
    text = dict(docs)
    far = [1 for a, b in pairs if (simhash.fingerprint(text[a].encode()) ^ simhash.fingerprint(text[b].encode())).bit_count() > 3]
    assert len(far) > 20
    df = spark.createDataFrame([(d, t, "n") for d, t in docs], "doc_id long, text string, node string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(df).collect()} == root
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))


def test_documents_table_has_full_recall(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    root, _ = _classes(duckdb.sql(f"SELECT doc_id, text FROM '{path}'").fetchall())
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(spark.read.parquet(path)).collect()} == root


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(5, None, "x"), (3, "", "y"), (9, " \n", "z"), (None, "a b c d", "n"), (7, "a b c d", "n"), (7, "a b c d", "n"), (8, "A B C D", "n"), (1, "word " * 5000, "long")],
        "doc_id long, text string, keys string",
    )
    got = {tuple(r) for r in nearcopies.near_copies(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (None, 7), (7, 7), (8, 7), (1, 1)}
    assert nearcopies.near_copies(docs.limit(0)).count() == 0
