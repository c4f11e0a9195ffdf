"""SimHash, line and embedding duplicates against brute force."""

import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandgraph.llm import embedding, linededup, queries, simhash

DIR = "/root/testdata/sf0.001"


def _fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(ids, linked):
    label = list(range(len(ids)))
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(linked[i]))], key=lambda k: ids[k]) for i in range(len(ids))]
        if new == label:
            return [ids[k] for k in label]
        label = new


def test_simhash_query_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet' ORDER BY doc_id").fetchall()
    fp = np.array([_fingerprint(t) for _, t in rows], np.uint64)
    want = _classes([i for i, _ in rows], np.bitwise_count(fp[:, None] ^ fp[None]) <= 3)
    got = sorted(tuple(r) for r in queries.op1_simhash(spark, DIR).collect())
    assert got == [(i, f"{int(f):016x}", c) for (i, _), f, c in zip(rows, fp, want, strict=True)]


def test_simhash_links_are_exact_in_dense_groups(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, dtype=np.int64)
    fps = {int(centre)}
    while len(fps) < 1500:  # a hot bucket, several blocks
        x = int(centre)
        for b in rng.choice(40, rng.integers(1, 4), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 500)}
    fps = sorted(fps)
    arr = np.array(fps, np.int64).view(np.uint64)
    want = _classes(list(range(len(fps))), np.bitwise_count(arr[:, None] ^ arr[None]) <= 3)
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, fp long")
    from strandgraph.operators.components import components
    from strandgraph.storage import Scratch

    s = Scratch(spark)
    found = {r["node"]: r["component"] for r in components(simhash.links(s.write(nodes), 3, s), s).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_thresholds_cover_every_pair():
    rng = np.random.default_rng(5)
    for m in range(2, 6):
        cost = rng.random((m, 4)).tolist()
        cost = [[0.0, *row[1:]] for row in cost]
        ts = simhash.allocate(cost, 3 - m + 1)
        assert sum(ts) == 3 - m + 1 and min(ts) >= -1


def test_simhash_edge_cases(spark):
    docs = spark.createDataFrame(
        [(5, None, "x"), (3, "", "y"), (9, " \n", "z"), (None, "a b c d", "n"), (7, "a b c d", "n"), (7, "a b c d", "n"), (8, "A B C D", "n"), (1, "word " * 5000, "long")],
        "doc_id long, text string, fp string",
    )
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (None, 7), (7, 7), (8, 7), (1, 1)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1 for r in kept.collect())) == [-1, 1, 3, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def _line_oracle(docs, least):
    """Deletes, by definition: all lines in any run of ``least`` words or more that occurred before."""
    seqs = [(d, [(i, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]) for d, t in docs]
    seen, gone = {}, {d: set() for d, _ in docs}
    for d, s in seqs:
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                key = tuple(x for _, x, _ in s[a:b])
                if sum(w for *_, w in s[a:b]) < least:
                    continue
                if key in seen and seen[key] != (d, a):
                    gone[d] |= {i for i, *_ in s[a:b]}
                seen.setdefault(key, (d, a))
    for d, s in seqs:  # what stands between two deleted neighbours goes too
        for (i, *_), (j, *_) in zip(s, s[1:], strict=False):
            if i in gone[d] and j in gone[d]:
                gone[d] |= set(range(i, j))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab = [" ".join(rng.choice(list("abcdef"), n)) for n in (1, 1, 2, 3, 4, 6, 9)] + ["", " "]
    docs = [(d, "\n".join(rng.choice(vocab, rng.integers(1, 14)))) for d in range(25)]
    docs += [(30, None), (31, ""), (32, "\n\n")]
    df = spark.createDataFrame([(d, t, 0, "c") for d, t in docs], "doc_id long, text string, n_chars long, runs string").repartition(3)
    for least in (1, 5, 9):
        got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df, least).collect()}
        assert got == _line_oracle(docs, least), least


def test_lines_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long, 9, "a"), (2, f"x\n{long}\ny", 9, "b"), (1, long, 9, "a"), (None, long, 9, "n"), (3, f"{long}\n{long}", 9, "c")], "doc_id long, text string, n_chars long, h string")
    out = linededup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()), key=str)
    assert got == sorted([(0, long, 9), (1, "", 0), (1, "", 0), (2, "x\ny", 3), (3, "", 0)], key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_embedding_query_has_full_recall(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DIR}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.array([e for _, e in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = _classes([i for i, _ in rows], near)
    got = sorted(tuple(r) for r in queries.op6_embedding(spark, DIR).collect())
    assert got == [(i, int(n), c, c == i) for (i, _), n, c in zip(rows, near.sum(1), want, strict=True)]


def test_embedding_dense_groups_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=16)
    x = [base + rng.normal(size=16) * 0.12 for _ in range(90)] + list(rng.normal(size=(60, 16)))
    x += [x[0]] * 5
    vec = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [1.0, 2.0]), (None, vec[0][1])]
    monkeypatch.setattr(embedding, "BLOCK", 32)
    monkeypatch.setattr(embedding, "CELL", 40)
    df = spark.createDataFrame([(i, e, "x") for i, e in vec + odd], "vec_id long, embedding array<float>, node string")
    y = np.array([e for _, e in vec])
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding.near_duplicates(df).collect()}
    found = sum(got[i][0] for i, _ in vec)
    assert found >= 0.99 * near.sum()
    assert all(got[i][0] <= near[i].sum() for i, _ in vec)
    assert {got[i][1] for i in range(90)} == {0} and got[0][2]
    assert all(got[i] == (0, i, True) for i in range(900, 906))
    assert got[None] == (0, None, False)
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_line_query_matches_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op5_linededup"]).fetchall())
    got = sorted(tuple(r) for r in queries.op5_linededup(spark, DIR).collect())
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 70_000])
def test_fingerprint_lengths(n):
    text = " ".join(f"w{i % 977}" for i in range(n))
    if n < 10:
        assert simhash.fingerprint(text.encode()) == _fingerprint(text)
    else:
        assert simhash.fingerprint(text.encode()) == simhash.fingerprint((text + " ").encode())


def test_bit_statistics(spark):
    df = spark.createDataFrame([(3,), (1,), (-1,)], "fp long")
    n, co = simhash.bit_statistics(df.withColumn("x", F.lit(1)))
    assert (n, co[0, 0], co[0, 1], co[63, 0], co[2, 1]) == (3, 3, 2, 1, 1)
