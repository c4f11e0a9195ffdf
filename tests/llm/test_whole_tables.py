"""Learned operators on whole tables, against exhaustive or plainly written versions, and the pipeline's edge cases."""

import itertools
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import ordinal, queries, rules, toxicity
from strandgraph.llm.letters import CLASSES, letter_codes, trigram_counts

DIR, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def _labels(spark, name, path):
    return {r["doc_id"]: r[name] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}


def test_toxicity_on_held_out_rows(spark):
    known = _labels(spark, "toxic", BIG)
    got = [r for r in queries.op4_toxicity(spark, BIG).collect() if r["doc_id"] in known and r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got) and len(got) > 50
    right = sum(r["predicted"] == known[r["doc_id"]] for r in got)
    assert right >= 0.95 * len(got)
    bad = [r["score"] for r in got if known[r["doc_id"]]]
    good = [r["score"] for r in got if not known[r["doc_id"]]]
    assert len(bad) > 50 and np.mean([b > g for b in bad for g in good]) > 0.85  # a sixth of the toxic labels stands at texts without a toxic word
    assert np.mean([g >= 0.5 for g in good]) < 0.01


def test_decoding_is_exhaustive_search():
    counts = np.zeros(CLASSES**3, np.int64)
    for text in ("the idiot said hello to the other idiot", "a solid edit of the tide", "lost in the list"):
        counts += trigram_counts(letter_codes(text))
    model = toxicity.CharModel(counts)

    def weight(s):
        x = [0, 0, *[0 if c == " " else int(k) for c, k in zip(s, letter_codes(s), strict=True)], 0]
        return sum(float(model.log[a, b, c]) for a, b, c in zip(x, x[1:], x[2:], strict=False))

    rng = random.Random(8)
    for _ in range(60):
        slots = toxicity.lattice("".join(rng.choices("1d0t!5e43alo$", k=rng.randint(3, 7))))
        paths = ["".join(p) for p in itertools.product(*slots)]
        assert weight(model.decode(slots)) == pytest.approx(max(map(weight, paths)), abs=1e-4)


def test_rules_verdict_is_a_plain_walk(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    forest, limit = rules.fit(docs, labels)

    def path(tree, x):
        feature, cut, left, right, length = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] < cut[at] else right[at]
        return length[at]

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rules.judge(docs, labels).collect():
        n, *_, rep = (found := rules.statistics((texts[r["doc_id"]] or "").encode()))[:5]
        failed = n < 20 or 100 * rep > 30 * n
        score = 2.0 ** (-np.mean([path(t, found[5:]) for t in forest.trees]) / forest._mean_path(forest.size))
        assert r["score"] == pytest.approx(score) and r["kept"] == (not failed and score <= limit)


def test_rules_are_fitted_on_all_rows(spark):
    said = F.expr("array_join(transform(sequence(1, 24), k -> if(pmod(hash(id, k), 40) < pmod(id, 40), concat('w', pmod(hash(k, id), 50), '!'), concat('word', k))), ' ')")
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), said.alias("text"))
    labels = docs.select("doc_id", F.expr("int(pmod(doc_id, 40) < 38)").alias("quality"))
    forest, limit = rules.fit(docs, labels)
    found = {r["doc_id"]: rules.statistics(r["text"].encode()) for r in docs.collect()}
    kept = [i for i, f in found.items() if f[0] >= 20 and 100 * f[4] <= 30 * f[0]]
    rows = np.array([found[i][5:] for i in kept])
    assert forest.size == len(kept) > 22_000
    for feature, cut, left, right, length in forest.trees[:5]:
        inside, depth = {0: np.arange(len(rows))}, {0: 0}
        for at in range(len(feature)):  # a node's children come after it
            if feature[at] < 0:
                assert length[at] == pytest.approx(depth[at] + forest._mean_path(len(inside[at])))
                continue
            here = rows[inside[at], feature[at]] < cut[at]
            inside[left[at]], inside[right[at]] = inside[at][here], inside[at][~here]
            depth[left[at]] = depth[right[at]] = depth[at] + 1
    score, good = forest.score(rows), np.array([i % 40 < 38 for i in kept])
    best = np.sort(score[good])
    floor = best[min(len(best) - 1, int(np.ceil((1 - rules.MAX_LOSS) * len(best))))]
    assert limit == pytest.approx((floor + score[~good & (score > floor)].min()) / 2, abs=1e-12)
    twice = rules.fit(docs.union(docs), labels)
    assert twice[1] == limit and np.array_equal(twice[0].score(rows), score)


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(5)
    values = [*rng.random(500), *[0.25] * 300, *np.nextafter(0.25, [0, 1]), 0.0, 1e-300, 1.0]
    scores = spark.createDataFrame([(float(v),) for v in values], "score double").cache()
    for k in (0, 1, 2, 100, 300, 500, len(values) - 1):
        assert rules._kth(scores, k, 0.0, 1.0) == sorted(values)[k]


def test_rules_take_any_id(spark):
    rows = [(2**62 + 5 + i, f"some words that number {i} says " * 6) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(rows)], "doc_id long, quality int")
    assert rules.judge(docs, labels).count() == rules.judge(docs, labels).select("doc_id").distinct().count() == 30


def test_ordinal_loss_is_lowest_at_the_fit():
    rng = np.random.default_rng(3)
    n, y = 120, np.arange(120) % 3
    at = np.concatenate([np.column_stack([1 + y, rng.integers(5, 60, n)]).ravel()])
    row, value = np.repeat(np.arange(n), 2), np.ones(2 * n)
    model = ordinal.Ordinal(3)

    def loss(w, cuts):
        z = np.bincount(row, value * w[at], n)
        full = np.concatenate(([-np.inf], cuts, [np.inf]))
        p = 1 / (1 + np.exp(-(full[y + 1] - z))) - 1 / (1 + np.exp(-(full[y] - z)))
        return -np.log(np.maximum(p, 1e-12)).mean() + ordinal.RIDGE / 2 * (w**2).sum()

    model.fit(row, at, value, y)
    fitted = loss(model.weights, model.cuts)
    assert fitted < 0.2 * loss(np.zeros(ordinal.DIM), np.array([-0.5, 0.5])) and model.cuts[0] < model.cuts[1]
    for k in (1, 2, 3, 10):  # no single step along a weight is far better
        for step in (-0.3, 0.3):
            w = model.weights.copy()
            w[k] += step
            assert loss(w, model.cuts) > fitted - 0.02


def test_ordinal_on_rows_it_did_not_see(spark):
    path = "/root/testdata/sf0.01"
    docs, graded = spark.read.parquet(f"{path}/documents.parquet"), ordinal.grades_of_labels(spark.read.parquet(f"{path}/labels.parquet"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    got = ordinal.grade(docs, graded.filter(part != 1)).join(graded.filter(part == 1), "doc_id").filter("grade is not null").collect()
    bad, best = ([r["expected_grade"] for r in got if r["grade"] == g] for g in (0, 2))
    assert len(bad) > 5 and len(best) > 20
    assert np.mean([b < g for b in bad for g in best]) > 0.9
    odd = spark.createDataFrame([(1, "same text"), (1, "same text"), (2, "word " * 40_000), (None, None)], "doc_id long, text string")
    again = ordinal.grade(odd, graded).collect()
    assert len(again) == 4 and len({r["expected_grade"] for r in again if r["doc_id"] == 1}) == 1


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, stage):
    clean = " ".join(f"word{i} that says" for i in range(30))
    rows = [(1, clean, "en"), (1, clean, "en"), (2, None, None), (3, "", "en"), (None, clean + " more", "de"), (4, "\n".join([f"line {i} of a long text" for i in range(9000)]), "en"), (5, clean.upper(), "en")]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), "x", "y", "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, d string, runs string, node string")
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, DIR)
    got = out.collect()
    if name == "best-fit packing":
        assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, None}
        return
    assert out.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    if name == "quality rules":  # texts of fewer than 20 words go
        assert not {2, 3} & {r["doc_id"] for r in got}
    elif name == "simhash near-dedup":
        assert [i for _, i in ids] == [1, 2, 4, 0]  # of 1 one row, of 2 and 3 the first, 5 is 1 in capitals; rows without an id all stay
    else:
        assert len(got) == len(rows)
