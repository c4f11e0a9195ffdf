"""Quality rules judged by an isolation forest on rule statistics.

Statistics are computed over every whole text, once, and written.  The random
splits of a tree lie in the ranges of its own ``TREE_ROWS`` rows, drawn from all
rows that pass the base rules, as the method has it.  What is learned is counted
in whole: all rows that pass go down every tree, a leaf's path length follows
from how many of them end there, and the threshold comes from all labelled rows.

Defined results: a null text has no words and fails the base rules; rows without
a label do not take part in the calibration; without labelled rows of both kinds
nothing is rejected beyond the base rules; repeated rows give repeated results
and count once in the forest and the threshold;
extra columns are ignored; rows with a null ``doc_id`` are judged like any other
and have no label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.arrowutil import give_back
from strandgraph.storage import Scratch

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Trees, rows whose ranges a tree's splits are drawn from.
TREES, TREE_ROWS = 100, 256
#: Share of good labelled rows that the threshold may reject.
MAX_LOSS = 0.005
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["f_word_len", "f_symbols", "f_upper", "f_marks", "f_same_next", "f_symbol_words"]
#: Rates are taken as if each text had so many more words of five ordinary letters, lest short texts look odd by chance.
PRIOR = 100
SEED = 11
#: Parts into which a range of scores is divided at a time to find an order statistic.
PARTS = 4096

_table = np.zeros(256, np.uint8)
_table[list(SYMBOLS)] = 1
_table[list(b" \t\n\x0b\x0c\r")] |= 2
_table[0x80:0xC0] |= 4  # continuation bytes of UTF-8
_table[list(b"!?;:")] |= 8
_table[65:91] |= 16


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the sequence."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    if len(np.unique(h)) == n:  # different sums: different windows
        return 0
    name = ids
    step = 1
    while step < window:  # exact names of windows of 2, 4, 8 words
        pair = name[:-step].astype(np.int64) * (int(name.max()) + 1) + name[step:]
        name = np.unique(pair, return_inverse=True)[1]
        step *= 2
    many = np.bincount(name)[name] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(many)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple:
    """``COUNTS`` and ``FEATURES`` of one text."""
    kind = _table[np.frombuffer(text, np.uint8)]
    words = text.split()
    n = len(words)
    chars = int(((kind & 6) == 0).sum())
    symbols = int((kind & 1).sum())
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    name: dict[bytes, int] = {}
    ids = np.array([name.setdefault(w, len(name)) for w in words], np.int64)
    rep = repeat_words(ids)
    same = int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0
    marked = sum(1 for w in words if w[-1] in SYMBOLS or w[0] in SYMBOLS)
    more, letters = n + PRIOR, chars + 5 * PRIOR
    rates = (letters / more, symbols / letters, int((kind & 16 > 0).sum()) / letters, int((kind & 8 > 0).sum()) / more, same / more, marked / more)
    return (n, chars, symbols, dup, rep, *rates)


def measure(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id`` (a long), ``row_hash`` of id and text, the counts, the features and ``base_failed`` per row."""
    schema = ", ".join(["doc_id long", "row_hash long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t.as_py() or b"") for t in b.column(2)]
            cols = [pa.array([g[i] for g in got], pa.int64() if i < len(COUNTS) else pa.float64()) for i in range(len(COUNTS) + len(FEATURES))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "row_hash", *COUNTS, *FEATURES])
        give_back()

    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    src = docs.select(key.alias("doc_id"), F.xxhash64(F.lit(SEED), key, text).alias("row_hash"), text.cast("binary").alias("text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return src.mapInArrow(run, schema).withColumn("base_failed", failed)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The features of a batch, a row each."""
    t = pa.Table.from_batches([batch])
    return np.column_stack([t.column(c).to_numpy() for c in FEATURES]).astype(np.float64)


class IsolationForest:
    """Random axis-parallel splits of each tree's own draw of rows, and path lengths from the rows counted in its leaves; short paths mark anomalies."""

    def __init__(self, draws: list[np.ndarray], seed: int = SEED):
        rng = np.random.default_rng(seed)
        most = max(map(len, draws), default=0)
        self.size = 0
        self.depth = max(1, int(np.ceil(np.log2(max(most, 2)))))
        self.trees = [self._grow(rows, rng) for rows in draws if len(rows) > 1]

    @staticmethod
    def _mean_path(n: int) -> float:
        """The mean path length of a failed search among ``n`` rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []

        def node(x: np.ndarray, depth: int) -> int:
            k = len(feature)
            for held, v in ((feature, -1), (cut, 0.0), (left, k), (right, k), (path, float(depth))):
                held.append(v)
            spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 and depth < self.depth else []
            if len(spread):
                f = int(rng.choice(spread))
                feature[k], cut[k] = f, rng.uniform(x[:, f].min(), x[:, f].max())
                side = x[:, f] < cut[k]
                left[k], right[k] = node(x[side], depth + 1), node(x[~side], depth + 1)
            return k

        node(rows, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(path)

    def leaves(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree, the node at which each row ends."""
        every = np.arange(len(rows))
        for feature, cut, left, right, _ in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(rows[every, np.maximum(f, 0)] < cut[at], left[at], right[at]))
            yield at

    def weigh(self, counts: list[np.ndarray], size: int) -> None:
        """Add to the path lengths what ``counts`` of ``size`` rows, per tree and node, make them go on below their leaves."""
        self.size = size
        for tree, n in zip(self.trees, counts, strict=True):
            tree[4][:] += [self._mean_path(int(k)) for k in n]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores in 0 .. 1; 0 throughout where no tree could be grown."""
        if not self.trees:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for tree, at in zip(self.trees, self.leaves(rows), strict=True):
            total += tree[4][at]
        return 2.0 ** (-total / len(self.trees) / self._mean_path(self.size))


def _ranks(keys: np.ndarray, tree: int) -> np.ndarray:
    """A number below 2^63 for each key, in another random order for each tree (SplitMix64)."""
    x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (tree + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def _draw(pool: DataFrame, n: int) -> list[np.ndarray]:
    """For each tree the ``TREE_ROWS`` of all ``n`` rows of ``pool`` that come first in its order.

    Tasks pass on only ranks below a bound that twice as many rows are expected to
    keep, so the driver gets about ``2 * TREES * TREE_ROWS`` rows of numbers.
    """
    bound = np.uint64(2**63 * min(1.0, 2 * TREE_ROWS / max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks = [_ranks(b.column(0).to_numpy(), t) for t in range(TREES)]
            at = [np.flatnonzero(r < bound) for r in ranks]
            tree = np.repeat(np.arange(TREES, dtype=np.int32), [len(a) for a in at])
            rank = np.concatenate([r[a] for r, a in zip(ranks, at, strict=True)]).astype(np.int64)
            rows = _matrix(b)[np.concatenate(at)]
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(rank), *map(pa.array, rows.T)], ["tree", "rank", *FEATURES])

    types = ", ".join(f"{c} double" for c in FEATURES)
    got = pool.select("row_hash", *FEATURES).mapInArrow(run, f"tree int, rank long, {types}").toArrow()
    tree, rank, rows = got.column("tree").to_numpy(), got.column("rank").to_numpy(), np.column_stack([got.column(c).to_numpy() for c in FEATURES])
    order = np.lexsort([*rows.T, rank, tree])
    ends = np.searchsorted(tree[order], np.arange(TREES + 1))
    return [rows[order[a : min(b, a + TREE_ROWS)]] for a, b in zip(ends, ends[1:], strict=False)]


def _counts(pool: DataFrame, forest: IsolationForest) -> list[np.ndarray]:
    """How many rows of ``pool`` end at each node of each tree."""
    nodes = [len(t[0]) for t in forest.trees]
    starts = np.concatenate(([0], np.cumsum(nodes))).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(starts[-1], np.int64)
        for b in batches:
            for start, at in zip(starts, forest.leaves(_matrix(b)), strict=False):
                held += np.bincount(start + at, minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["node", "n"])

    got = pool.select(*FEATURES).mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(starts[-1], np.int64)
    total[got.column("node").to_numpy()] = got.column("n").to_numpy()
    return np.split(total, starts[1:-1])


def _kth(scores: DataFrame, k: int, low: float, high: float) -> float:
    """The ``k``-th smallest ``score``, from 0, of values from ``low`` to ``high``: the part that holds it is divided until its values are one."""
    while low < high:
        part = F.floor((F.col("score") - low) / (high - low) * PARTS).alias("part")
        parts = scores.filter(F.col("score").between(low, high)).groupBy(part).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in sorted(parts.collect(), key=lambda r: r["part"]):
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def calibrate(scored: DataFrame, max_loss: float = MAX_LOSS) -> float:
    """``scored(good, score)`` -> the threshold above which most bad rows and at most ``max_loss`` of the good ones lie (infinite if there is none)."""
    kinds = {r["good"]: r for r in scored.groupBy("good").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()}
    if len(kinds) < 2:
        return float("inf")
    n = kinds[True]["n"]
    floor = _kth(scored.filter("good"), min(n - 1, math.ceil((1 - max_loss) * n)), kinds[True]["low"], kinds[True]["high"])
    first = scored.filter(~F.col("good") & (F.col("score") > floor)).agg(F.min("score")).first()[0]
    if first is None:
        return float("inf")
    return (floor + first) / 2  # as many bad rows as the loss allows, half way to the first


def _fit(measured: DataFrame, labels: DataFrame, scratch: Scratch, max_loss: float) -> tuple[IsolationForest, float]:
    """``fit`` on what ``measure`` gave."""
    pool = scratch.write(measured.filter("not base_failed").select("doc_id", "row_hash", *FEATURES).distinct(), compact=True)
    n = pool.count()
    forest = IsolationForest(_draw(pool, n))
    if forest.trees:
        forest.weigh(_counts(pool, forest), n)
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality").cast("int") > 0).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.score(_matrix(b)))], ["good", "score"])

    scored = pool.join(known, "doc_id").select("good", *FEATURES).mapInArrow(run, "good boolean, score double")
    return forest, calibrate(scratch.write(scored, compact=True), max_loss)


def fit(docs: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS) -> tuple[IsolationForest, float]:
    """A forest that has counted all rows of ``docs`` that pass the base rules and the score that calibration on all labelled ones allows.

    Only the trees' draws, counts of leaves and of ranges of scores reach the driver.
    """
    scratch = Scratch(docs.sparkSession)
    got = _fit(scratch.write(measure(docs)), labels, scratch, max_loss)
    scratch.keep_only()
    return got


def judge(docs: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """``docs(doc_id, text)``, ``labels(doc_id, quality)`` -> ``doc_id``, counts, features, ``base_failed``, ``score`` and ``kept`` per row."""
    scratch = Scratch(docs.sparkSession)
    measured = scratch.write(measure(docs))
    forest, limit = _fit(measured, labels, scratch, max_loss)
    scratch.keep_only(measured)
    rows = measured.drop("row_hash")
    cols = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = forest.score(_matrix(b))
            kept = ~pa.Table.from_batches([b]).column("base_failed").to_numpy() & (s <= limit)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(kept)], [*cols, "score", "kept"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{types}, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; only texts go to Python."""
    forest, limit = fit(docs, labels, max_loss)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        got = np.array([statistics(t.as_py() or b"") for t in texts], np.float64).reshape(-1, len(COUNTS) + len(FEATURES))
        failed = (got[:, 0] < 20) | (100 * got[:, 4] > 30 * got[:, 0])
        return pa.array(~failed & (forest.score(got[:, len(COUNTS) :]) <= limit))

    return docs.filter(good(F.col("text").cast("string").cast("binary")))
