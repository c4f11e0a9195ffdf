"""Quality grades by cumulative-link regression on hashed text.

One weight per hashed feature is shared by all grades, ordered thresholds
separate them: P(grade <= j) = logistic(threshold_j - weights . features).  The
expected grade and the probability of the best grade serve for selection.

Features of a text: its words, their beginnings and their sign endings, hashed
to ``DIM`` places, and whether a word repeats the one before; each counts by its
number over the square root of the number of words.

Defined results: null and empty texts have no features and get the thresholds'
own probabilities; grades that no labelled row has get thresholds close to their
neighbours; without labelled rows the expected grade is the middle one and
nothing is selected; every row gives one row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.arrowutil import split_words, text_blocks

#: Hashed places, graded rows that the model is fitted on at most, steps of the fit, ridge.
DIM, GRADED, STEPS, RIDGE = 1 << 13, 3_000, 250, 1e-4
_TAIL = re.compile(r"[^\w]+$")


def places(word: str) -> list[int]:
    """The hashed features of a word."""
    low = word.lower()
    tail = _TAIL.search(low)
    core = low[: tail.start()] if tail else low
    said = [f"w{core}", f"b4{core[:4]}", f"b5{core[:5]}", f"e{tail[0][:4] if tail else ''}", f"u{word.isupper() and len(core) > 1}"]
    return [zlib.crc32(s.encode("utf-8", "surrogatepass")) % (DIM - 1) + 1 for s in said]


def _sparse(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    offsets, codes, words = split_words(pc.replace_substring(texts, "\n", " "))
    of = np.array([places(w) if w else [-1] * 5 for w in words], np.int64).reshape(-1, 5)
    for a, z in zip(offsets[:-1], offsets[1:], strict=True):
        c = codes[a:z]
        p = of[c]
        p = p[p[:, 0] >= 0]
        same = int((c[1:] == c[:-1]).sum())
        at, n = np.unique(np.concatenate((p.ravel(), np.zeros(same, np.int64))), return_counts=True)
        yield at, (n / math.sqrt(max(len(p), 1))).astype(np.float32)


class Ordinal:
    """Weights and ordered thresholds."""

    def __init__(self, grades: int):
        self.weights = np.zeros(DIM)
        self.cuts = np.arange(grades - 1) - (grades - 2) / 2

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """P(grade <= j) for all grades but the last, a row per text."""
        return 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - z[:, None], -30, 30)))

    def fit(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray) -> None:
        """Full-batch Adam on the mean negative log-likelihood; ``row``, ``at``, ``value`` hold the sparse features."""
        if not len(y):
            return
        gaps = np.log(np.diff(self.cuts))
        theta = np.concatenate((self.weights, self.cuts[:1], gaps))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        share = np.bincount(y, minlength=len(self.cuts) + 1)
        balance = (1 / np.sqrt(np.maximum(share, 1)))[y]
        balance /= balance.sum()
        for step in range(1, STEPS + 1):
            w, cuts = theta[:DIM], self._cuts(theta)
            z = np.bincount(row, value * w[at], len(y))
            full = np.concatenate(([-np.inf], cuts, [np.inf]))
            up, low = 1 / (1 + np.exp(-np.clip(full[y + 1] - z, -30, 30))), 1 / (1 + np.exp(-np.clip(full[y] - z, -30, 30)))
            up[y == len(cuts)], low[y == 0] = 1.0, 0.0
            p = np.maximum(up - low, 1e-9)
            du, dl = up * (1 - up) / p * balance, low * (1 - low) / p * balance
            dz = du - dl
            g = np.zeros_like(theta)
            g[:DIM] = np.bincount(at, value * dz[row], DIM) + RIDGE * w
            dcut = np.array([dl[y == j + 1].sum() - du[y == j].sum() for j in range(len(cuts))])
            g[DIM] = dcut.sum()
            for j in range(1, len(cuts)):
                g[DIM + j] = dcut[j:].sum() * math.exp(theta[DIM + j])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.cuts = theta[:DIM], self._cuts(theta)

    @staticmethod
    def _cuts(theta: np.ndarray) -> np.ndarray:
        return theta[DIM] + np.concatenate(([0.0], np.cumsum(np.exp(theta[DIM + 1 :]))))


def fit(docs: DataFrame, graded: DataFrame, grades: int) -> Ordinal:
    """``docs(doc_id, text)``, ``graded(doc_id, grade)`` -> the model, from at most ``GRADED`` rows; only features reach the driver."""
    known = graded.filter("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").cast("int").alias("grade"))
    picked = F.broadcast(known.filter(F.col("grade").between(0, grades - 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(GRADED))  # bounded: GRADED rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for block in text_blocks(b.column(1)):
                got = list(_sparse(block))
                rows = b.slice(done, len(block))
                done += len(block)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([g[0].astype(np.int16) for g in got], pa.list_(pa.int16())), pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["doc_id", "grade", "at", "value"])

    got = texts.select("doc_id", "text", "grade").mapInArrow(run, "doc_id long, grade int, at array<smallint>, value array<float>").limit(2 * GRADED).toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    model = Ordinal(grades)
    at = got.column("at").combine_chunks()
    n = pc.list_value_length(at).to_numpy(zero_copy_only=False).astype(np.int64)
    model.fit(np.repeat(np.arange(len(n)), n), at.flatten().to_numpy().astype(np.int64), got.column("value").combine_chunks().flatten().to_numpy().astype(np.float64), got.column("grade").to_numpy().astype(np.int64))
    return model


def grade(docs: DataFrame, graded: DataFrame, grades: int = 3, tail: float = 0.5) -> DataFrame:
    """``(doc_id, expected_grade, tail_probability, selected)`` per row; selected where the best grade's probability is ``tail`` or more."""
    model = fit(docs, graded, grades)
    trained = bool(np.any(model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.array([float(value @ model.weights[at]) for block in text_blocks(b.column(1)) for at, value in _sparse(block)])
            p = model.probabilities(z)
            top = 1 - p[:, -1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((1 - p).sum(axis=1)), pa.array(top), pa.array(trained & (top >= tail))], ["doc_id", "expected_grade", "tail_probability", "selected"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, selected boolean")


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Grades from binary labels: 0 bad, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
