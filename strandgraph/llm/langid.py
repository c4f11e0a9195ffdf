"""Language identification with hyperdimensional profiles.

Every letter, and the gap between words, has a random +-1 vector of its own,
made from its code point and a seed.  A trigram is bound as the elementwise
product of its letters' vectors, permuted (rolled) by their place; a document
bundles (sums) its trigrams, a language's prototype those of all its training
documents.  Prediction is the prototype of largest cosine.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text when nothing was learned; ties go to the first language in
order of name; negative cosines score 0; rows with a null ``doc_id`` are not
held out; every row gives one row; extra columns are ignored.  The prototypes
of all learned languages, ``8 * DIM`` bytes each, are held by the driver and by
every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.arrowutil import give_back, text_blocks

#: Dimensions (a multiple of 64), seed, bytes of text whose trigrams are bound at once.
DIM, SEED, BYTES = 512, 7, 1_000_000


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str) -> np.ndarray:
    """The code points of the lower-cased text, 0 where there is no letter; gaps of any length are one, and one stands at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.zeros(len(points) + 2, np.uint32)
    x[1:-1] = points * _is_letter()[points]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] > 0) | (x[:-1] > 0)
    return x[keep]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The vector of each code point, a row of +-1 as int8."""
    z = points.astype(np.uint64)[:, None] * np.uint64(DIM) + np.arange(DIM // 64, dtype=np.uint64) + np.uint64(SEED << 48)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z += np.uint64(0x9E3779B97F4A7C15)
    return np.unpackbits(z.view(np.uint8).reshape(len(points), DIM // 8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def bind(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams of letters' vectors."""
    return np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of texts: the vectors of its different trigrams, the trigrams of all its texts by place there, and where each text's begin (and the last end)."""
    for block in text_blocks(texts, BYTES):
        found = [letters(t) for t in block.to_pylist()]
        x = np.concatenate(found)
        points = np.flatnonzero(np.bincount(x))
        m = len(points)
        place = np.zeros(int(points[-1]) + 1, np.int64)
        place[points] = np.arange(m)
        code = place[x]
        ends = np.cumsum([0, *map(len, found)])
        keys = (code[:-2] * m + code[1:-1]) * m + code[2:]
        inside = np.ones(len(x), bool)  # the last two letters of a text begin no trigram
        inside[np.concatenate((ends[1:] - 1, np.maximum(ends[1:] - 2, 0)))] = False
        keys = keys[inside[:-2]]
        if m**3 <= 1 << 22:
            seen = np.flatnonzero(np.bincount(keys, minlength=1))
            name = np.zeros(m**3, np.int64)
            name[seen] = np.arange(len(seen))
            codes = name[keys]
        else:  # scripts of many letters
            seen, codes = np.unique(keys, return_inverse=True)
        held = letter_vectors(points)
        counts = np.maximum(np.diff(ends) - 2, 0)
        yield bind(held[seen // m // m], held[seen // m % m], held[seen % m]), codes, np.concatenate(([0], np.cumsum(counts)))


def bundle(codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The sum of the trigrams' vectors."""
    n = np.bincount(codes, minlength=1)
    at = np.flatnonzero(n)
    n = n[at]
    return n.astype(np.float32) @ vectors[at].astype(np.float32)


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """``docs(text, lang)`` -> the languages and their prototypes, from all rows with both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[str, np.ndarray] = {}
            langs, done = np.array(b.column(1).to_pylist(), object), 0
            for vectors, codes, ends in _blocks(b.column(0)):
                of = langs[done : done + len(ends) - 1]
                done += len(of)
                for lang in set(of):
                    n = np.bincount(codes[np.repeat(of == lang, np.diff(ends))], minlength=len(vectors))
                    at = np.flatnonzero(n)
                    v = n[at].astype(np.float64) @ vectors[at].astype(np.float64)
                    total[lang] = total[lang] + v if lang in total else v
            for lang, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(range(DIM), pa.int32()), pa.array(v)], ["lang", "i", "v"])
        give_back()

    sums = docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, i int, v double")
    rows = sums.groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas()
    table = rows.pivot(index="lang", columns="i", values="v").sort_index()
    vectors = table.to_numpy(np.float64)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True) if len(vectors) else 1.0
    return [str(x) for x in table.index], vectors / np.where(norms == 0, 1, norms)


def predict(docs: DataFrame, languages: list[str], vectors: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` of every row's ``text``."""
    src = docs.select(*keep, "text")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score = [], []
            for bound, codes, ends in _blocks(b.column(len(keep))):
                for a, z in zip(ends[:-1], ends[1:], strict=True):
                    lang, s = "und", 0.0
                    if languages and z > a:
                        v = bundle(codes[a:z], bound).astype(np.float64)
                        cos = vectors @ v / max(np.linalg.norm(v), 1e-12)
                        k = int(np.argmax(cos))
                        lang, s = languages[k], float(min(max(cos[k], 0.0), 1.0))
                    best.append(lang)
                    score.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(best, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])
        give_back()

    return src.mapInArrow(run, f"{types}, lang_pred string, score double")


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> ``(doc_id, held_out, lang_pred, score)``, learned from rows not held out."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    src = src.withColumn("held_out", held_out("doc_id", modulus, remainder))
    languages, vectors = prototypes(src.filter("not held_out"))
    return predict(src, languages, vectors, ["doc_id", "held_out"])
