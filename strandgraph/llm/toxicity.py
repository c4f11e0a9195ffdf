"""Toxicity with noisy-channel restoration of disguised words.

A character language model is counted over every text.  Words that look
disguised (digits or signs among letters, long repetitions, letters spelled out
one by one) become lattices of what each character may stand for; a Viterbi
search takes the likeliest path, whatever a word's or a spelled run's length.  Plain and restored words are then scored by a
lexicon of words and word beginnings learned from labelled rows, and a logistic
model turns a text's strongest evidence into a probability.

Defined results: null and empty texts, and texts without evidence, get the
model's score of no evidence; without labelled rows of both kinds every score is
the smoothed share of toxic labels; rows with a null ``doc_id`` are not held out
and have no label; every row gives one row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.arrowutil import give_back
from strandgraph.llm.langid import held_out
from strandgraph.llm.letters import CLASSES, letter_codes, trigram_counts

#: Labelled rows that the lexicon and the logistic model are fitted on at most; the lexicon holds what they hold.
LABELLED = 20_000
#: Lengths of word beginnings that count as evidence beside the word, rows of toxic texts that an entry needs.
BEGINNINGS, SUPPORT = (4, 5, 6, 7), 3
#: Words that a worker keeps with their evidence.
CACHE = 400_000

#: Letters that a disguising character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeioubcdfghjklmnpqrstvwxyz",
}
_EDGE = ".,;:?\"'`)]}>-_#%&~^=…«»“”„’‘"
_SIGNS = re.escape("".join(STANDS_FOR))
_LETTER, _SIGN, _THRICE = re.compile(r"[^\W\d_]"), re.compile(f"[{_SIGNS}]"), re.compile(r"(.)\1\1")
_SPELLED = re.compile(r"(?<![^\s])[^\W_](?:[ .\-_*]{1,2}[^\W_]){2,}(?![^\s.,!?;:])")
#: The same with signs among the letters; a star, which also separates, only where it stands alone.
_MARKS = re.escape("".join(c for c in STANDS_FOR if not c.isalnum() and c != "*"))
_UNIT = rf"(?:[^\W_]|[{_MARKS}]|(?<![^\s.\-_])\*(?![^\s.\-_]))"
_ONE = re.compile(_UNIT)
_SIGNED = re.compile(rf"(?<![^\s]){_UNIT}(?:[ .\-_*]{{1,2}}{_UNIT}){{2,}}(?![^\s.,!?;:])")
#: Letters of each part of a spelled run that may match the lexicon.
PART = 60
_RUN = re.compile(r"(.)\1*", re.S)


class CharModel:
    """Trigram log-probabilities over letter classes, backed off to bigrams."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        two = c.sum(axis=0)
        p2 = (two + 0.5) / (two + 0.5).sum(axis=1, keepdims=True)
        p3 = (c + 5 * p2[None]) / (c.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3).astype(np.float32)

    def decode(self, lattice: list[list[str]]) -> str:
        """The likeliest string that takes one option of each slot, between word ends; a space is a word end."""
        if all(len(options) == 1 for options in lattice):
            return "".join([options[0] for options in lattice])
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # paths are linked from their ends: no copies
        for options in lattice:
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            coded = [(o, _codes(o)) for o in options]
            for (a, b), (p, path) in states.items():
                for o, codes in coded:
                    x, y, q = a, b, p
                    for c in codes:
                        q += float(log[x, y, c])
                        x, y = y, c
                    if (x, y) not in step or step[x, y][0] < q:
                        step[x, y] = (q, (path, o))
            states = step
        ends = [(p + float(log[a, b, 0]), path) for (a, b), (p, path) in states.items()]
        most = max(p for p, _ in ends)
        return max(_path(path) for p, path in ends if p == most)


@lru_cache(100_000)
def _codes(option: str) -> list[int]:
    """The letter classes of an option."""
    return [0 if c == " " else int(x) for c, x in zip(option, letter_codes(option), strict=False)]


def _path(path: tuple | None) -> str:
    """The string of a path."""
    out = []
    while path is not None:
        path, o = path
        out.append(o)
    return "".join(reversed(out))


def lattice(word: str) -> list[list[str]]:
    """What each run of equal characters of a lower-cased word may stand for."""
    out = []
    for m in _RUN.finditer(word):
        c, n = m[1], len(m[0])
        letters = [c] if c.isalpha() else list(STANDS_FOR.get(c, ""))
        if not letters:
            continue
        if n == 1:
            out.append(letters)
        elif n == 2:
            out.append([x * k for x in letters for k in (2, 1)] if not c.isalpha() else [c * 2])
        else:
            out.append([x * k for x in letters for k in (1, 2)])
    return out


def restore(word: str, model: CharModel) -> list[str]:
    """A lower-cased word without signs at its edges, and the words it may disguise."""
    plain = word.strip(_EDGE + "!|*+")
    out = [plain] if plain else []
    rough = word.strip(_EDGE)
    forms = {plain} if plain and not plain.isalnum() and _LETTER.search(plain) else set()
    if rough and (_THRICE.search(rough) or _SIGN.search(rough) and _LETTER.search(rough)):
        forms |= {f for f in (rough, plain) if len(lattice(f)) > 2}
    for form in sorted(forms):
        out += model.decode(lattice(form)).split()
    return out


def spelled(text: str, model: CharModel) -> list[str]:
    """Words that a lower-cased text spells letter by letter, with or without signs among the letters."""
    out = []
    for m in _SPELLED.finditer(text):
        whole = "".join(c for c in m[0] if c.isalnum())
        words = _spaced(whole, model)
        out += [*_parts("".join(words)), *words]
    for m in _SIGNED.finditer(text):
        whole = "".join(u[0] for u in _ONE.finditer(text, m.start(), m.end() + 1) if u.start() < m.end())
        if not whole.isalnum() and _LETTER.search(whole):  # signs alone disguise nothing
            for form in {whole, whole.strip("!|*+(")}:
                words = _spaced(form, model)
                out += [*_parts("".join(words)), *words]
    return out


def _parts(whole: str) -> list[str]:
    """A part from each letter of a run on; parts overlap in all but one letter."""
    return [whole[k : k + PART] for k in range(len(whole) - 3)]


def _spaced(letters: str, model: CharModel) -> list[str]:
    """The likeliest words of a run of letters and signs."""
    slots = [list(STANDS_FOR.get(c, c)) if not c.isalpha() else [c] for c in letters]
    return model.decode([slots[0]] + [[*s, *[" " + x for x in s]] for s in slots[1:]]).split() if slots else []


def evidence(word: str) -> list[str]:
    """The lexicon entries that a word may match."""
    return [word + "$", *[word[:n] for n in BEGINNINGS if len(word) >= n]] if len(word) > 2 else []


class Reader:
    """Turns texts into the evidence they hold, with a cache of words."""

    def __init__(self, model: CharModel):
        self.model = model
        self.words: dict[str, object] = {}

    def read(self, text: str, of: Callable[[list[str]], object]) -> list:
        """``of(words)`` for each different word (with its restored forms) of a text."""
        low = text.lower()
        if len(self.words) > CACHE:
            self.words.clear()
        held, out = self.words, []
        for w in set(low.split()):
            got = held.get(w)
            if got is None:
                got = held[w] = of(restore(w, self.model))
            out.append(got)
        if (more := spelled(low, self.model)):
            out.append(of(more))
        return out


def char_model(docs: DataFrame) -> CharModel:
    """The language model of all texts; what is gathered has at most ``CLASSES ** 3`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    total += trigram_counts(letter_codes(t.as_py()))
        at = np.flatnonzero(total)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["t", "n"])

    rows = docs.select("text").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CLASSES**3, np.int64)
    counts[rows["t"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return CharModel(counts)


class Model:
    """Lexicon weights and the logistic model over a text's evidence."""

    def __init__(self, chars: CharModel, weights: dict[str, float], beta: np.ndarray):
        self.chars, self.weights, self.beta = chars, weights, beta

    def best(self, words: list[str]) -> float:
        """The strongest evidence of some words, 0 if none."""
        get = self.weights.get
        return max((get(e, 0.0) for w in words for e in evidence(w)), default=0.0)

    def features(self, reader: Reader, text: str) -> tuple[float, float]:
        """The strongest evidence and the sum of all, damped."""
        got = [x for x in reader.read(text, self.best) if x > 0]
        return (max(got), math.log1p(sum(got))) if got else (0.0, 0.0)

    def score(self, x: tuple[float, float]) -> float:
        """The probability of a toxic label."""
        z = self.beta[0] + self.beta[1] * x[0] + self.beta[2] * x[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A ridge logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(a.shape[1]), np.diag([1e-6, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> Model:
    """Learn from at most ``LABELLED`` labelled rows that are not held out.

    Half of them give the lexicon, the other half the logistic model, so that
    chance entries do not count as sure.
    """
    chars = char_model(docs)
    known = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out("doc_id", modulus, remainder)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))  # bounded: LABELLED rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    texts = texts.withColumn("half", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(chars), defaultdict(lambda: [0, 0])
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = {e for es in reader.read(text.as_py() or "", lambda ws: [e for w in ws for e in evidence(w)]) for e in es}
                for e in [*found, ""]:  # the empty entry counts the texts
                    seen[e][toxic > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["entry", "clean", "toxic"])

    counted = texts.filter("half = 0").select("text", "toxic").mapInArrow(count, "entry string, clean long, toxic long")
    counted = counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = counted.filter((F.col("entry") == "") | ((F.col("toxic") >= SUPPORT) & (F.col("toxic") > F.col("clean"))))
    rows = counted.collect()
    total = next(((r["clean"], r["toxic"]) for r in rows if r["entry"] == ""), (0, 0))
    weights = {}
    for r in rows:
        w = math.log((r["toxic"] + 0.5) / (total[1] + 1)) - math.log((r["clean"] + 0.5) / (total[0] + 1))
        if r["entry"] and w > 0:
            weights[r["entry"]] = w
    model = Model(chars, weights, np.zeros(3))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(chars)
        for b in batches:
            got = [model.features(reader, t.as_py() or "") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), b.column(1)], ["a", "b", "toxic"])
        del reader
        give_back()

    got = texts.filter("half = 1").select("text", "toxic").mapInArrow(features, "a double, b double, toxic int").toPandas()
    y = (got["toxic"].to_numpy() > 0).astype(np.float64)
    if y.any() and not y.all():
        model.beta = _logistic(got[["a", "b"]].to_numpy(np.float64), y)
    else:
        share = (y.sum() + total[1] + 0.5) / (len(y) + sum(total) + 1)
        model.beta = np.array([math.log(share / (1 - share)), 0.0, 0.0])
    return model


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """``docs(doc_id, text)``, ``labels(doc_id, toxic)`` -> ``(doc_id, held_out, score, predicted)`` per row."""
    model = fit(docs, labels, modulus, remainder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.chars)
        for b in batches:
            got = [model.score(model.features(reader, t.as_py() or "")) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64()), pa.array([int(g >= 0.5) for g in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])
        del reader
        give_back()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", modulus, remainder).alias("held_out"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns; only texts go to Python."""
    model = fit(docs, labels)
    readers: list[Reader] = []

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        if not readers:
            readers.append(Reader(model.chars))
        return pa.array([model.score(model.features(readers[0], t.as_py() or "")) < limit for t in texts], pa.bool_())

    return docs.filter(clean(F.col("text").cast("string")))
