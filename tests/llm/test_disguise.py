"""Disguised words of any length."""

import time

import numpy as np
import pytest
from strandgraph.llm import toxicity
from strandgraph.llm.letters import CLASSES, letter_codes, trigram_counts


@pytest.fixture(scope="module")
def chars():
    counts = np.zeros(CLASSES**3, np.int64)
    for word, n in (("idiot", 200), ("you", 100), ("are", 100), ("reading", 100), ("letter", 100), ("scumbag", 100)):
        for _ in range(n):
            counts += trigram_counts(letter_codes(f" {word} "))
    return toxicity.CharModel(counts)


def _entries(words):
    return {e for w in words for e in toxicity.evidence(w)}


def test_stretched_words_of_any_length(chars):
    for n in (3, 10, 200):
        assert "idiot" in toxicity.restore("".join(c * n for c in "idiot"), chars)
    assert "idiot" in toxicity.restore("1" * 30 + "d10t", chars)


def test_spelled_words_across_any_place(chars):
    for before in range(50, 66):
        run = " ".join("".join("you"[k % 3] for k in range(before)) + "idiot" + "are" * 5)
        assert {"idio", "idiot"} <= _entries(toxicity.spelled(run, chars)), before


def test_spelled_letters_may_be_signs(chars):
    for run in ("i d ! o t", "so i.d.!.0.t here", "$ c u m b @ g", "i d i o t !", "s c u m b * g", "i-d-i-o-t", "i*d*i*o*t"):
        assert {"idio", "scum"} & _entries(toxicity.spelled(run, chars)), run
    assert toxicity.spelled("a | plain (text) * with - signs !", chars) == []


def test_paths_and_time_are_linear(chars):
    rng = np.random.default_rng(2)
    slots = [["i", "l"], ["a"], ["s", "ss"], ["t", " t"]]
    some = [slots[k] for k in rng.integers(0, 4, 9)]
    every = [""]
    for options in some:
        every = [x + o for x in every for o in options]

    def score(text):
        c = [0, 0, *[toxicity._codes(x)[0] for x in text], 0]
        return sum(float(chars.log[c[i], c[i + 1], c[i + 2]]) for i in range(len(c) - 2))

    assert score(chars.decode(some)) == pytest.approx(max(map(score, every)))
    began = time.time()
    for text in ("*" * 60_000, "* " * 60_000, "0101" * 15_000, "i " * 60_000, "a" * 60_000, "-*" * 1_000 + "x"):
        toxicity.restore(text.replace(" ", ""), chars)
        toxicity.spelled(text, chars)
    assert time.time() - began < 60
