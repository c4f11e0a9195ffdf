"""Letter classes and their trigrams, for character models."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Letter classes: 0 no letter, 1 to 26 a to z, the others shared by hash.
CLASSES = 40


@cache
def _letters() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = 27 + (c * 2_654_435_761 >> 8) % (CLASSES - 27)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


def letter_codes(text: str) -> np.ndarray:
    """Letter classes of the lower-cased text."""
    return _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


def trigram_counts(codes: np.ndarray) -> np.ndarray:
    """How often each trigram occurs that has at least one letter; texts are taken between two gaps."""
    x = np.zeros(len(codes) + 2, np.int64)
    x[1:-1] = codes
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] > 0) | (x[:-1] > 0)  # runs of gaps count as one
    x = x[keep]
    if len(x) < 3:
        return np.zeros(CLASSES**3, np.int64)
    return np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
