"""Helpers for Arrow-batched operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Cut a sorted stream into tables of at least ``rows`` rows that split no group.

    Memory holds one such table and its largest group.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        cut = _last_start(table, keys)
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            n = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _last_start(table: pa.Table, keys: list[str]) -> int:
    changed = group_starts(table, keys)
    return int(changed[-1]) if len(changed) else 0


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a key differs from the row before (0 included if any row)."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    diff = np.zeros(table.num_rows, bool)
    diff[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        diff[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(diff)


def text_blocks(texts: pa.Array, chars: int = 4_000_000) -> Iterator[pa.LargeStringArray]:
    """Consecutive slices of about ``chars`` bytes of text; nulls become empty.  Only a slice at a time is copied."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + chars, "right")))
        yield pc.fill_null(texts.slice(at, stop - at).cast(pa.large_string()), "")
        at = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts split at single spaces: where each text's parts begin (and the last end), a code per part, the different parts."""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def joined(flat: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``lens`` items that lie one after the other in ``flat``, in the order of ``codes``, and where each one's items begin (and the last end)."""
    n = lens[codes]
    ends = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat((np.cumsum(lens) - lens)[codes] - ends[:-1], n)
    at += np.arange(len(at))
    return flat[at], ends


class Known:
    """Strings with a piece of items each (or several, of different types), all in flat arrays; strings are only ever added."""

    def __init__(self, *dtypes: type):
        self.keys = pa.array([], pa.large_string())
        self.flat, self.lens = [np.zeros(0, t) for t in dtypes], [np.zeros(0, np.int64) for _ in dtypes]

    def codes(self, keys: pa.Array) -> np.ndarray:
        """The place of each string, -1 for new ones."""
        return pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, keys: pa.Array, *pieces: tuple[np.ndarray, np.ndarray]) -> None:
        """Add strings with their pieces, each kind as its items and their numbers."""
        self.keys = pa.concat_arrays([self.keys, keys])
        for i, (flat, lens) in enumerate(pieces):
            self.flat[i], self.lens[i] = np.concatenate((self.flat[i], flat)), np.concatenate((self.lens[i], lens))

    def take(self, codes: np.ndarray, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of the strings at some places."""
        return joined(self.flat[kind], self.lens[kind], codes)


def give_back() -> None:
    """At the end of a task: return freed memory to the system, as workers live on beside other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
