"""Sum-of-squares packing of tokenized documents into fixed-length sequences.

Every task tokenizes its rows and packs their pieces where they are: a piece
goes to the open sequence, or a new one, after which the sum over residual gaps
of the squared number of open sequences is smallest (ties: the tightest).  Long
pieces are placed first.  The pieces of sequences that stay open are then pooled
over tasks and packed again in ever fewer tasks, so what is wasted does not grow
with their number.

Defined results: null texts count as empty; every document ends with one
``end_id``; documents longer than a sequence are cut into full pieces and a
rest; every row, repeated or not, is packed on its own; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandgraph.llm.arrowutil import Known, give_back, joined, text_blocks
from strandgraph.storage import Scratch

#: Parts of words that a task keeps with their ids; beyond, it starts anew.
CACHE = 500_000
#: Pieces that one task of the later rounds packs, and the number of tasks of the last round.
POOL, LAST = 4_000, 8
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32"]


class WordTokenizer:
    """A tokenizer whose pre-tokenizer drops white space and splits words by a pattern.

    The distinct words of a block are split into parts and looked up in whole
    columns; only parts not met before go to the tokenizer's model one by one.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        #: Words of these characters only are their own normal form but for case, and their parts are runs of
        #: letters, single digits and runs of other signs; in all others the library does the whole work.
        self.simple = r"^[\x21-\x26\x28-\x3B\x3D-\x7E\xA1-\x{12F}\x{131}-\x{17F}]*$"
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.forget()

    def forget(self) -> None:
        """Drop the parts met so far."""
        self.parts = Known(np.uint32)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, without special tokens added, and where each text's begin (and the last end)."""
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        del lists
        if len(self.parts.keys) > CACHE:
            self.forget()
        ids, ends = joined(*self._words(coded.dictionary), coded.indices.to_numpy())
        return ids, ends[offsets - offsets[0]]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and their numbers."""
        easy = pc.match_substring_regex(words, self.simple)
        got = [np.array(self.tok.encode(w, add_special_tokens=False).ids, np.uint32) for w in words.filter(pc.invert(easy)).to_pylist()]
        simple = pc.utf8_lower(pc.if_else(easy, words, pa.scalar("", words.type)))
        lists = pc.split_pattern(pc.replace_substring_regex(simple, r"([^\p{L}\p{N}]+|\p{N})", r" \1 "), " ")
        flat, at = lists.flatten(), lists.offsets.to_numpy()
        full = pc.binary_length(flat).to_numpy() > 0
        n = np.concatenate(([0], np.cumsum(full)))[at - at[0]]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        codes = self.parts.codes(coded.dictionary)
        new = coded.dictionary.filter(pa.array(codes < 0))
        codes[codes < 0] = np.arange(len(new)) + len(self.parts.keys)
        ids, lens, tokenize, table = [], [], self.model.tokenize, self.bytes
        for part in new.to_pylist():
            tokens = tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(table))
            ids += [t.id for t in tokens]
            lens.append(len(tokens))
        self.parts.add(new, (np.array(ids, np.uint32), np.array(lens, np.int64)))
        ids, ends = self.parts.take(codes[coded.indices.to_numpy()])
        of_word = np.diff(ends[n])
        if got:  # what the library encoded goes where its words stand
            hard = np.flatnonzero(~easy.to_numpy(zero_copy_only=False))
            ids = np.insert(ids, np.repeat(ends[n[hard]], [len(g) for g in got]), np.concatenate(got))
            of_word[hard] = [len(g) for g in got]
        return ids, of_word


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, and each sequence's final gap."""
    count = np.zeros(size + 1, np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    seq, off, gaps = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        best, cost = size, (2 * int(count[size - s]) + 1 if s < size else 0)
        g = np.flatnonzero(count[s:size]) + s
        if len(g):
            change = np.where(g == s, 1 - 2 * count[g], 2 * (count[g - s] - count[g] + 1))
            k = int(np.argmin(change))
            if change[k] <= cost:
                best = int(g[k])
        if best == size:
            b = len(gaps)
            gaps.append(size)
        else:
            b = open_by_gap[best].pop()
            count[best] -= 1
        seq[i], off[i] = b, size - gaps[b]
        gaps[b] -= s
        if gaps[b]:
            count[gaps[b]] += 1
            open_by_gap[gaps[b]].append(b)
    return seq, off, np.array(gaps, np.int64)


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """``docs(doc_id, text)`` -> packed pieces, first round: also ``open``, whether the sequence has room left.

    Sequence numbers are those of the task, counted from its partition number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.uint32(end_id).tobytes()
        cols: list[list] = [[], [], [], [], []]
        part = 0
        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            docs_at = 0
            for texts in text_blocks(b.column(1)):
                ids, at = tok.encode_batch(texts)
                for i, doc in enumerate(b.column(0).slice(docs_at, len(texts)).to_pylist()):
                    x = ids[at[i] : at[i + 1]].tobytes() + end
                    for k in range(0, len(x), 4 * size):
                        y = x[k : k + 4 * size]
                        for c, v in zip(cols, (doc, k // (4 * size), k // 4, len(y) // 4, zlib.crc32(y)), strict=True):
                            c.append(v)
                docs_at += len(texts)
        if cols[0]:
            yield _packed([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], part, size)
        tok.forget()
        give_back()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return src.mapInArrow(run, f"{_SCHEMA}, open boolean")


def _packed(cols: list[pa.Array], part: int, size: int) -> pa.RecordBatch:
    seq, off, gaps = sum_of_squares(cols[3].to_numpy(), size)
    return pa.RecordBatch.from_arrays([*cols, pa.array(seq + (part << 32)), pa.array(off), pa.array(gaps[seq] > 0)], [*_FIELDS, "sequence_id", "offset", "open"])


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    scratch = Scratch(docs.sparkSession)
    first = scratch.write(pieces(docs, path, size, end_id))
    done = [first.filter("not open")]
    rest, tasks, level = first.filter("open"), None, 0
    while True:
        n = rest.count()
        now = max(LAST, math.ceil(n / POOL))
        if not n or (tasks is not None and now >= tasks):
            break
        tasks, level = now, level + 1
        rest = scratch.write(_again(rest, tasks, level, size))
        done.append(rest.filter("not open"))
        rest = rest.filter("open")
    done.append(rest)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("open")


def _again(rest: DataFrame, tasks: int, level: int, size: int) -> DataFrame:
    """Pack the pieces of open sequences once more, in ``tasks`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.sort_by([(c, "ascending") for c in _FIELDS])
            part = t.column("task")[0].as_py() + (level << 24)
            yield _packed([t.column(c).combine_chunks() for c in _FIELDS], part, size)

    task = F.pmod(F.xxhash64("sequence_id"), F.lit(tasks)).cast("int")
    src = rest.select(*_FIELDS, task.alias("task"))
    return src.repartition(tasks, "task").mapInArrow(run, f"{_SCHEMA}, open boolean")


def utilisation(packed: DataFrame, size: int = 2048) -> DataFrame:
    """One row: pieces, sequences, tokens, and the least number of sequences that could hold them."""
    per = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("t"))
    return per.agg(F.sum("n").alias("pieces"), F.count("*").alias("sequences"), F.sum("t").alias("tokens")).withColumn("least", F.ceil(F.col("tokens") / size))


def gapless(packed: DataFrame) -> DataFrame:
    """Sequences whose pieces overlap or leave a gap (none, if the packing is right)."""
    w = Window.partitionBy("sequence_id").orderBy("offset")
    before = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), F.lit(0))
    return packed.filter("length > 0").withColumn("want", before).filter("offset <> want")
