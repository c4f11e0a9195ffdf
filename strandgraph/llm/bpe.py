"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one connection per Python worker.

A block's distinct new words become token-position rows that join the merge
table; each step contracts every word's leftmost pair of minimum rank, until no
word has a pair left; an ordered aggregation gives the ids.  Another ordered
aggregation, of the vocabulary's bytes over the positions of those ids, decodes
them.  Words stay known within a task, so that one is contracted once for many
documents.

Defined results: null and empty texts have no tokens and decode to nothing;
every row gives one row, in place; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.arrowutil import Known, give_back, joined, text_blocks

#: Words that a task keeps with their ids (beyond, it starts anew), and words per recursive query.
CACHE, QUERY_WORDS = 600_000, 50_000
#: Longer words are contracted with a heap: one recursion step per merge would take quadratic time.
LONG_WORD = 256

_STEP = """
WITH RECURSIVE step(it, w, p, id) AS (
  SELECT 0, w, p, id FROM tok
  UNION ALL
  (WITH best AS (
     SELECT a.w, min(m::BIGINT * 4096 + a.p) AS z
     FROM step a JOIN step b ON a.w = b.w AND b.p = a.p + 1
     JOIN merges ON k = a.id::BIGINT * 16777216 + b.id
     GROUP BY a.w)
   SELECT it + 1, w, (CASE WHEN p > z % 4096 THEN p - 1 ELSE p END)::INT,
          (CASE WHEN p = z % 4096 THEN z // 4096 ELSE id END)::INT
   FROM step JOIN best USING (w) WHERE p <> z % 4096 + 1)
), last AS (SELECT w, max(it) AS it FROM step GROUP BY w)
SELECT w, list(id ORDER BY p) AS ids, string_agg(hex, '' ORDER BY p) AS bytes
FROM step JOIN last USING (w, it) JOIN vocab USING (id) GROUP BY w ORDER BY w
"""


class Encoder:
    """The rank file's tokens, merges and a cache of encoded text units."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.wide = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2}"
        #: In units of these characters only, matches of the pattern are runs of one kind, with the space before them, and
        #: single newlines; in all others the pattern itself is used.
        self.simple = r"^ ?[\n\x21-\x26\x28-\x7E\xA1-\xAC\xAE-\x{17F}]*$" if pattern == PATTERN else r"^$"
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        pairs = [(self.ranks[t[:i]] * 16777216 + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        merges = pa.table({"k": pa.array([k for k, _ in pairs], pa.int64()), "m": pa.array([m for _, m in pairs], pa.int32())})
        vocab = pa.table({"id": pa.array(list(self.token), pa.int32()), "hex": pa.array([t.hex() for t in self.token.values()])})
        for name, table in (("merges", merges), ("vocab", vocab)):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.forget()

    def forget(self) -> None:
        """Drop the words met so far."""
        self.words = Known(np.uint32, np.uint8)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts' ids and where each text's begin (and the last end), and the same of the bytes they decode to.

        The pattern never matches across the start of a lone space, so texts
        without neighbouring white space are split there; the others are
        matched as a whole.
        """
        lone = pc.match_substring_regex(texts, self.wide)
        lists = pc.split_pattern(pc.if_else(lone, pa.scalar("", texts.type), texts), " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        first = pc.if_else(lone, texts, coded.dictionary.take(pa.array(codes[offsets[:-1]])))
        codes[offsets[:-1]] = np.arange(len(coded.dictionary), len(coded.dictionary) + len(first))
        units = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("", texts.type), coded.dictionary, pa.scalar(" ", texts.type)), first])
        del lists, coded
        words, n = self._cut(units)
        out = []
        for kind in (0, 1):
            flat, ends = self.words.take(words, kind)
            at = ends[np.concatenate(([0], np.cumsum(n)))]
            flat, ends = joined(flat, np.diff(at), codes)
            out += [flat, ends[offsets]]
        return tuple(out)

    def _cut(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places of the units' words, one after the other, and how many each unit has."""
        easy = pc.match_substring_regex(units, self.simple)
        marked = pc.replace_substring_regex(units.filter(easy), r"( ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\n)", "\\1\x01")
        lists = pc.split_pattern(marked, "\x01")
        flat, at = lists.flatten(), lists.offsets.to_numpy()
        full = pc.binary_length(flat).to_numpy() > 0
        hard = [self.pattern.findall(u) for u in units.filter(pc.invert(easy)).to_pylist()]
        coded = pa.concat_arrays([flat.filter(pa.array(full)), pa.array([w for ws in hard for w in ws], pa.large_string())]).dictionary_encode()
        if len(self.words.keys) > CACHE:
            self.forget()
        codes = self.words.codes(coded.dictionary)
        new = coded.dictionary.filter(pa.array(codes < 0))
        codes[codes < 0] = np.arange(len(new)) + len(self.words.keys)
        self._learn(new)
        some = easy.to_numpy(zero_copy_only=False)
        n = np.zeros(len(units), np.int64)
        n[some] = np.diff(np.concatenate(([0], np.cumsum(full)))[at - at[0]])
        n[~some] = [len(ws) for ws in hard]
        start = np.zeros(len(units), np.int64)  # where a unit's words lie: simple ones first
        start[some] = np.cumsum(n[some]) - n[some]
        start[~some] = n[some].sum() + np.cumsum(n[~some]) - n[~some]
        place = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        return codes[coded.indices.to_numpy()[place]], n

    def _learn(self, new: pa.Array) -> None:
        """Contract new words and keep their ids and bytes."""
        words = new.cast(pa.large_binary()).to_pylist()
        ids: list = [self.ranks.get(w) for w in words]
        said: list = [w if i is not None else None for w, i in zip(words, ids, strict=True)]
        ids = [[i] if i is not None else None for i in ids]
        rest = [k for k, i in enumerate(ids) if i is None]
        for k in rest:
            if len(words[k]) > LONG_WORD:
                ids[k] = self._contract(words[k])
                said[k] = b"".join([self.token[i] for i in ids[k]])
        rest = [k for k in rest if ids[k] is None]
        for i in range(0, len(rest), QUERY_WORDS):
            part = rest[i : i + QUERY_WORDS]
            for w, got, text in self._query([words[k] for k in part]):
                ids[part[w]], said[part[w]] = got, bytes.fromhex(text)
        flat = np.fromiter(chain.from_iterable(ids), np.uint32)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.words.add(new, (flat, lens), (np.frombuffer(b"".join(said), np.uint8), np.fromiter(map(len, said), np.int64, len(said))))

    def _query(self, words: list[bytes]) -> list[tuple[int, list[int], str]]:
        n = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), n)
        p = (np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        self.con.register("tok", pa.table({"w": w, "p": p, "id": self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]}))
        got = self.con.execute(_STEP).fetchall()
        self.con.unregister("tok")
        return got

    def _contract(self, word: bytes) -> list[int]:
        """The same contraction of one long word, with a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        token, ranks = self.token, self.ranks
        after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)

        def rank(i: int) -> int | None:
            j = after[i]
            return ranks.get(token[ids[i]] + token[ids[j]]) if j < len(ids) else None

        heap = [(r, i) for i in range(len(ids)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return [x for x, a in zip(ids, alive, strict=True) if a]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder for a rank file."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _rows(enc: Encoder, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
    ids, id_at, decoded, at = enc.encode_batch(texts)
    for i in range(len(texts)):
        yield ids[id_at[i] : id_at[i + 1]].tobytes(), decoded[at[i] : at[i + 1]].tobytes()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids binary, decoded binary)`` per row; ids are little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            at = 0
            for texts in text_blocks(b.column(1)):
                got = [pa.array(x, pa.binary()) for x in zip(*_rows(enc, texts), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *got], [id_col, "ids", "decoded"])
                at += len(texts)
        enc.forget()
        give_back()

    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return src.mapInArrow(run, f"{id_col} {src.schema[id_col].dataType.simpleString()}, ids binary, decoded binary")


def decode_ids(ids: bytes, path: str, pattern: str) -> bytes:
    """The bytes of a sequence of ids."""
    token = encoder(path, pattern).token
    return b"".join([token[i] for i in np.frombuffer(ids, np.uint32).tolist()])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row; the digests are made where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for texts in text_blocks(b.column(1)):
                for ids, text in _rows(enc, texts):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    d.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.forget()
        give_back()

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
