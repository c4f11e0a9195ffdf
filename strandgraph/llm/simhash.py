"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints are 64 bits over word shingles.  Correlated bits are grouped into
partitions; a dynamic programme gives each partition its own threshold, so that
the thresholds add up to ``radius - partitions + 1`` (any pair within ``radius``
then agrees within the threshold in some partition) at the least estimated cost.
Fingerprints that share a probe key are verified by their Hamming distance.

Defined results: null and empty texts have fingerprint 0 and link like any
other; rows with a null ``doc_id`` get a fingerprint and, as their component,
that of the rows with an id they are linked to (null if there is none);
repeated rows give repeated result rows; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.arrowutil import group_starts, whole_groups
from strandgraph.operators.components import components
from strandgraph.storage import Scratch

BITS = 64
#: Rows of one probe bucket that are compared at once; larger buckets are split into pairs of blocks.
BLOCK = 1024
#: Cost of shuffling one probe row, in verified pairs.
PROBE_COST = 200.0


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of one text, as an unsigned number."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    h64 = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if n < 2:
        return h64(joined, seed)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], ends + 1))[:n].tolist()
    stops = np.concatenate((ends, [len(joined)]))[width - 1 :].tolist()
    total = np.zeros(BITS, np.int64)
    step = 65_536  # bounds memory for very long texts
    for i in range(0, n, step):
        h = np.array([h64(joined[a:b], seed) for a, b in zip(starts[i : i + step], stops[i : i + step], strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp)``; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how often each two bits are set together (64 x 64), over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = _bits(b.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array([n] * BITS, pa.int64()), pa.array(total.astype(np.int64).tolist(), pa.list_(pa.int64()))], ["i", "n", "c"])

    rows = fps.select("fp").mapInArrow(run, "i int, n long, c array<long>").groupBy("i")
    got = rows.agg(F.sum("n").alias("n"), *[F.sum(F.col("c")[j]).alias(f"c{j}") for j in range(BITS)]).collect()
    co, n = np.zeros((BITS, BITS)), 0
    for r in got:
        n, co[r["i"]] = r["n"], [r[f"c{j}"] for j in range(BITS)]
    return n, co


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, co: np.ndarray, m: int) -> list[list[int]]:
    """Split the bits into ``m`` partitions of nearly equal width, correlated bits together."""
    p = np.diag(co) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(co / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        seed = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        part = [seed]
        left.discard(seed)
        while len(part) < width:
            best = max(sorted(left), key=lambda b: corr[b, part].sum())
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def within(p: np.ndarray, t: int) -> float:
    """Chance that two random fingerprints differ in at most ``t`` of the bits with frequencies ``p``."""
    d = np.zeros(t + 1)
    d[0] = 1.0
    for q in 2 * p * (1 - p):
        d[1:] = d[1:] * (1 - q) + d[:-1] * q
        d[0] *= 1 - q
    return float(d.sum())


def allocate(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i in -1 .. that add up to ``total`` at the least cost; ``cost[i][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*ts, t])
        best = step
    return best[total][1]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def plan(fps: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """The partitions with their thresholds that cost least by the corpus' own counts."""
    n, co = bit_statistics(fps)
    p = np.diag(co) / max(n, 1)
    options = {m: group_bits(n, co, m) for m in range(2, radius + 3)}
    flat = [(m, i, part) for m, parts in options.items() for i, part in enumerate(parts)]
    keys = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(part))).alias("key")) for m, i, part in flat]))
    counts = fps.select(keys.alias("k")).select("k.*").groupBy("m", "i", "key").count()
    pairs = {(r["m"], r["i"]): float(r["s"] or 0) for r in counts.groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("s")).collect()}
    choices = []
    for m, parts in options.items():
        cost = []
        for i, part in enumerate(parts):
            row, same = [0.0], max(within(p[part], 0), 1e-300)
            for t in range(min(radius, 2) + 1):
                found = pairs.get((m, i), 0.0) * within(p[part], t) / same
                row.append(PROBE_COST * n * math.comb(len(part), t) + min(found, n * n / 2))
            cost.append(row)
        ts = allocate(cost, radius - m + 1)
        choices.append((sum(c[t + 1] for c, t in zip(cost, ts, strict=True)), m, ts))
    _, m, ts = min(choices)
    return [(part, t) for part, t in zip(options[m], ts, strict=True) if t >= 0]


def links(nodes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``nodes(node, fp)`` with distinct ``fp`` -> ``(src, dst)`` pairs within ``radius`` that span each linked group.

    Every two fingerprints within ``radius`` are connected by returned pairs;
    pairs that add nothing to connectivity inside a block are left out.
    """
    probes = []
    for i, (part, t) in enumerate(plan(nodes, radius)):
        for j, free in enumerate(combinations(part, t)):
            kept = [b for b in part if b not in free]
            probes.append(F.struct(F.lit(i * 100_000 + j).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(kept))).alias("key")))
    keyed = nodes.select("node", "fp", F.explode(F.array(*probes)).alias("k")).select("node", "fp", "k.part", "k.key")
    keyed = pair_blocks(keyed, ["part", "key"], "fp", scratch).drop("own")
    order = ["part", "key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, order):
            a, b = _span(group_starts(table, order), table.column("node").to_numpy(), table.column("fp").to_numpy().view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])

    return keyed.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "src long, dst long")


def pair_blocks(keyed: DataFrame, keys: list[str], by: str, scratch: Scratch, size: str | None = None, most: int = 0) -> DataFrame:
    """Rows of a bucket beyond ``BLOCK`` rows (or a sum of ``size`` beyond ``most``) are dealt to blocks by hash of ``by`` and copied once for each other block.

    Two rows of a bucket meet under one ``(*keys, lo, hi)``; ``own`` is a row's block.
    """
    full = F.count("*") / F.lit(BLOCK)
    if size:
        full = F.greatest(full, F.sum(size) / F.lit(most))
    hot = scratch.write(keyed.groupBy(*keys).agg(F.ceil(full).cast("int").alias("blocks")).filter("blocks > 1"), compact=True)
    keyed = keyed.join(hot, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return keyed.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("blocks", "other")


def _span(starts: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of each group: all of them in small groups, a spanning forest in others."""
    size = np.diff(np.append(starts, len(node)))
    src, dst = [], []
    small = np.repeat(size <= 32, size)
    gid = np.repeat(np.arange(len(size)), size)
    gid, fs, ns = gid[small], fp[small], node[small]
    for lag in range(1, 32):
        i = np.flatnonzero(gid[lag:] == gid[:-lag]) if len(gid) > lag else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[np.bitwise_count(fs[i] ^ fs[i + lag]) <= radius]
        src.append(ns[i])
        dst.append(ns[i + lag])
    for g in np.flatnonzero(size > 32):
        f, v = fp[starts[g] : starts[g] + size[g]], node[starts[g] : starts[g] + size[g]]
        left = np.arange(len(f))
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                x = front.pop()
                near = np.bitwise_count(f[left] ^ f[x]) <= radius
                got = left[near]
                if len(got):
                    src.append(np.full(len(got), v[x]))
                    dst.append(v[got])
                    front.extend(got.tolist())
                    left = left[~near]
    if not src:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(src), np.concatenate(dst)


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp, component_id)`` for every row.

    ``component_id`` is the smallest ``doc_id`` reachable over links of
    fingerprints that differ in at most ``radius`` bits.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.write(fingerprints(docs, width))
    nodes = scratch.write(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), compact=True)
    found = components(links(nodes, radius, scratch), scratch)
    classes = scratch.write(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), compact=True)
    scratch.keep_only(marked, classes)
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """The rows of ``docs`` of which one document of each group of near copies stays, as ``keep_first`` says."""
    return keep_first(docs, near_duplicates(docs, radius, width))


def keep_first(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """One document of each component of ``marked(doc_id, component_id)``.

    The document with the smallest ``doc_id`` stays.  Rows with a null
    ``doc_id`` cannot be told apart and all stay; of rows that repeat a kept
    ``doc_id`` one stays, the one with the smallest text hash.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.write(marked)
    gone = marked.filter("doc_id <> component_id").select("doc_id").distinct()
    twice = marked.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    gone, twice = scratch.write(gone, compact=True), scratch.write(twice, compact=True)
    scratch.keep_only(gone, twice)
    kept = docs.join(gone, "doc_id", "left_anti")
    single = kept.join(twice, "doc_id", "left_anti")
    repeated = kept.join(twice, "doc_id", "left_semi")
    first = repeated.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64("text")).alias("r"))
    return single.select(*docs.columns).unionByName(first.select("r.*"))
