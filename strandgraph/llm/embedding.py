"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors are compared once, with their number.  Every vector belongs to all
cells whose centroid is nearly as close as its nearest one (``MARGIN``), so that
neighbours on two sides of a border still meet; a pair counts in the first cell
that both belong to.  Cells larger than a block are compared block by block;
links are counted and a spanning forest is kept, pairs are never listed.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of different
lengths do not link; rows with a null ``vec_id`` link with nothing and are not
kept; repeated rows count as other vectors; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.arrowutil import group_starts, whole_groups
from strandgraph.operators.components import components
from strandgraph.storage import Scratch

#: Vectors of a cell aimed at, cells at most, vectors that k-means is fitted on at most, its rounds.
CELL, MAX_CELLS, SAMPLE, ROUNDS = 512, 4096, 40_000, 12
#: A vector joins the cells whose cosine is within this of its best.
MARGIN = 0.1
#: Vectors of one cell that are compared at once.
BLOCK = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """``k`` unit centroids of unit rows; empty cells restart at the row that fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near, fit = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(norm < 1e-12)
        if len(empty):
            total[empty] = x[np.argsort(fit)[: len(empty)]]
            norm = np.linalg.norm(total, axis=1)
        c = total / np.maximum(norm, 1e-12)[:, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, fit = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(0, len(x), 4096):
        z = x[i : i + 4096] @ c.T
        near[i : i + 4096], fit[i : i + 4096] = z.argmax(axis=1), z.max(axis=1)
    return near, fit


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """``(embedding, node, copies, dim)`` for the different vectors that can link."""
    e = F.col("embedding")
    sound = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.filter("vec_id is not null and embedding is not null").filter(sound).groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding"))


def centroids(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the centroids fitted on a sample; bounded by ``SAMPLE`` rows."""
    out = {}
    for r in nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(16).collect():
        share = F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, SAMPLE / r["count"]))
        rows = nodes.filter((F.col("dim") == r["dim"]) & share).select("node", "embedding").limit(2 * SAMPLE).toArrow().sort_by("node")
        if rows.num_rows:
            k = min(MAX_CELLS, max(1, r["count"] // CELL))
            out[r["dim"]] = spherical_kmeans(_unit(rows.column("embedding"), r["dim"]), k)
    return out


def _assign(nodes: DataFrame, cents: dict[int, np.ndarray]) -> DataFrame:
    """``nodes`` with ``cells``, the sorted cells of each vector (cell 0 for lengths that have no centroids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, emb = b.column(3).to_numpy(), b.column(0)
            cells: list[list[int]] = [[0]] * b.num_rows
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d in cents:
                    for i in range(0, len(at), 2048):
                        part = at[i : i + 2048]
                        z = _unit(emb.take(pa.array(part)), d) @ cents[d].T
                        close = z >= z.max(axis=1, keepdims=True) - MARGIN
                        for r, j in enumerate(part.tolist()):
                            cells[j] = np.flatnonzero(close[r]).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    element = nodes.schema["embedding"].dataType.simpleString()
    return nodes.select("embedding", "node", "copies", "dim").mapInArrow(run, f"embedding {element}, node long, copies long, dim int, cells array<int>")


def _compare(placed: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """``(src, dst, links)``: rows with ``dst`` are links that span each group, rows without it count a vector's links."""
    keyed = placed.select("*", F.explode("cells").alias("cell"))
    hot = scratch.write(keyed.groupBy("dim", "cell").count().filter(F.col("count") > BLOCK), compact=True)
    keyed = keyed.join(hot, ["dim", "cell"], "left").withColumn("blocks", F.ceil(F.coalesce("count", F.lit(1)) / BLOCK).cast("int"))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = keyed.select("node", "copies", "embedding", "cells", "dim", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")
    order = ["dim", "cell", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, order, 4096):
            starts = group_starts(table, order).tolist()
            for a, z in zip(starts, [*starts[1:], table.num_rows], strict=True):
                got = _block(table.slice(a, z - a), threshold)
                if got is not None:
                    yield got

    return keyed.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "src long, dst long, links long")


def _block(t: pa.Table, threshold: float) -> pa.RecordBatch | None:
    if t.num_rows < 2:
        return None
    cell, lo, hi = (t.column(c)[0].as_py() for c in ("cell", "lo", "hi"))
    x = _unit(t.column("embedding"), t.column("dim")[0].as_py())
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if lo != hi:  # the blocks meet themselves elsewhere
        own = t.column("own").to_numpy()
        near &= own[:, None] != own[None, :]
    if not near.any():
        return None
    node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
    label = np.arange(len(node))
    rows = np.flatnonzero(near.any(axis=1))
    part = near[np.ix_(rows, rows)]
    label = np.arange(len(rows))
    while True:  # smallest reachable row of the block
        low = np.minimum(label, np.where(part, label[None, :], len(rows)).min(axis=1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    earlier = [[c for c in cs if c < cell] for cs in t.column("cells").take(pa.array(rows)).to_pylist()]
    names = {c: i for i, c in enumerate(sorted({c for cs in earlier for c in cs}))}
    if names:
        member = np.zeros((len(rows), len(names)), np.float32)
        for i, cs in enumerate(earlier):
            member[i, [names[c] for c in cs]] = 1
        part = part & (member @ member.T == 0)  # counted in the first common cell
    links = part @ copies[rows]
    far = np.flatnonzero(label != np.arange(len(rows)))
    some = np.flatnonzero(links)
    src = np.concatenate((node[rows[far]], node[rows[some]]))
    dst = pa.array(np.concatenate((node[rows[label[far]]], np.zeros(len(some), np.int64))), pa.int64(), mask=np.arange(len(src)) >= len(far))
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), dst, pa.array(np.concatenate((np.zeros(len(far), np.int64), links[some])), pa.int64())], ["src", "dst", "links"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(vec_id, n_links, component_id, kept)`` for every row."""
    scratch = Scratch(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    nodes = scratch.write(distinct_vectors(vectors))
    found = scratch.write(_compare(scratch.write(_assign(nodes, centroids(nodes))), threshold, scratch))
    links = found.filter("dst is null").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("dst is not null").select("src", "dst"), scratch)
    classes = scratch.write(nodes.join(links, "node", "left").join(roots, "node", "left").select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("root")))
    scratch.keep_only(classes)
    out = vectors.join(classes, "embedding", "left")
    known = F.col("vec_id").isNotNull()
    root = F.when(known, F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept"))


def keep_representatives(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The ``vec_id`` of one vector per group, the smallest."""
    return near_duplicates(vectors, threshold).filter("kept").select("vec_id").distinct()
