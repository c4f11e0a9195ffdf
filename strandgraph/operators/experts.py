"""Overlapping expert groups by fuzzy clustering of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Clusters, fuzziness, rounds, tolerance, least squared distance, least members of an expert, membership floor.
CLUSTERS, FUZZY, ROUNDS, TOLERANCE, LEAST, MEMBERS, FLOOR = 50, 1.5, 100, 1e-5, 1e-10, 10, 0.05


def _memberships(x: np.ndarray, c: np.ndarray, m: float = FUZZY) -> np.ndarray:
    """Memberships of rows in clusters: weights fall with the squared cosine distance to the power 1/(m-1)."""
    d = np.maximum((1 - (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).T) ** 2, LEAST)
    w = (d.min(axis=1, keepdims=True) / d) ** (1 / (m - 1))
    return w / w.sum(axis=1, keepdims=True)


def _rows(batch: pa.RecordBatch, column: str = "embedding") -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(batch.num_rows, -1) if batch.num_rows else values.reshape(0, 0)


def seed_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = 0) -> np.ndarray:
    """k-means++ seeds: each next one is drawn with weight (1 - cos)^2 to the nearest, by seeded exponential keys."""
    first = vectors.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").select("embedding").first()
    if first is None:
        return np.zeros((0, 0))
    chosen = [np.array(first[0], np.float64)]
    while len(chosen) < k:
        c = np.array(chosen)

        def run(batches: Iterator[pa.RecordBatch], c: np.ndarray = c, r: int = len(chosen)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _rows(b)
                if not len(x):
                    continue
                cos = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
                w = ((1 - cos) ** 2).min(axis=1)
                u = ((b.column("h").to_numpy().astype(np.uint64) ^ np.uint64(seed * 7919 + r)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.float64) / 2**32 + 1e-12
                key = np.where(w > 1e-12, -np.log(u) / np.maximum(w, 1e-12), np.inf)
                i = int(np.argmin(key))
                yield pa.RecordBatch.from_arrays([pa.array([float(key[i])]), pa.array([x[i].tolist()])], ["key", "embedding"])

        got = vectors.select("embedding", F.pmod(F.xxhash64("node_id"), F.lit(1 << 32)).alias("h")).mapInArrow(run, "key double, embedding array<double>").orderBy("key").first()
        if got is None or got["key"] == float("inf"):
            break
        chosen.append(np.array(got["embedding"]))
    return np.array(chosen)


def fcm_step(vectors: DataFrame, centroids: np.ndarray, m: float = FUZZY, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of u^m x and of u^m per cluster, and how far memberships are from those of the centroids ``before``.

    Every task emits one partial sum per cluster, summed before the driver sees K rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight, change = np.zeros_like(centroids), np.zeros(len(centroids)), np.zeros(len(centroids))
        for b in batches:
            x = _rows(b)
            if len(x):
                u = _memberships(x, centroids, m)
                um = u**m
                total += um.T @ x
                weight += um.sum(axis=0)
                if before is not None:
                    change += ((u - _memberships(x, before, m)) ** 2).sum(axis=0)
        k, d = total.shape
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), d + 2), pa.int32()), pa.array(np.tile(np.arange(d + 2), k), pa.int32()), pa.array(np.column_stack([total, weight, change]).ravel())], ["k", "i", "v"])

    rows = vectors.select("embedding").mapInArrow(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((centroids.shape[0], centroids.shape[1] + 2))
    out[rows["k"], rows["i"]] = rows["v"]
    return out[:, :-2], out[:, -2], float(np.sqrt(out[:, -1].sum())) if before is not None else float("inf")


def _any_row(vectors: DataFrame, seed: int) -> np.ndarray:
    """The unit vector of a row picked by a seeded hash."""
    x = np.array(vectors.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").select("embedding").first()[0], np.float64)
    return x / max(np.linalg.norm(x), 1e-12)


def fuzzy_c_means(vectors: DataFrame, centroids: np.ndarray, m: float = FUZZY, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Centroids (unit rows) after at most ``rounds`` rounds or until they and all memberships change less than ``tolerance``.

    A cluster without weight or direction goes on from a row picked by hash.
    """
    before = None
    for r in range(rounds):
        total, weight, change = fcm_step(vectors, centroids, m, before)
        new = total / np.maximum(weight, LEAST)[:, None]
        size = np.linalg.norm(new, axis=1)
        new = new / np.maximum(size, LEAST)[:, None]
        for k in np.flatnonzero((weight <= LEAST) | (size <= LEAST)).tolist():
            new[k] = _any_row(vectors, r * len(new) + k)
        moved = np.linalg.norm(new - centroids)
        before, centroids = centroids, new
        if moved < tolerance and change < tolerance:
            break
    return centroids


def memberships(vectors: DataFrame, centroids: np.ndarray, m: float = FUZZY) -> DataFrame:
    """``(node_id, k, u)`` for every node and cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b)
            if len(x):
                u = _memberships(x, centroids, m)
                n, k = u.shape
                yield pa.RecordBatch.from_arrays([b.column("node_id").take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(k), n), pa.int32()), pa.array(u.ravel())], ["node_id", "k", "u"])

    return vectors.select("node_id", "embedding").mapInArrow(run, "node_id string, k int, u double")


def adaptive_threshold(u: DataFrame) -> float:
    """The lowest of 20 even steps from 0.05 to 0.5 that covers 70 percent of the nodes, else the best one; 0.1 if nothing is covered."""
    top = u.groupBy("node_id").agg(F.max("u").alias("u"))
    limits = np.linspace(FLOOR, 0.5, 20).tolist()
    row = top.agg(F.count("*").alias("n"), *[F.count_if(F.col("u") > t).alias(f"c{i}") for i, t in enumerate(limits)]).first()
    cover = [row[f"c{i}"] / row["n"] if row["n"] else 0.0 for i in range(len(limits))]
    good = next((t for t, c in zip(limits, cover, strict=True) if c >= 0.7), None)
    return good if good is not None else limits[int(np.argmax(cover))] if max(cover) > 0 else 0.1


def build_experts(u: DataFrame, threshold: float = FLOOR, least: int = MEMBERS) -> DataFrame:
    """``(node_id, k, u)`` -> ``(subgraph_id, node_id, score)``: memberships above the threshold, clusters of enough members, renumbered from 1."""
    kept = u.filter(F.col("u") > threshold)
    sizes = kept.groupBy("k").count().filter(F.col("count") >= least)  # one row per cluster
    ids = sizes.select("k", F.concat(F.lit("Expert_"), F.row_number().over(Window.orderBy("k"))).alias("subgraph_id"))
    return kept.join(F.broadcast(ids), "k").select("subgraph_id", "node_id", F.col("u").alias("score"))


def overlap_statistics(experts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(memberships, nodes)``: how many nodes are in 0, 1, 2 .. experts."""
    per = nodes.select("node_id").join(experts.groupBy("node_id").count(), "node_id", "left")
    return per.groupBy(F.coalesce("count", F.lit(0)).alias("memberships")).agg(F.count("*").alias("nodes"))
