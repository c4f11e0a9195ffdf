"""Operators on ``nodes(node_id, ...)`` and ``edges(src, dst, ekey, relation)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.operators.components import components
from strandgraph.operators.extract import number
from strandgraph.storage import Scratch

#: Half edges that are gathered at a time, and neighbours in a row of the graph at most.
SLAB, BLOCK = 1 << 17, 128
#: Nodes up to which neighbours are held in two bytes, by their place in a range of 65 536 numbers.
SHORT = 1 << 18


def induced(nodes: DataFrame, edges: DataFrame, level: int = 2) -> DataFrame:
    """Edges with both ends among the nodes of a level."""
    ids = nodes.filter(F.col("level") == level).select(F.col("node_id"))
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def successors(edges: DataFrame) -> DataFrame:
    """``(src, dst, relation)``: each successor once, with its first parallel edge's relation."""
    return edges.groupBy("src", "dst").agg(F.min_by("relation", "ekey").alias("relation"))


def triple_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(src, dst, relation, text)`` with the names of both ends."""
    u = nodes.select(F.col("node_id").alias("src"), F.col("name").alias("s_name"))
    v = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("o_name"))
    return edges.join(u, "src").join(v, "dst").select("src", "dst", "relation", F.concat_ws(" ", "s_name", "relation", "o_name").alias("text"))


def degree_centrality(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node_id, degree, centrality)``: in and out edges, parallel ones counted, over n - 1."""
    n = ids.count()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").count()
    deg = F.coalesce("count", F.lit(0))
    return ids.select("node_id").join(ends, "node_id", "left").select("node_id", deg.alias("degree"), (deg / F.lit(float(max(n - 1, 1)))).alias("centrality"))


def betweenness(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node_id, betweenness)`` on the undirected simple graph, normalised, exactly: paths from all nodes are counted.

    Nodes are numbered, and each node's neighbours of higher number are written
    in blocks.  Each of as many tasks as there are cores is dealt a copy of the
    blocks (4 bytes an edge; 4 in memory with ``SHORT`` nodes at most, else 8) and
    runs Brandes' accumulation for its share of the sources; the driver sees one
    degree a node and range of numbers.
    """
    from strandgraph.operators.retrieval import few

    spark = ids.sparkSession
    scratch = Scratch(spark)
    nodes = scratch.write(number(ids.select("node_id", F.lit(0).alias("one")), "one", "node_id", "i").select("node_id", F.col("i").cast("int").alias("i")))
    a, b = [few(nodes.select(F.col("node_id").alias(end), F.col("i").alias(name))) for end, name in (("src", "a"), ("dst", "b"))]
    inner = edges.filter("src <> dst").select("src", "dst").join(a, "src").join(b, "dst").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rows = inner.repartition("a").groupBy("a").agg(F.collect_set("b").alias("b"))
    block = F.expr(f"explode(transform(sequence(0, (size(b) - 1) div {BLOCK}), x -> slice(b, x * {BLOCK} + 1, {BLOCK})))")
    pairs = scratch.write(rows.select("a", block.alias("b")), compact=True)
    scratch.release()
    n = nodes.count()
    bits = 16 if n <= SHORT else 31
    ranges = ((n - 1) >> bits) + 1 if n else 1
    half = pairs.select("a", F.explode("b").alias("b"))
    half = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = half.groupBy((F.col("a") * ranges + F.shiftright("b", bits)).alias("a")).agg(F.count("*").alias("d")).toArrow()
    start = np.zeros(n * ranges + 1, np.int64)
    start[degrees["a"].to_numpy() + 1] = degrees["d"].to_numpy()
    np.cumsum(start, out=start)
    parts = max(1, min(n, spark.sparkContext.defaultParallelism))
    # of numbers, the first that goes to each partition, so that no two shares meet in one task
    dealt = spark.range(64 * parts).select("id", F.expr(f"pmod(hash(id), {parts})").alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    shares = sorted(r["id"] for r in dealt)
    held = spark.sparkContext.broadcast((start, {share: j for j, share in enumerate(shares)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, shares = held.value
        got: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            share, a = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
            size, b = batch.column(2).value_lengths().to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            upto = np.concatenate(([0], np.cumsum(size)))
            for x in np.unique(share).tolist():
                if x not in got:
                    got[x] = np.empty(start[-1], np.uint16 if bits == 16 else np.int32), start[:-1].copy()
            i = 0
            while i < len(a):  # rows with SLAB neighbours at most, of one share each
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + SLAB, "right")) - 1)
                j = i + int(np.argmin(np.append(share[i:j] == share[i], False)))
                u, v = np.repeat(a[i:j], size[i:j]).astype(np.int64), b[upto[i] : upto[j]].astype(np.int64)
                for one, other in ((u, v), (v, u)):
                    _put(*got[int(share[i])], one * ranges + (other >> bits), other & ((1 << bits) - 1))
                i = j
        for x in list(got):
            dst, _ = got.pop(x)
            paths = _Paths(dst, start, ranges)
            for source in range(shares[x], paths.n, len(shares)):
                paths.add(source)
            some = np.flatnonzero(paths.total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(paths.total[some])], ["i", "v"])

    copies = pairs.select(F.explode(F.array(*[F.lit(x) for x in shares])).alias("share"), "a", "b").repartition(parts, "share")
    sums = copies.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    scratch.keep_only(nodes, pairs)
    scale = 0.0 if n <= 2 else 1.0 / ((n - 1) * (n - 2))
    return nodes.join(sums, "i", "left").select("node_id", (F.coalesce("v", F.lit(0.0)) * scale).alias("betweenness"))


def _put(dst: np.ndarray, free: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put the half edges ``a -> b`` at the free places of their rows."""
    by = np.argsort(a, kind="stable")
    a = a[by]
    first, count = np.unique(a, return_index=True, return_counts=True)[1:]
    dst[free[a] + np.arange(len(a)) - np.repeat(first, count)] = b[by]
    free[a[first]] += count


class _Paths:
    """Brandes' accumulation over the neighbours ``dst`` that start at ``start``; between two levels the side with fewer half edges is read.

    A node has a start for each of the ``ranges`` of 65 536 numbers that its neighbours are in, where there are several.
    """

    def __init__(self, dst: np.ndarray, start: np.ndarray, ranges: int = 1):
        self.dst, self.start, self.ranges = dst, start, ranges
        self.degree, self.n = np.diff(start[::ranges]), (len(start) - 1) // ranges
        self.total = np.zeros(self.n)
        self.x = np.zeros(self.n)  # all zero between the steps
        room = min(len(dst), max(SLAB, int(self.degree.max(initial=0))))
        self.places, self.values = np.empty(room, np.int64), np.empty(room)  # written again and again

    def _runs(self, nodes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of nodes with ``SLAB`` half edges at most, or one node with more."""
        upto = np.concatenate(([0], np.cumsum(self.degree[nodes])))
        i = 0
        while i < len(nodes):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + SLAB, "right")) - 1)
            yield i, j
            i = j

    def _neighbours(self, nodes: np.ndarray) -> np.ndarray:
        """Neighbours of each node, one after the other, valid until the next call."""
        if self.ranges > 1:
            nodes = (nodes[:, None] * self.ranges + np.arange(self.ranges)).ravel()
        begin, end = self.start[nodes], self.start[nodes + 1]
        parts = [self.dst[i:j] for i, j in zip(begin.tolist(), end.tolist())]
        out = np.concatenate(parts, out=self.places[: sum(map(len, parts))])
        if self.ranges > 1:
            out += np.repeat(nodes % self.ranges << 16, end - begin)
        return out

    def _push(self, nodes: np.ndarray, values: np.ndarray, few: bool) -> np.ndarray | None:
        """Adds the nodes' values to ``x`` at each of their neighbours; with ``few``, these are returned."""
        got = []
        for i, j in self._runs(nodes):
            to, weight = self._neighbours(nodes[i:j]), np.repeat(values[i:j], self.degree[nodes[i:j]])
            if few:
                np.add.at(self.x, to, weight)
                got.append(to.copy())
            else:
                self.x += np.bincount(to, weight, self.n)
        return np.unique(np.concatenate(got)) if few else None

    def _pull(self, nodes: np.ndarray) -> np.ndarray:
        """For each of the nodes, all with neighbours, the sum of ``x`` at these."""
        out = np.empty(len(nodes))
        for i, j in self._runs(nodes):
            size, to = self.degree[nodes[i:j]], self._neighbours(nodes[i:j])
            out[i:j] = np.add.reduceat(self.x.take(to, out=self.values[: len(to)], mode="clip"), np.cumsum(size) - size)
        return out

    def add(self, source: int) -> None:
        """Adds the dependencies of ``source`` on every node to ``total``."""
        if not self.degree[source]:
            return
        x, sigma, open_ = self.x, np.zeros(self.n), self.degree > 0
        sigma[source], open_[source] = 1.0, False
        layers, sizes = [np.array([source])], [int(self.degree[source])]
        rest = len(self.dst) - sizes[0]
        while rest:
            front, few = layers[-1], sizes[-1] * 8 < self.n
            if sizes[-1] <= rest:
                at = self._push(front, sigma[front], few)
                fresh = at[open_[at]] if few else np.flatnonzero((x > 0) & open_)
                sigma[fresh] = x[fresh]
                x[at if few else slice(None)] = 0.0
            else:
                x[front] = sigma[front]
                fresh = np.flatnonzero(open_)
                found = self._pull(fresh)
                x[front] = 0.0
                fresh, found = fresh[found > 0], found[found > 0]
                sigma[fresh] = found
            if not len(fresh):
                break
            open_[fresh] = False
            layers.append(fresh)
            sizes.append(int(self.degree[fresh].sum()))
            rest -= sizes[-1]
        delta = np.zeros(len(layers[-1]))
        for step in range(len(layers) - 1, 1, -1):
            here, before, few = layers[step], layers[step - 1], sizes[step] * 8 < self.n
            share = (1 + delta) / sigma[here]
            if sizes[step] < sizes[step - 1]:
                at = self._push(here, share, few)
                delta = sigma[before] * x[before]
                x[at if few else slice(None)] = 0.0
            else:
                x[here] = share
                delta = sigma[before] * self._pull(before)
                x[here] = 0.0
            self.total[before] += delta


def reach(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """``(node_id, depth)``: nodes within ``hops`` successor steps of the seeds, at their least depth."""
    seen = seeds.select("node_id").distinct().withColumn("depth", F.lit(0))
    out = edges.select("src", "dst").distinct()
    front = seen
    for d in range(1, hops + 1):
        step = front.join(out, front["node_id"] == out["src"]).select(F.col("dst").alias("node_id")).distinct()
        front = step.join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def touching_triples(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct ``(src, relation, dst)`` with an end among ``members(node_id)``."""
    ids = members.select("node_id").distinct()
    out = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").select("src", "relation", "dst")
    return out.unionByName(edges.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "relation", "dst")).distinct()


def ego_sets(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """``(hub, node_id)``: each hub with its neighbours."""
    h = hubs.select(F.col("node_id").alias("hub"))
    near = h.join(edges, h["hub"] == edges["src"]).select("hub", F.col("dst").alias("node_id"))
    return near.unionByName(h.select("hub", F.col("hub").alias("node_id"))).distinct()


def merge_sets(sets: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``sets(hub, node_id)`` -> ``(group_id, node_id)``: sets that share a node, or are linked by one of ``edges``, become one group, named by its smallest hub."""
    # a set is linked with its nodes and an edge's ends with each other, so no pairs of sets are made
    links = sets.select(F.concat(F.lit("set|"), "hub").alias("src"), F.concat(F.lit("node|"), "node_id").alias("dst"))
    if edges is not None:
        member = sets.select("node_id").distinct()
        inner = edges.select("src", "dst").distinct().join(member.withColumnRenamed("node_id", "src"), "src", "left_semi").join(member.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        links = links.unionByName(inner.select(*[F.concat(F.lit("node|"), c).alias(c) for c in ("src", "dst")]))
    found = components(links)
    hubs = sets.select("hub").distinct().withColumn("node", F.concat(F.lit("set|"), "hub"))
    comp = hubs.join(found, "node", "left").select("hub", F.coalesce("component", "node").alias("c"))
    named = comp.join(comp.groupBy("c").agg(F.min("hub").alias("group_id")), "c").select("hub", "group_id")
    return sets.join(named, "hub").select("group_id", "node_id").distinct()


def largest_group(groups: DataFrame) -> DataFrame:
    """The members of the largest group (ties: the smallest name)."""
    top = groups.groupBy("group_id").count().orderBy(F.desc("count"), "group_id").limit(1).select("group_id")
    return groups.join(F.broadcast(top), "group_id", "left_semi")  # one row
