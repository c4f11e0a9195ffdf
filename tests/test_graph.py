import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandgraph.operators import extract, graph, hubs
from strandgraph.operators.components import components


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, f"r{i}", i, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, relation string, ekey int, seq long")


def _ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def test_triples_of_wrong_length(spark):
    rec = spark.createDataFrame([("c", [["a", "r", "b"], ["a", "r"], ["a", "r", "b", "x"]])], "chunk_id string, triples array<array<string>>")
    assert sorted(tuple(r)[2:] for r in extract.valid_triples(rec).collect()) == [("a", "r", "b"), ("a", "r", "b")]


def test_dedup_keeps_first_and_counts_parallel(spark):
    e = spark.createDataFrame([("a", "b", "x", 3), ("a", "b", "y", 1), ("a", "b", "x", 0)], "src string, dst string, relation string, seq long")
    assert sorted((r["relation"], r["seq"], r["ekey"]) for r in extract.dedup_edges(e).collect()) == [("x", 0, 0), ("y", 1, 1)]


def test_merge_modes(spark):
    e = spark.createDataFrame([("a", "b", 0, "x", 0), ("a", "b", 0, "y", 1)], "src string, dst string, ekey int, relation string, seq long")
    assert extract.merge_edges(e).count() == 2
    assert [r["relation"] for r in extract.merge_edges(e, compat=True).collect()] == ["y"]


def test_merge_by_name_numbers_in_order(spark):
    n = spark.createDataFrame([("B", "entity", 5), ("A", "entity", 2), ("B", "attribute", 1), ("C", "entity", 9)], "name string, label string, seq long")
    assert {r["name"]: r["node_id"] for r in extract.merge_by_name(n).collect()} == {"B": "attribute_0", "A": "entity_0", "C": "entity_1"}


def test_checked_nodes(spark):
    bad = spark.createDataFrame([("x", None, "n")], "node_id string, label string, name string")
    with pytest.raises(PySparkException):
        extract.checked_nodes(bad).collect()


def test_degree_counts_parallel_and_loops(spark):
    e = _edges(spark, [("a", "b"), ("a", "b"), ("c", "c")])
    got = {r["node_id"]: r["degree"] for r in graph.degree_centrality(_ids(spark, "abcd"), e).collect()}
    assert got == {"a": 2, "b": 2, "c": 2, "d": 0}


def test_betweenness_by_hand(spark):
    # a path a-b-c-d with a parallel edge: b and c each lie on 2 of 3 pairs
    e = _edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")])
    got = {r["node_id"]: r["betweenness"] for r in graph.betweenness(_ids(spark, "abcd"), e).collect()}
    assert got == pytest.approx({"a": 0, "b": 2 / 3, "c": 2 / 3, "d": 0})


def test_betweenness_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 12
    adj = np.triu(rng.random((n, n)) < 0.25, 1)
    pairs = [(f"n{i:02}", f"n{j:02}") for i, j in np.argwhere(adj)]
    adj = adj | adj.T
    dist, paths = np.full((n, n), 99), np.zeros((n, n))
    for s in range(n):
        dist[s, s], paths[s, s] = 0, 1
        for d in range(n):
            for u in np.flatnonzero(dist[s] == d):
                for v in np.flatnonzero(adj[u]):
                    if dist[s, v] > d + 1:
                        dist[s, v] = d + 1
                    if dist[s, v] == d + 1:
                        paths[s, v] += paths[s, u]
    want = [sum(paths[s, v] * paths[v, t] / paths[s, t] for s in range(n) for t in range(n) if len({s, v, t}) == 3 and dist[s, t] < 99 and dist[s, v] + dist[v, t] == dist[s, t]) / ((n - 1) * (n - 2)) for v in range(n)]
    got = {r["node_id"]: r["betweenness"] for r in graph.betweenness(_ids(spark, [f"n{i:02}" for i in range(n)]), _edges(spark, pairs)).collect()}
    assert [got[f"n{i:02}"] for i in range(n)] == pytest.approx(want)


def _stars(spark, hubs_=30, leaves=40):
    """Hubs linked with each other, each with leaves; nodes, edges and a hub's betweenness."""
    pairs = [(f"h{a:02}", f"h{b:02}") for a in range(hubs_) for b in range(a)] + [(f"h{a:02}", f"h{a:02}_{i}") for a in range(hubs_) for i in range(leaves)]
    n = hubs_ * (leaves + 1)
    return _ids(spark, sorted({x for p in pairs for x in p})), _edges(spark, pairs), (2 * leaves * (n - 1 - leaves) + leaves * (leaves - 1)) / ((n - 1) * (n - 2))


def test_betweenness_counts_paths_from_all_nodes(spark):
    ids, edges, want = _stars(spark)
    got = {r["node_id"]: r["betweenness"] for r in graph.betweenness(ids, edges).collect()}
    assert got == {x: pytest.approx(want if "_" not in x else 0.0) for x in got}
    assert len(got) == 1230


def test_betweenness_refuses_no_size(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_ADJACENCY", 0, raising=False)
    monkeypatch.setattr(graph, "SLAB", 3, raising=False)
    ids, edges, want = _stars(spark, 3, 2)
    got = {r["node_id"]: r["betweenness"] for r in graph.betweenness(ids, edges).collect()}
    assert got == {x: pytest.approx(want if "_" not in x else 0.0) for x in got}


def test_mixed_hub_by_exact_betweenness(spark):
    ids, edges, want = _stars(spark)
    got = {r["node_id"]: r["centrality"] for r in hubs.structural_centrality(ids, edges).collect()}
    assert got == {x: pytest.approx(0.8 * (69 if "_" not in x else 1) / 1229 + 0.2 * (want if "_" not in x else 0), abs=1e-6) for x in got}


def test_reach_is_three_hops(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("c", "a")])
    got = {r["node_id"]: r["depth"] for r in graph.reach(e, _ids(spark, "a")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_merge_sets(spark):
    s = spark.createDataFrame([("h1", "x"), ("h2", "x"), ("h2", "y"), ("h3", "z")], "hub string, node_id string")
    assert sorted(tuple(r) for r in graph.merge_sets(s).collect()) == [("h1", "x"), ("h1", "y"), ("h3", "z")]
    assert {r["node_id"] for r in graph.largest_group(graph.merge_sets(s)).collect()} == {"x", "y"}


def test_components_against_union_find(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(500, 501)] * 3
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = components(spark.createDataFrame(pairs + [(None, 3)], "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_percentile_is_inclusive(spark):
    s = spark.createDataFrame([(str(i), float(i)) for i in range(1, 7)], "node_id string, centrality double")
    assert {r["node_id"] for r in hubs.over_percentile(s, 80).collect()} == {"5", "6"}


def test_semantic_hub_without_vectors(spark):
    n = spark.createDataFrame([("a", None)], "node_id string, embedding array<float>")
    assert hubs.semantic_centrality(n).first()["centrality"] == 0.0


def test_number_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.lit(1000) - F.col("id")).alias("o")).repartition(7)
    got = extract.number(df, "k", "o", "i").collect()
    for k in range(3):
        rows = sorted((r["o"], r["i"]) for r in got if r["k"] == k)
        assert [i for _, i in rows] == list(range(len(rows)))


def test_number_where_the_plan_is_evaluated_twice(spark):
    df = spark.range(40_000).select((F.col("id") % 3).alias("k"), (F.hash("id").cast("long") * 100_000 + F.col("id")).alias("o")).repartition(7)
    held = ("spark.sql.exchange.reuse", "spark.sql.adaptive.coalescePartitions.enabled")
    for name in held:
        spark.conf.set(name, "false")
    try:
        got = extract.number(df, "k", "o", "i").collect()
    finally:
        for name in held:
            spark.conf.unset(name)
    for k in range(3):
        rows = sorted((r["o"], r["i"]) for r in got if r["k"] == k)
        assert len(rows) == (40_002 - k) // 3
        assert [i for _, i in rows] == list(range(len(rows)))


def _path_counter(pairs, n):
    half = np.array(sorted({(a, b) for p in pairs if p[0] != p[1] for a, b in (p, p[::-1])})).reshape(-1, 2)
    return graph._Paths(half[:, 1].astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(half[:, 0], minlength=n)))))


class _Read(np.ndarray):
    """Counts the entries that are read in slices."""

    seen = 0

    def __getitem__(self, key):
        if isinstance(key, slice):
            _Read.seen += key.stop - key.start
        return np.asarray(self)[key]


def test_paths_are_counted_without_reading_all_edges_at_each_level():
    # a line of 400 nodes and a clique of 60 that is one step from its end
    pairs = [(i, i + 1) for i in range(400)] + [(a, b) for a in range(400, 460) for b in range(400, a)]
    paths = _path_counter(pairs, 460)
    paths.dst, _Read.seen = paths.dst.view(_Read), 0
    paths.add(0)
    assert _Read.seen <= 3 * len(paths.dst)
    # each inner node of the line is on all paths to what lies behind it
    assert paths.total[1:400].tolist() == pytest.approx([459.0 - i for i in range(1, 400)])


@pytest.mark.parametrize("slab", [3, 1 << 17])
def test_paths_from_either_side_of_a_level(monkeypatch, slab):
    monkeypatch.setattr(graph, "SLAB", slab)
    rng = np.random.default_rng(4)
    for n, m in ((60, 50), (60, 200), (60, 1500)):
        pairs = [tuple(p) for p in rng.integers(0, n, (m, 2)).tolist()]
        adj = np.zeros((n, n), bool)
        for a, b in pairs:
            adj[a, b] = adj[b, a] = a != b or adj[a, b]
        np.fill_diagonal(adj, False)
        dist, count = np.full((n, n), np.inf), np.eye(n)
        np.fill_diagonal(dist, 0)
        walks = np.eye(n)
        for d in range(1, n):
            walks = np.where(dist == d - 1, count, 0) @ adj
            fresh = np.isinf(dist) & (walks > 0)
            dist[fresh], count[fresh] = d, walks[fresh]
        want = np.zeros(n)
        for v in range(n):
            on = (dist[:, v, None] + dist[None, v, :] == dist) & np.isfinite(dist)
            on[v], on[:, v] = False, False
            np.fill_diagonal(on, False)
            want[v] = np.divide(count[:, v, None] * count[None, v, :], count, out=np.zeros((n, n)), where=on).sum()
        paths = _path_counter(pairs, n)
        for source in range(n):
            paths.add(source)
        assert paths.total == pytest.approx(want)


def test_mixed_hub_counts_paths_once(spark, monkeypatch):
    ids, edges, _ = _stars(spark, 4, 5)
    want = {r["node_id"] for r in hubs.over_percentile(hubs.structural_centrality(ids, edges)).collect()}
    hub = hubs.structural_hub(ids, edges)
    assert "MapInArrow" not in hub._jdf.queryExecution().optimizedPlan().toString()
    assert {r["node_id"] for r in hub.collect()} == want == {"h00", "h01", "h02", "h03"} | want


@pytest.mark.parametrize("short", [1 << 18, 0])
def test_neighbours_in_two_bytes(spark, short, monkeypatch):
    monkeypatch.setattr(graph, "SHORT", short)
    rng = np.random.default_rng(2)
    n = (1 << 16) + 40
    u = rng.integers(0, n, 300)
    ends = [(int(a), int(b)) for a, b in zip(u, (u * 7 + 65_530) % n)]
    start = np.zeros(2 * n + 1, np.int64)
    rows = sorted({(a, b) for x, y in ends if x != y for a, b in ((x, y), (y, x))})
    for a, b in rows:
        start[2 * a + (b >> 16) + 1] += 1
    start = np.cumsum(start)
    plain = graph._Paths(np.array([b for _, b in rows], np.int32), start[::2])
    split = graph._Paths(np.array([b & 65535 for _, b in rows], np.uint16), start, 2)
    for source in sorted({a for a, _ in rows}):
        plain.add(source)
        split.add(source)
    assert (plain.total == split.total).all() and plain.total.any()

    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node_id"))
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in ends], "src string, dst string")
    got = {r["node_id"]: r["betweenness"] * (n - 1) * (n - 2) for r in graph.betweenness(nodes, edges).filter("betweenness > 0").collect()}
    assert got == pytest.approx({f"n{i}": plain.total[i] for i in np.flatnonzero(plain.total)})
