import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.hooks import HashingEncoder
from strandgraph.operators import experts, graph, memberships, retrieval
from strandgraph.plans.fixture import Fixture
from strandgraph.storage import Scratch

DIR = "/root/testdata/sf0.001"


def _vectors(spark, x):
    return spark.createDataFrame([(f"n{i:03}", [float(v) for v in r]) for i, r in enumerate(x)], "node_id string, embedding array<float>")


def _reference_memberships(x, c):
    cos = (x @ c.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(c, axis=1)[None]
    d = np.maximum((1 - cos) ** 2, 1e-10)
    w = d**-2.0
    return w / w.sum(1, keepdims=True)


def test_fuzzy_clustering_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)).astype(np.float32).astype(np.float64)
    c = x[:4].copy()
    got = experts.fuzzy_c_means(_vectors(spark, x), c, rounds=3)
    want = c
    for _ in range(3):
        um = _reference_memberships(x, want) ** 1.5
        want = um.T @ x / um.sum(0)[:, None]
        want = want / np.linalg.norm(want, axis=1)[:, None]
    assert got == pytest.approx(want, abs=1e-8)
    u = experts.memberships(_vectors(spark, x), want)
    assert u.groupBy("node_id").agg(F.sum("u").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_seeds_are_distinct_and_repeatable(spark):
    x = np.eye(6).repeat(5, axis=0)
    a, b = experts.seed_centroids(_vectors(spark, x), 6), experts.seed_centroids(_vectors(spark, x), 6)
    assert len(np.unique(a, axis=0)) == 6
    assert (a == b).all()


def test_adaptive_threshold_falls_to_the_floor(spark):
    u = spark.createDataFrame([("a", 0, 0.9), ("b", 0, 0.5), ("c", 1, 0.02)], "node_id string, k int, u double")
    assert experts.adaptive_threshold(u) == 0.05
    assert experts.adaptive_threshold(u.filter("u < 0.05")) == 0.1


def test_adaptive_threshold_steps_evenly_from_five_to_fifty_percent(spark):
    u = spark.createDataFrame([(f"n{i}", 0, 0.06 if i < 7 else 0.04) for i in range(10)], "node_id string, k int, u double")
    assert experts.adaptive_threshold(u) == 0.05
    u = spark.createDataFrame([(f"n{i}", 0, 0.3 if i < 6 else 0.01) for i in range(10)], "node_id string, k int, u double")
    assert experts.adaptive_threshold(u) == 0.05  # never 70 percent: the first of the best


def test_an_empty_cluster_goes_on_from_a_row(spark):
    x = np.eye(3).repeat(4, axis=0)
    got = experts.fuzzy_c_means(_vectors(spark, x), np.array([[1.0, 0, 0], [0, 0, 0]]), rounds=1)
    assert np.linalg.norm(got, axis=1) == pytest.approx([1, 1])


def test_small_clusters_are_dropped_and_the_rest_renumbered(spark):
    u = spark.createDataFrame([(f"n{i}", k, 0.5) for k, n in ((0, 3), (2, 10), (5, 12)) for i in range(n)], "node_id string, k int, u double")
    got = {r["subgraph_id"]: r["count"] for r in experts.build_experts(u).groupBy("subgraph_id").count().collect()}
    assert got == {"Expert_1": 10, "Expert_2": 12}


def test_unassigned_rest(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    e = spark.createDataFrame([("Expert_1", "b", 0.5)], "subgraph_id string, node_id string, score double")
    got = memberships.all_groups(n.filter("node_id = 'a'"), n.limit(0), e, n)
    assert sorted((r["subgraph_id"], r["kind"], r["node_id"]) for r in got.collect()) == [("Expert_1", "expert", "b"), ("Shared_Semantic", "shared", "a"), ("Shared_Unassigned", "shared", "c")]


def test_last_wins_joins_paths(spark):
    r = spark.createDataFrame([(1, "g", "e", "x", 2.0, 5), (1, "g", "e", "y", 3.0, 9)], "query_id int, subgraph_id string, entity_id string, path string, similarity double, seq long")
    got = retrieval.last_wins(r).first()
    assert (got["path"], got["similarity"]) == ("x+y", 3.0)


def test_router_drops_zero_and_keeps_ties(spark):
    groups = spark.createDataFrame([("Expert_1", "a", "expert"), ("Expert_2", "b", "expert"), ("Expert_2", "c", "expert")], "subgraph_id string, node_id string, kind string")
    rec = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b")], "query_id int, entity_id string")
    got = sorted((r["query_id"], r["subgraph_id"], r["score"]) for r in retrieval.route(rec, groups).collect())
    assert got == [(1, "Expert_2", 1.0), (2, "Expert_1", 1.0), (2, "Expert_2", 1.0)]


def test_four_phases(spark):
    g = Fixture(spark, DIR)
    records, active = retrieval.retrieve(g.queries, g.nodes, g.edges, g.groups)
    active = active.collect()
    assert len(active) == len({tuple(r) for r in active})
    assert all(r["subgraph_id"].startswith("Expert_") for r in active)
    fused = retrieval.fuse(g.queries, records, g.chunk_vectors, 7)
    assert fused.groupBy("query_id").count().filter("count > 7").count() == 0
    assert fused.join(records, ["query_id", "chunk_id"], "left_anti").count() == 0
    assert retrieval.context(fused, retrieval.fuse_triples(records), g.chunks).filter("context is null").count() == 0


def test_group_without_vectors_or_edges_is_empty(spark):
    nodes = spark.createDataFrame([("a", "A", "c1", None)], "node_id string, name string, chunk_id string, embedding array<float>")
    edges = spark.createDataFrame([], "src string, dst string, relation string, ekey int")
    groups = spark.createDataFrame([("Shared_X", "a", "shared")], "subgraph_id string, node_id string, kind string")
    q = spark.createDataFrame([(1, [1.0])], "query_id int, qvec array<float>")
    act = spark.createDataFrame([(1, "Shared_X")], "query_id int, subgraph_id string")
    scratch = Scratch(spark)
    assert retrieval.group_search(q, retrieval.index(nodes, edges, groups, scratch), act, scratch).count() == 0


def test_search_equals_plain_products_on_odd_vectors(spark, monkeypatch):
    rows = [("a", "g", [1.0, 0.0]), ("b", "g", [2.0, 0.0]), ("c", "g", [1.0, 1e-4]), ("d", "h", [0.0, 1.0]), ("e", None, [1.0, 1.0]), ("f", "g", None), ("i", "g", [1.0, None]), ("j", "g", []), ("k", "h", [0.0, 0.0]), ("l", "g", [1.0, 2.0, 3.0]), ("a", "g", [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id string, subgraph_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [3.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, 1.0, 1.0])], "query_id int, qvec array<float>")
    active = spark.createDataFrame([(1, "g"), (2, "h"), (4, "g"), (4, "none"), (3, "g")], "query_id int, subgraph_id string")

    def every(v):
        said = [retrieval.top_k(q, v, 2, ["subgraph_id"]), retrieval.top_k(q, v, 2), retrieval.top_k_routed(q, v, active, 2)]
        return [sorted(map(str, d.select(*sorted(d.columns)).collect())) for d in said]

    got, none = every(vectors), every(vectors.limit(0))
    assert len(got[2]) == 5 and none == [[], [], []]  # two of g for 1, two of h for 2, the wide one for 4
    monkeypatch.setattr(retrieval, "BROADCAST", 0)
    assert every(vectors) == got and every(vectors.limit(0)) == none


def test_routed_search_is_the_same_with_split_groups(spark, monkeypatch):
    g = Fixture(spark, DIR)
    active = g.queries.select("query_id").crossJoin(g.groups.select("subgraph_id").distinct().limit(4).cache())
    vectors = g.groups.select("subgraph_id", "node_id").join(g.entities.select("node_id", "embedding"), "node_id").withColumnRenamed("node_id", "id")
    one = sorted(map(tuple, retrieval.top_k_routed(g.queries, vectors, active, 5).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST", 0)
    assert one and sorted(map(tuple, retrieval.top_k_routed(g.queries, vectors, active, 5).collect())) == one


def test_triples_are_encoded_as_text_and_rank_by_similarity(spark):
    nodes = spark.createDataFrame([("a", "Alice", "c1"), ("b", "Bob", "c2"), ("c", "Cyd", "c3")], "node_id string, name string, chunk_id string")
    edges = spark.createDataFrame([("a", "b", "knows", 0), ("a", "c", "hates", 0), ("b", "a", "paints", 0)], "src string, dst string, relation string, ekey int")
    encoder = HashingEncoder(64)
    vec = retrieval.triple_vectors(nodes, edges, encoder)
    got = {r["relation"]: np.array(r["embedding"]) for r in vec.collect()}
    assert got["knows"] == pytest.approx(encoder(["Alice knows Bob"])[0], abs=1e-6)
    hits = spark.createDataFrame([(1, "g", "a", 0.5, 1)], "query_id int, subgraph_id string, id string, score double, rank int")
    q = spark.createDataFrame([(1, encoder(["Alice hates Cyd"])[0].tolist())], "query_id int, qvec array<double>")
    records = retrieval.expand(hits, nodes, retrieval.links(edges, vec), q)
    ranked = retrieval.fuse_triples(records).orderBy("rank").collect()
    assert [r["relation"] for r in ranked] == ["hates", "knows"] and ranked[0]["similarity"] == pytest.approx(1.0, abs=1e-5)


def test_sets_merge_by_shared_nodes_and_by_edges(spark):
    g = Fixture(spark, DIR)
    few = g.entities.filter("cast(substring(node_id, 8) as int) < 60").select("node_id")
    thin = g.edges.filter("pmod(seq, 40) = 0")
    for edges, sets in ((None, graph.ego_sets(thin, few)), (thin, graph.ego_sets(thin.filter("src > dst"), few))):
        rows = [tuple(r) for r in sets.select("hub", "node_id").collect()]
        root = {h: h for h, _ in rows}
        said = [(h, k) for h, a in rows for k, b in rows if a == b]
        if edges is not None:
            links = {(r["src"], r["dst"]) for r in edges.collect()}
            said += [(h, k) for h, a in rows for k, b in rows if (a, b) in links]
        for _ in root:
            for h, k in said:
                root[h] = root[k] = min(root[h], root[k])
        assert len(set(root.values())) < len(root)
        want = {(root[h], n) for h, n in rows}
        assert {tuple(r) for r in graph.merge_sets(sets, edges).select("group_id", "node_id").collect()} == want


def test_short_names_are_found(spark):
    kw = spark.createDataFrame([("ex",), ("a",), ("exp",), ("",)], "keyword string")
    g = spark.createDataFrame([("Expert_1",), ("A",)], "subgraph_id string")
    assert sorted(tuple(r) for r in memberships.keyword_links(kw, g).collect()) == [("a", "A"), ("ex", "Expert_1"), ("exp", "Expert_1")]


def test_keyword_links(spark):
    kw = spark.createDataFrame([("ab",), ("hello expert_1!",), ("shared",)], "keyword string")
    g = spark.createDataFrame([("Expert_1",), ("Shared_A",), ("AB",)], "subgraph_id string")
    assert sorted(tuple(r) for r in memberships.keyword_links(kw, g).collect()) == [("ab", "AB"), ("hello expert_1!", "Expert_1"), ("shared", "Shared_A")]


def test_triples_are_searched_without_vectors_of_their_own(spark):
    g, scratch = Fixture(spark, "/root/testdata/sf0.001"), Scratch(spark)
    edges, groups, q = scratch.write(g.edges), scratch.write(g.groups), g.queries
    act = q.select("query_id").crossJoin(groups.filter("kind = 'shared'").select("subgraph_id").distinct())
    slim, wide = retrieval.index(g.nodes, edges, groups, scratch, queries=q), retrieval.index(g.nodes, edges, groups, scratch)
    assert "embedding" not in slim.triples.columns and "unit" not in slim.near.columns
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "subgraph_id", "id", "score", "rank").collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert rows(retrieval.triples_routed(slim, act, 7)) == rows(retrieval.top_k_routed(q, wide.inside, act, 7))
        assert sorted(map(str, retrieval.group_search(q, slim, act, scratch).collect())) == sorted(map(str, retrieval.group_search(q, wide, act, scratch).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_four_phases_by_entities_alone(spark, monkeypatch):
    g, scratch = Fixture(spark, DIR), Scratch(spark)
    edges, groups = scratch.write(g.edges), scratch.write(g.groups)
    triples = edges.select("src", "relation", "dst")
    rows = lambda df: sorted(map(str, df.select("query_id", "entity_id", "chunk_id").distinct().collect()))
    want = rows(retrieval.retrieve(g.queries, g.nodes, edges, groups)[0])
    got = retrieval.retrieve_entities(g.queries, g.nodes, triples, groups)
    assert got.columns == ["query_id", "entity_id", "chunk_id"] and rows(got) == want  # nothing else is written
    monkeypatch.setattr(retrieval, "HELD", 0)
    assert rows(retrieval.retrieve_entities(g.queries, g.nodes, triples, groups)) == want


def test_no_vector_is_shuffled_with_a_candidate_of_a_query(spark):
    g = Fixture(spark, DIR)
    records = g.queries.select("query_id").crossJoin(g.entities.select(F.col("node_id").alias("entity_id"), "chunk_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fused = retrieval.fuse(g.queries, records, g.chunk_vectors, 7)
        plan = fused._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2  # a document's vector, and a candidate with it; none for the queries
        assert fused.count() == 7 * g.queries.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_best_triples_without_records(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vec = {f"n{i:02}": rng.normal(size=4).tolist() for i in range(40)} | {"n01": None, "n02": [0.0] * 4, "n03": [float("nan")] + [1.0] * 3, "n04": [1.0, 2.0], "n05": [1.0, None, 0.0, 2.0]}
    nodes = spark.createDataFrame([(x, f"c{x}", e) for x, e in vec.items()], "node_id string, chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(7)] + [(7, None)], "query_id long, qvec array<double>")
    near = spark.createDataFrame([(f"n{i:02}", f"n{j:02}", f"r{(i + j) % 3}") for i in range(40) for j in range(0, 42, 1 + i % 3)], "src string, dst string, relation string")
    hits = spark.createDataFrame([(q, g, f"n{(q * 5 + r) % 41:02}", 0.5, r + 1) for q in range(8) for g in ("A", "B") for r in range(6)], "query_id long, subgraph_id string, id string, score double, rank int")

    def plain(df):
        return sorted(map(repr, (tuple(r) for r in df.select("query_id", "src", "relation", "dst", "similarity", "rank").collect())))

    vectors = retrieval.ends(nodes, queries)
    want = plain(retrieval.fuse_triples(retrieval.expand(hits, nodes, retrieval.placed(near), queries, vectors), 5))
    assert len(want) == 8 * 5
    df = retrieval.best_triples(hits, near.repartition(3), nodes, queries, 5)
    assert plain(df) == want and "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    monkeypatch.setattr(retrieval, "FEW", 0)
    assert plain(retrieval.best_triples(hits, near, nodes, queries, 5)) == want


def test_successors_of_hits_are_not_sorted(spark):
    g = Fixture(spark, DIR)
    plan = g.near._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan and "Window" not in plan
    want = graph.successors(g.edges).join(g.hits.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    got = g.near.filter("relation <> 'has_attribute'")
    assert sorted(map(tuple, got.select("src", "dst", "relation").collect())) == sorted(map(tuple, want.select("src", "dst", "relation").collect()))


def test_dual_path_meets_as_bits(spark, monkeypatch):
    from strandgraph.operators import content

    rng = np.random.default_rng(5)
    vec = {f"n{i:02}": rng.normal(size=3).tolist() for i in range(30)} | {"n01": None, "n02": [0.0] * 3, "n03": [1.0, 2.0], "n04": [1.0, None, 0.0]}
    nodes = spark.createDataFrame(list(vec.items()), "node_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(70)], "query_id long, qvec array<double>")
    pairs = spark.createDataFrame([(f"n{i:02}", f"n{j:02}", "r") for i in range(30) for j in (i, (i * 7 + 3) % 32, (i * 5) % 30)], "src string, dst string, relation string")
    groups = spark.createDataFrame([(g, f"n{i:02}") for g, s in (("A", 4), ("B", 5)) for i in range(0, 30, s) if i != 4], "subgraph_id string, node_id string")
    hits = spark.createDataFrame([(q, g) for q in range(70) for g in ("A", "B", "C") if q % 3 and (g == "A" or q % 2)], "query_id long, id string")

    def plain(df):
        return sorted(map(repr, (tuple(r) for r in df.select("query_id", "node_id", "paths", "score").collect())))

    df = content.dual_path(queries, pairs.union(pairs), nodes, groups, hits)
    assert "Aggregate [query_id" not in df._jdf.queryExecution().optimizedPlan().toString()  # no row for each query, pair and task is gathered
    got = plain(df)
    assert content.dual_path(queries.limit(0), pairs, nodes, groups, hits).count() == 0
    monkeypatch.setattr(retrieval, "HELD", 0)
    assert got == plain(content.dual_path(queries, pairs, nodes, groups, hits)) and any("group+triple" in x for x in got)
