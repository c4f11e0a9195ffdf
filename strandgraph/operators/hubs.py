"""Hub groups: semantic and structural centrality with inclusive percentile thresholds."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.vectors import cosine, literal
from strandgraph.operators.graph import betweenness, degree_centrality
from strandgraph.storage import Scratch

#: Fixed value: scores are rounded so that a node equal to the threshold is not lost to summation order.
DIGITS = 6


class StructuralMix(Enum):
    """Weights of degree and betweenness."""

    DEGREE = (1.0, 0.0)
    BETWEENNESS = (0.0, 1.0)
    AVERAGE = (0.5, 0.5)
    DEGREE_HEAVY = (0.8, 0.2)


def mean_vector(vectors: DataFrame, eps: float = 1e-9) -> list[float]:
    """The mean of ``vectors(embedding)``, over its length; one row of fixed width reaches the driver."""
    dims = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = [r["m"] for r in sorted(dims.collect(), key=lambda r: r["i"])]
    size = sum(x * x for x in mean) ** 0.5
    return [x / (size + eps) for x in mean]


def semantic_centrality(nodes: DataFrame) -> DataFrame:
    """``nodes(node_id, embedding)`` -> ``(node_id, centrality)``: cosine to the mean, not below 0; 0 without a vector."""
    mean = mean_vector(nodes.filter("embedding is not null").select("embedding"))
    if not mean:
        return nodes.select("node_id", F.lit(0.0).alias("centrality"))
    c = F.greatest(F.lit(0.0), cosine(F.col("embedding"), literal(mean), 1e-9))
    return nodes.select("node_id", F.round(F.coalesce(c, F.lit(0.0)), DIGITS).alias("centrality"))


def over_percentile(scores: DataFrame, percent: float = 80.0) -> DataFrame:
    """Rows of ``(node_id, centrality)`` at or above the exact, interpolated percentile."""
    limit = scores.agg(F.percentile("centrality", F.lit(percent / 100))).first()[0]
    return scores.filter(F.round("centrality", DIGITS) >= F.round(F.lit(limit), DIGITS)) if limit is not None else scores.limit(0)


def semantic_hub(nodes: DataFrame, percent: float = 80.0) -> DataFrame:
    """Nodes near the mean of all vectors."""
    return over_percentile(semantic_centrality(nodes), percent)


def structural_centrality(ids: DataFrame, edges: DataFrame, mix: StructuralMix = StructuralMix.DEGREE_HEAVY) -> DataFrame:
    """``(node_id, centrality)``: the mix of degree and betweenness centrality."""
    wd, wb = mix.value
    deg = degree_centrality(ids, edges)
    if not wb:
        return deg.select("node_id", F.round(F.col("centrality") * wd, DIGITS).alias("centrality"))
    scratch = Scratch(ids.sparkSession)
    edges = scratch.write(edges.select("src", "dst"))  # read three times
    scratch.release()
    deg = scratch.write(degree_centrality(ids, edges), compact=True)
    btw = betweenness(ids, edges)
    scratch.release()
    return deg.join(btw, "node_id").select("node_id", F.round(F.col("centrality") * wd + F.col("betweenness") * wb, DIGITS).alias("centrality"))


def structural_hub(ids: DataFrame, edges: DataFrame, mix: StructuralMix = StructuralMix.DEGREE_HEAVY, percent: float = 80.0) -> DataFrame:
    """Nodes of high structural centrality."""
    scores = structural_centrality(ids, edges, mix)
    # the threshold and the rows over it are two reads, and paths are counted once
    return over_percentile(Scratch(ids.sparkSession).write(scores, compact=True) if mix.value[1] else scores, percent)


def hub_profile(hub: DataFrame, nodes: DataFrame, kind: str = "semantic", sample: int = 50, named: int = 5) -> DataFrame:
    """One row: size, coverage, a sample of member ids by hash, a description with names of the first of them, and the members' mean vector over its length."""
    n, size = nodes.count(), hub.count()
    members = hub.select("node_id").join(nodes, "node_id")
    few = members.select("node_id", "name", F.md5("node_id").alias("h")).orderBy("h", "node_id").limit(sample)
    listed = F.array_sort(F.collect_list(F.struct("h", "node_id", "name")))
    picked = few.agg(F.transform(listed, lambda r: r["node_id"]).alias("sample"), F.array_join(F.slice(F.transform(listed, lambda r: r["name"]), 1, named), ", ").alias("names"))
    what = F.concat(F.lit(f"{kind.capitalize()} hub of {size} nodes, among them "), "names")
    mean = mean_vector(members.filter("embedding is not null").select("embedding")) if size else []
    return picked.select(F.lit(size).cast("long").alias("size"), F.lit(size / max(n, 1)).alias("coverage"), "sample", F.when(F.col("names") != "", what).otherwise(f"Empty {kind} hub").alias("description"), literal(mean).cast("array<double>").alias("embedding"))
