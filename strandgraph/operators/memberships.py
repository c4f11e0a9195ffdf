"""Memberships ``(subgraph_id, kind, node_id)`` and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind_of(subgraph_id: Column) -> Column:
    """``shared`` or ``expert``."""
    return F.when(subgraph_id.contains("Shared_"), "shared").otherwise("expert")


def all_groups(semantic: DataFrame, structural: DataFrame, experts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Memberships of both hubs and the experts, and ``Shared_Unassigned`` for nodes in none."""
    hubs = semantic.select(F.lit("Shared_Semantic").alias("subgraph_id"), "node_id").unionByName(structural.select(F.lit("Shared_Structural").alias("subgraph_id"), "node_id"))
    some = hubs.unionByName(experts.select("subgraph_id", "node_id"))
    rest = nodes.select("node_id").join(some.select("node_id").distinct(), "node_id", "left_anti").select(F.lit("Shared_Unassigned").alias("subgraph_id"), "node_id")
    return some.unionByName(rest).withColumn("kind", kind_of(F.col("subgraph_id")))


def of_nodes(groups: DataFrame) -> DataFrame:
    """``(node_id, subgraphs)``: each node's groups, sorted."""
    return groups.groupBy("node_id").agg(F.sort_array(F.collect_set("subgraph_id")).alias("subgraphs"))


def super_nodes(groups: DataFrame) -> DataFrame:
    """A level-4 node per group."""
    return groups.select("subgraph_id", "kind").distinct().select(F.col("subgraph_id").alias("node_id"), F.col("subgraph_id").alias("name"), F.concat("kind", F.lit("_subGraph")).alias("label"), F.lit(4).alias("level"))


def contains_edges(groups: DataFrame) -> DataFrame:
    """``contains`` edges from each group to its members."""
    return groups.select(F.col("subgraph_id").alias("src"), F.col("node_id").alias("dst"), F.lit("contains").alias("relation"))


def sizes(groups: DataFrame) -> DataFrame:
    """``(kind, groups, smallest, largest, mean)``."""
    per = groups.groupBy("kind", "subgraph_id").count()
    return per.groupBy("kind").agg(F.count("*").alias("groups"), F.min("count").alias("smallest"), F.max("count").alias("largest"), F.avg("count").alias("mean"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes in both."""
    return a.select("node_id").intersect(b.select("node_id"))


def keyword_links(keywords: DataFrame, groups: DataFrame) -> DataFrame:
    """``(keyword, subgraph_id)`` where either name is part of the other, regardless of case.

    The part's last three characters (all, if it has fewer) stand somewhere in
    the whole: pairs meet there, in either direction.
    """

    def end(text: Column) -> Column:
        return F.array(F.right(F.lower(text), F.lit(3)))

    def grams(text: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(F.lower(text), i, F.lit(n)))

    def inside(text: Column) -> Column:
        every = F.concat(*[grams(text, n) for n in (1, 2, 3)])
        return F.array_distinct(F.when(F.length(text) > 0, every).otherwise(F.array().cast("array<string>")))

    names = groups.select("subgraph_id").distinct()
    pairs = []
    for of_k, of_s in ((end, inside), (inside, end)):
        k = keywords.select("keyword", F.explode(of_k(F.col("keyword"))).alias("g"))
        pairs.append(k.join(names.select("subgraph_id", F.explode(of_s(F.col("subgraph_id"))).alias("g")), "g"))
    both = pairs[0].unionByName(pairs[1]).select("keyword", "subgraph_id").distinct()
    a, b = F.lower("keyword"), F.lower("subgraph_id")
    return both.filter(F.contains(a, b) | F.contains(b, a))
