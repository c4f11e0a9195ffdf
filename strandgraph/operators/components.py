"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.storage import Scratch


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, component)``.

    ``component`` is the smallest node of the component; the smallest node
    itself and nodes without edges have no row.  Null ends and self-loops are
    ignored.  Every round only groups by a node with a combinable minimum and
    joins against tables written to the shared folder, so a hub node's rows can
    be split by the adaptive skew join.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = scratch.write(e.filter("u is not null and v is not null and u <> v").distinct(), compact=True)
    before = _digest(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), compact=True)
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.distinct(), compact=True)
        low2 = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), compact=True)
        small = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.write(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), compact=True)
        scratch.drop(e, low, large, low2)
        after = _digest(small)
        e = small
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
