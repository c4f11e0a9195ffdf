"""From documents and extraction records to a property multigraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions.text import short_id
from strandgraph.storage import Scratch

#: Levels of node labels; other labels are level 2.
LEVELS = {"attribute": 1, "entity": 2, "keyword": 3, "subGraph": 4, "shared_subGraph": 4, "expert_subGraph": 4}


def level_of(label: Column) -> Column:
    """The level of a label."""
    pairs = [F.lit(x) for kv in LEVELS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[label], F.lit(2))


def chunk(docs: DataFrame, whole: bool = True, first_line_only: bool = False) -> DataFrame:
    """``docs(doc_id, title, text)`` -> ``(chunk_id, doc_id, chunk_text)``; one chunk per document, ids from content."""
    text = F.trim(F.concat_ws(" ", "title", "text")) if whole else F.to_json(F.struct("title", "text"))
    if first_line_only:
        text = F.substring_index(text, "\n", 1)
    return docs.select(short_id(text, F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id", text.alias("chunk_text"))


def valid_triples(records: DataFrame) -> DataFrame:
    """``records(chunk_id, triples)`` -> ``(chunk_id, pos, s, r, o)``; longer lists are cut to three, shorter ones dropped."""
    rows = records.select("chunk_id", F.posexplode("triples").alias("pos", "t")).filter(F.size("t") >= 3)
    return rows.select("chunk_id", "pos", F.col("t")[0].alias("s"), F.col("t")[1].alias("r"), F.col("t")[2].alias("o"))


def attribute_rows(records: DataFrame) -> DataFrame:
    """``records(chunk_id, attributes)`` -> ``(chunk_id, entity, attribute)``."""
    rows = records.select("chunk_id", F.explode("attributes").alias("entity", "values"))
    return rows.select("chunk_id", "entity", F.explode("values").alias("attribute"))


def entity_types(records: DataFrame) -> DataFrame:
    """``records(chunk_id, entity_types)`` -> ``(chunk_id, name, schema_type)``."""
    return records.select("chunk_id", F.explode("entity_types").alias("name", "schema_type"))


def mention_nodes(records: DataFrame) -> DataFrame:
    """Per chunk: ``(chunk_id, name, label, level, schema_type)`` of entities and attributes; an entity is one per (name, chunk)."""
    triples, attrs = valid_triples(records), attribute_rows(records)
    entities = triples.select("chunk_id", F.explode(F.array("s", "o")).alias("name")).unionByName(attrs.select("chunk_id", F.col("entity").alias("name"))).distinct()
    entities = entities.join(entity_types(records), ["chunk_id", "name"], "left").withColumn("label", F.lit("entity"))
    attributes = attrs.select("chunk_id", F.col("attribute").alias("name")).distinct().withColumns({"schema_type": F.lit(None).cast("string"), "label": F.lit("attribute")})
    out = entities.unionByName(attributes)
    return out.withColumn("level", level_of(F.col("label"))).select("chunk_id", "name", "label", "level", "schema_type")


def mention_edges(records: DataFrame) -> DataFrame:
    """``(chunk_id, src, dst, relation)`` by name; attributes give ``has_attribute``."""
    a = attribute_rows(records).select("chunk_id", F.col("entity").alias("src"), F.col("attribute").alias("dst"), F.lit("has_attribute").alias("relation"))
    return a.unionByName(valid_triples(records).select("chunk_id", F.col("s").alias("src"), F.col("o").alias("dst"), F.col("r").alias("relation")))


def dedup_edges(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``edges(src, dst, relation, seq)`` -> one row per triple, its first ``seq``, and ``ekey`` counting parallel edges from 0."""
    keys = keys or ["src", "dst"]
    first = edges.groupBy(*keys, "relation").agg(F.min("seq").alias("seq"))
    return first.withColumn("ekey", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) - 1)


def merge_by_name(nodes: DataFrame) -> DataFrame:
    """``nodes(name, label, seq, ...)`` -> one node per name, the first seen, numbered ``label_0 ..`` in that order.

    Numbering needs each label's nodes in order; it sorts over all partitions
    and adds up the partitions' counts, so no label has to fit in one task.
    """
    rest = [c for c in nodes.columns if c != "name"]
    first = nodes.groupBy("name").agg(F.min_by(F.struct(*rest), "seq").alias("n")).select("name", "n.*")
    return number(first, "label", "seq", "num").withColumn("node_id", F.concat_ws("_", "label", "num")).drop("num")


def number(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Adds 0, 1, ... within each ``key`` by ``order`` without gathering a key in one task."""
    # written once: where ranges are cut comes from a sample, and a second evaluation may cut elsewhere
    placed = Scratch(df.sparkSession).write(df.repartitionByRange(key, order).withColumn("__p", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("__p", key).orderBy(order)) - 1
    counts = placed.groupBy("__p", key).count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__p", key, before.alias("__b"))
    return placed.join(offsets, ["__p", key]).withColumn(name, within + F.col("__b")).drop("__p", "__b")


def merge_edges(edges: DataFrame, compat: bool = False) -> DataFrame:
    """Edges ``(src, dst, ekey, relation, seq)`` after renaming: all distinct relations, or in compatibility mode one (the last) per key."""
    if compat:
        return edges.groupBy("src", "dst", "ekey").agg(F.max_by("relation", "seq").alias("relation"))
    return edges.select("src", "dst", "relation").distinct()


def checked_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with label, properties and id required, and their level."""
    need = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"node without {c}"))).otherwise(F.col(c)) for c in ("node_id", "label", "name")}
    return nodes.withColumns(need).withColumn("level", level_of(F.col("label")))
