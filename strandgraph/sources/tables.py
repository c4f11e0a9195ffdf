"""Readers and writers; every path is opened by Spark, so any store that Spark knows will do."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions.text import nodes_hash
from strandgraph.operators.content import parse_chunk_lines, read_relationships, relationships, upsert
from strandgraph.operators.memberships import kind_of

log = logging.getLogger("strandgraph")
_DOC = "title string, text string"
_QA = "question string, answer string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path with all below it."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def is_fresh(spark: SparkSession, source: str, cache: str) -> bool:
    """Whether a cache is there, holds something and is not older than its source."""
    fs, p = _fs(spark, cache)
    if not fs.exists(p) or not fs.getContentSummary(p).getLength():
        return False
    sfs, s = _fs(spark, source)
    return sfs.exists(s) and sfs.getFileStatus(s).getModificationTime() <= fs.getFileStatus(p).getModificationTime()


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, title, text)`` of documents in JSON lines (``.jsonl``, read in parallel, ids from content) or one JSON list (numbered).

    Records that cannot be read have null fields.
    """
    if path.rstrip("/").endswith(".jsonl"):
        docs = spark.read.schema(_DOC).json(path, mode="PERMISSIVE")
        return docs.select(F.xxhash64("title", "text").alias("doc_id"), "title", "text")
    docs = spark.read.schema(_DOC).json(path, multiLine=True, mode="PERMISSIVE")
    return docs.withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "title", "text")


def read_questions(spark: SparkSession, path: str, dataset: str, first: int | None = None) -> DataFrame:
    """``(question_id, pos, question, answer)`` of a JSON list; the first ``first`` ones if given."""
    rows = spark.read.schema(_QA).json(path, multiLine=True).withColumn("pos", F.monotonically_increasing_id())
    rows = rows.withColumn("question_id", F.concat_ws("_", F.lit(dataset), "pos"))
    return (rows.orderBy("pos").limit(first) if first is not None else rows).select("question_id", "pos", "question", "answer")


def read_chunk_file(spark: SparkSession, path: str) -> DataFrame:
    """``(chunk_id, chunk_text)`` of a line file ``id: X<tab>Chunk: Y``."""
    return parse_chunk_lines(spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()))


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON-lines file of relationships."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    return read_relationships(lines)


def read_ontology(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """``Nodes``, ``Relations`` and ``Attributes`` of an ontology file; empty if there is none."""
    if not exists(spark, path):
        return {}
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    found = json.loads(text)
    return {k: list(found.get(k) or []) for k in ("Nodes", "Relations", "Attributes")}


def merge_ontology(old: dict[str, list[str]], new: dict[str, list[str]]) -> dict[str, list[str]]:
    """Both, each type once, old ones first."""
    return {k: list(dict.fromkeys([*old.get(k, []), *new.get(k, [])])) for k in ("Nodes", "Relations", "Attributes")}


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored result rows; blank and broken lines and summaries are skipped."""
    schema = "type string, question_id string, question string, ground_truth string, generated_answer string, correct int, processing_time double"
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").filter("question_id is not null and coalesce(type, '') <> 'summary'")


def latest(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The newest path in a folder whose name begins with ``prefix``."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return None
    found = [s for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)]
    return max(found, key=lambda s: (s.getModificationTime(), s.getPath().getName())).getPath().toString() if found else None


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, as_json: bool = False) -> None:
    """A graph as tables, or as JSON lines of relationships (nodes without an edge are not in those)."""
    if as_json:
        relationships(nodes, edges).write.mode("overwrite").json(f"{path}/relationships")
        return
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A graph's tables; FileNotFoundError if they are not there."""
    if not exists(spark, f"{path}/nodes"):
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def graph_metadata(nodes: DataFrame, edges: DataFrame, seconds: float) -> DataFrame:
    """One row: counts, seconds and nodes per level."""
    levels = nodes.groupBy("level").count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "count")))).alias("levels"))
    return nodes.agg(F.count("*").alias("total_nodes")).crossJoin(edges.agg(F.count("*").alias("total_edges"))).crossJoin(levels).withColumn("seconds", F.lit(float(seconds)))


def write_chunks(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """Chunks stored at ``path`` with new ones added or replaced; written beside the old version, which is then left for readers."""
    version = 0
    if (old := latest(spark, path, "v")) is not None:
        version = int(old.rpartition("/v")[2]) + 1
        new = upsert(spark.read.parquet(old).select("chunk_id", "chunk_text"), new.select("chunk_id", "chunk_text"), "chunk_id")
    new.write.mode("overwrite").parquet(f"{path}/v{version}")
    return spark.read.parquet(f"{path}/v{version}")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors by id."""
    vectors.write.mode("overwrite").parquet(path)


def group_keys(groups: DataFrame) -> DataFrame:
    """``(subgraph_id, key)``: the content key under which a group's index is valid."""
    return groups.groupBy("subgraph_id").agg(nodes_hash(F.collect_list("node_id")).alias("key"))


def write_group_index(groups: DataFrame, vectors: DataFrame, path: str) -> None:
    """Each group's vectors, a folder per group, with the group's content key."""
    rows = groups.select("subgraph_id", "node_id").join(vectors, "node_id").join(group_keys(groups), "subgraph_id")
    rows.write.mode("overwrite").partitionBy("subgraph_id").parquet(path)


def read_group_index(spark: SparkSession, groups: DataFrame, path: str) -> DataFrame:
    """Index rows of groups whose content has not changed."""
    return spark.read.parquet(path).join(group_keys(groups), ["subgraph_id", "key"])


def append_results(results: DataFrame, path: str) -> None:
    """Add result rows as JSON lines."""
    results.write.mode("append").json(path)


def keep_latest_batches(spark: SparkSession, path: str, n: int = 5) -> None:
    """Delete all but the latest ``n`` checkpoint batches."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return
    found = sorted((int(s.getPath().getName()[6:]), s.getPath()) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch="))
    for _, old in found[:-n]:
        fs.delete(old, True)


def clear_vectors(spark: SparkSession, path: str, hubs_only: bool = False) -> None:
    """Forget cached vectors of a dataset, or of a group index only those of the hubs."""
    if not hubs_only:
        delete(spark, path)
        return
    fs, p = _fs(spark, path)
    for s in fs.listStatus(p) if fs.exists(p) else []:
        if s.getPath().getName().startswith("subgraph_id=Shared_"):
            fs.delete(s.getPath(), True)


_MIXTURE = "metadata struct<total_nodes:bigint,total_edges:bigint,dataset_name:string,node_type_statistics:map<string,bigint>>, mixture_of_graph struct<algorithm_type:string,subGraphs:map<string,struct<member_nodes:array<string>,description:string,node_id:string>>,node_memberships:map<string,array<string>>>"


def write_mixture(groups: DataFrame, path: str) -> None:
    """The interchange form of memberships: one JSON object, so for graphs that fit in one value."""
    per = groups.groupBy("subgraph_id").agg(F.sort_array(F.collect_set("node_id")).alias("member_nodes"))
    one = per.agg(F.map_from_entries(F.collect_list(F.struct("subgraph_id", F.struct("member_nodes", F.col("subgraph_id").alias("node_id"))))).alias("subGraphs"))
    one.select(F.to_json(F.struct(F.struct("subGraphs").alias("mixture_of_graph")))).write.mode("overwrite").text(path)


def read_mixture(spark: SparkSession, path: str) -> DataFrame:
    """``(subgraph_id, kind, node_id)`` of the ``mixture_of_graph`` part of a graph's JSON; none where there is no such part."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", _MIXTURE).alias("g"))
    rows = doc.select(F.explode("g.mixture_of_graph.subGraphs").alias("subgraph_id", "s"))
    return rows.select("subgraph_id", kind_of(F.col("subgraph_id")).alias("kind"), F.explode("s.member_nodes").alias("node_id"))


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The ``metadata`` part of a graph's JSON, empty if there is none."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", _MIXTURE)["metadata"].alias("m")).first()
    return row["m"].asDict() if row and row["m"] else {}


def setup_logging(level: str = "INFO") -> logging.Logger:
    """The engine's logger, once."""
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
    return log
