"""Corpus to graph, and graph to groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.config import EngineConfig, Grouping
from strandgraph.functions.text import parse_record
from strandgraph.hooks import Encoder, Model, ask, encode, prompt
from strandgraph.operators import experts, extract, hubs, memberships
from strandgraph.operators.content import embeddable, entity_content
from strandgraph.sources.tables import exists, log
from strandgraph.storage import Scratch
from strandgraph.streaming.incremental import progress


def extract_records(chunks: DataFrame, model: Model, template: str = "{schema}\n{chunk}", ontology: str = "") -> DataFrame:
    """``chunks(chunk_id, chunk_text)`` -> extraction records; chunks without a readable reply have empty ones.

    Replies are written once, so no prompt is sent again by a later step.
    """
    asked = chunks.select(F.col("chunk_id").alias("id"), prompt(template, schema=F.lit(ontology), chunk=F.col("chunk_text")).alias("prompt"))
    replies = Scratch(chunks.sparkSession).write(ask(asked, model))
    return replies.select(F.col("id").alias("chunk_id"), parse_record(F.col("reply")).alias("r")).select("chunk_id", "r.*")


def batched_records(chunks: DataFrame, model: Model, template: str, checkpoint: str, size: int) -> DataFrame:
    """Extraction records of all chunks, about ``size`` chunks a batch; a batch is written under its number and only extracted where that is missing."""
    spark = chunks.sparkSession
    batches = max(1, math.ceil(chunks.count() / size))
    placed = chunks.withColumn("batch", F.pmod(F.xxhash64("chunk_id"), F.lit(batches)))
    done = []
    for b in range(batches):
        path = f"{checkpoint}/of={batches}/batch={b}"
        if not exists(spark, f"{path}/_SUCCESS"):
            extract_records(placed.filter(F.col("batch") == b).drop("batch"), model, template).write.mode("overwrite").parquet(path)
        done.append(b)
        log.info("extraction: %s", progress(batches, done, size))
    return spark.read.parquet(*[f"{checkpoint}/of={batches}/batch={b}" for b in range(batches)])


def build_graph(records: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records -> merged ``nodes`` and ``edges``.

    Entities are one per (name, chunk) while triples are read, and merged by
    name over all chunks; order is that of chunk ids and places in a record.
    """
    mentions = extract.mention_nodes(records)
    order = F.struct("chunk_id", "label", "name")
    first = mentions.groupBy("name").agg(F.min_by(F.struct("label", "level", "chunk_id", "schema_type"), order).alias("m"), F.min(order).alias("seq"))
    named = extract.number(first.select("name", "m.*", "seq"), "label", "seq", "num")
    nodes = named.withColumn("node_id", F.concat_ws("_", "label", "num")).drop("num", "seq")
    said = extract.mention_edges(records).withColumn("seq", F.struct("chunk_id", "relation", "src", "dst"))
    edges = extract.merge_edges(extract.dedup_edges(said, ["chunk_id", "src", "dst"]), compat)
    ids = nodes.select("name", "node_id")
    out = edges.join(ids.select(F.col("name").alias("src"), F.col("node_id").alias("a")), "src").join(ids.select(F.col("name").alias("dst"), F.col("node_id").alias("b")), "dst")
    keep = [c for c in edges.columns if c not in ("src", "dst", "ekey")]
    out = out.select(F.col("a").alias("src"), F.col("b").alias("dst"), *keep)
    return nodes, extract.dedup_edges(out.withColumn("seq", F.col("relation"))).drop("seq")


def embed_entities(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """``(node_id, embedding)`` of entities with content."""
    content = entity_content(nodes, edges, chunks).join(nodes.select("node_id", "label"), "node_id")
    ready = content.join(embeddable(content), "node_id", "left_semi")
    return encode(ready.select(F.col("node_id").alias("id"), F.col("content").alias("text")), encoder).withColumnRenamed("id", "node_id")


def build_groups(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, settings: Grouping = Grouping()) -> DataFrame:
    """Hubs, experts and the unassigned rest of the entities: ``(subgraph_id, kind, node_id)``."""
    entities = nodes.filter("level = 2").select("node_id").join(vectors, "node_id", "left")
    inner = edges.join(entities.select(F.col("node_id").alias("src")), "src", "left_semi").join(entities.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    semantic = hubs.semantic_hub(entities, settings.hub_percentile)
    structural = hubs.structural_hub(entities, inner, hubs.StructuralMix[settings.structural_mix], settings.hub_percentile)
    scratch = Scratch(nodes.sparkSession)
    known = scratch.write(entities.filter("embedding is not null").select("node_id", "embedding"))  # read again in every round
    seeds = experts.seed_centroids(known, settings.clusters)
    found = known.select(F.lit("").alias("subgraph_id"), "node_id").limit(0)
    if len(seeds):
        u = experts.memberships(known, experts.fuzzy_c_means(known, seeds, settings.fuzziness, settings.rounds), settings.fuzziness)
        found = experts.build_experts(u, experts.adaptive_threshold(u), settings.least_members)
    return memberships.all_groups(semantic, structural, found, entities)


def from_corpus(docs: DataFrame, dataset: str, model: Model, encoder: Encoder, config: EngineConfig = EngineConfig(), checkpoint: str | None = None) -> dict[str, DataFrame]:
    """``docs(doc_id, title, text)`` -> chunks, nodes, edges, vectors and groups, each written once.

    With ``batched`` set, records are extracted batch by batch under
    ``checkpoint``, and batches that are there are not extracted again.  Groups
    are also nodes of the graph, with ``contains`` edges to their members.
    """
    scratch = Scratch(docs.sparkSession)
    chunks = scratch.write(extract.chunk(docs, dataset in config.construction.whole_documents, config.construction.first_line_only))
    template = config.prompts.get("construction", "{schema}\n{chunk}")
    records = batched_records(chunks, model, template, checkpoint, config.construction.batch_size) if config.construction.batched and checkpoint else extract_records(chunks, model, template)
    nodes, edges = build_graph(records)
    nodes, edges = scratch.write(nodes), scratch.write(edges)
    vectors = scratch.write(embed_entities(nodes, edges, chunks, encoder))
    groups = scratch.write(build_groups(nodes, edges, vectors, config.grouping))
    supers = memberships.super_nodes(groups)
    return {"chunks": chunks, "nodes": nodes.unionByName(supers, allowMissingColumns=True), "edges": edges.unionByName(memberships.contains_edges(groups).withColumn("ekey", F.lit(0)).select(*edges.columns)), "vectors": vectors, "groups": groups}
