"""``python -m strandgraph build|groups|ask``: construction and questions from files, with pluggable hooks.

Models and encoders are named as ``module:attribute``; without one the offline
stand-ins are used.
"""

from __future__ import annotations

import argparse
import importlib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph import construct, qa
from strandgraph.config import EngineConfig, load_config, parse_mode
from strandgraph.hooks import CannedModel, HashingEncoder, encode
from strandgraph.operators import retrieval
from strandgraph.sources import tables


def _hook(name: str | None, default: Any) -> Any:
    if not name:
        return default
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """The command line."""
    p = argparse.ArgumentParser(prog="strandgraph")
    p.add_argument("command", choices=["build", "groups", "ask"])
    p.add_argument("dataset")
    p.add_argument("--config")
    p.add_argument("--mode", default="", help="for example reflect-3_all-experts")
    p.add_argument("--model")
    p.add_argument("--encoder")
    p.add_argument("--first", type=int, help="only the first questions")
    return p.parse_args(argv)


def searcher(spark: SparkSession, paths: dict[str, str], encoder: Any, config: EngineConfig) -> qa.Retrieve:
    """A retrieval over the tables of a dataset: ``(query_id, query)`` -> ``(query_id, context)``."""
    nodes = spark.read.parquet(paths["nodes"]).filter("level < 4").join(spark.read.parquet(paths["vectors"]), "node_id", "left")
    edges, groups, chunks = (spark.read.parquet(paths[k]) for k in ("edges", "groups", "chunks"))
    edges = edges.filter("relation <> 'contains'")  # groups are searched as such
    vectors = encode(chunks.select(F.col("chunk_id").alias("id"), F.col("chunk_text").alias("text")), encoder).withColumnRenamed("id", "chunk_id")

    def search(queries: DataFrame) -> DataFrame:
        q = encode(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text")), encoder).select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"))
        records, _ = retrieval.retrieve(q, nodes, edges, groups, config.retrieval.top_k, config.retrieval.max_experts, encoder)
        fused = retrieval.fuse(q, records, vectors, config.retrieval.top_k, config.retrieval.strict)
        return retrieval.context(fused, retrieval.fuse_triples(records, config.retrieval.top_k), chunks)

    return search


def main(argv: list[str] | None = None) -> None:
    """Run one command."""
    args = arguments(argv)
    config = (load_config(args.config) if args.config else EngineConfig()).override(parse_mode(args.mode))
    spark = SparkSession.builder.appName("strandgraph").getOrCreate()
    log = tables.setup_logging()
    paths, files = config.paths(args.dataset), config.dataset(args.dataset)
    model, encoder = _hook(args.model, CannedModel()), _hook(args.encoder, HashingEncoder())
    if args.command == "build":
        out = construct.from_corpus(tables.read_corpus(spark, files.corpus), args.dataset, model, encoder, config, paths["checkpoint"])
        for name, df in out.items():
            df.write.mode("overwrite").parquet(paths[name])
            log.info("%s: %d rows", name, df.count())
    elif args.command == "groups":
        frames = {k: spark.read.parquet(paths[k]) for k in ("nodes", "edges", "vectors")}
        graph_nodes = frames["nodes"].filter("level < 4")
        graph_edges = frames["edges"].filter("relation <> 'contains'")
        construct.build_groups(graph_nodes, graph_edges, frames["vectors"], config.grouping).write.mode("overwrite").parquet(paths["groups"])
        index = f"{paths['groups']}_index"
        tables.clear_vectors(spark, index, hubs_only=True)
        tables.write_group_index(spark.read.parquet(paths["groups"]), frames["vectors"], index)
    else:
        questions = tables.read_questions(spark, files.questions, args.dataset, args.first)
        if tables.exists(spark, paths["results"]):
            questions = questions.join(tables.read_results(spark, paths["results"]).select("question_id"), "question_id", "left_anti")
        search = searcher(spark, paths, encoder, config)
        if config.retrieval.decompose:
            got = qa.answered(qa.answer_steps(qa.decompose(questions.select("question_id", "question"), model), search, model))
        else:
            got = qa.reflect(questions, search, model, config.retrieval.reflection_steps)
        both = questions.withColumnRenamed("answer", "gold").join(got.drop("reply"), "question_id")
        judged = qa.judge(both, _hook(args.model, None))
        tables.append_results(judged.select("question_id", "question", F.col("gold").alias("ground_truth"), F.col("answer").alias("generated_answer"), "correct", "steps"), paths["results"])


if __name__ == "__main__":
    main()
