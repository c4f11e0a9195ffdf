"""Incremental construction with Structured Streaming: micro-batches, idempotent merges, resumption from the checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.storage import scratch_dir


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Take all that is there in micro-batches and stop; a batch that was done is not done again after a restart."""
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _is_folder(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()


def micro_batch_counts(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """``(event_type, n, users)`` of an event table that is taken file by file.

    Each batch writes its rows' keys under its batch number, so a repeated batch
    overwrites itself; the totals are read from all batches.  ``path`` is one
    file or a folder of part files.
    """
    base = f"{scratch_dir(spark)}/strandgraph/{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if _is_folder(spark, path):
        stream = stream.parquet(path)
    else:
        folder, _, name = path.rpartition("/")
        stream = stream.option("pathGlobFilter", name).parquet(folder or ".")

    def step(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type", "user_id").count().write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run_batches(stream, step, f"{base}/checkpoint")
    rows = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    return rows.groupBy("event_type").agg(F.sum("count").alias("n"), F.countDistinct("user_id").alias("users"))


def merge_batch(spark: SparkSession, edges: DataFrame, number: int, path: str) -> None:
    """Write one batch's edges under its number; replays overwrite, ids come from content, so nothing collides."""
    edges.write.mode("overwrite").parquet(f"{path}/batch={number}")


def graph_of(spark: SparkSession, path: str) -> DataFrame:
    """The distinct edges of all batches."""
    return spark.read.option("basePath", path).parquet(path).select("src", "dst", "relation").distinct()


def progress(batches: int, done: list[int], size: int) -> dict:
    """How far a batched run is."""
    return {"total_batches": batches, "completed_batches": sorted(set(done)), "batch_size": size, "status": "done" if len(set(done)) >= batches else "running"}
