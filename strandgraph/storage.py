"""Lineage cuts that survive lost executors.

Intermediate tables go to the shared folder that the session names in
``spark.checkpoint.dir``.  Only where that is unset and all work is done on one
machine (tests) does the module choose a folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Files of a compact table for each core at most.
FILES = 4
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="strandgraph-")
    return _own[app]


class Scratch:
    """Tables written by one operator run; ``drop`` and ``keep_only`` remove those no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/strandgraph/{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self.n = 0

    def write(self, df: DataFrame, compact: bool = False) -> DataFrame:
        """Write ``df`` as Parquet and return a reader of it, with flat lineage.

        With ``compact``, for what comes from a shuffle and is small beside the
        corpus, a task writes several of its partitions, one after the other, so
        that there are ``FILES`` files a core at most instead of one a partition.
        """
        path = f"{self.base}/{self.n}"
        self.n += 1
        schema = df.schema
        if compact:
            df = df.coalesce(FILES * self.spark.sparkContext.defaultParallelism)
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.tables.append((out, path))
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished writes now; it does so when their plans are collected as garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that ``write`` returned."""
        self._delete([t for t in self.tables if any(t[0] is d for d in dfs)])

    def keep_only(self, *dfs: DataFrame) -> None:
        """Delete all tables but these."""
        self._delete([t for t in self.tables if not any(t[0] is d for d in dfs)])

    def _delete(self, tables: list[tuple[DataFrame, str]]) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(t[1])
            jpath.getFileSystem(conf).delete(jpath, True)
            self.tables.remove(t)
