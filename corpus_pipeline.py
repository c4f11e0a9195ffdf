"""From raw documents to packed training sequences, stage by stage.

Documents are long, so batches of rows that go to Python are kept to ``BATCH``
rows where the session has no other setting: both sides hold a few batches for
each running task.

Defined results, as each stage's operator states them: rows with a null or empty
text are scored like any other, fail the base rules, are untouched by line
dedup, are copies of each other, and pack as one end token; rows that repeat an
id and text are judged alike, and near dedup keeps one of them; rows with a null
id stay in near dedup; other columns, whatever their names, pass through all
stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandgraph.llm import linededup, nearcopies, packing, rules, toxicity
from strandgraph.storage import Scratch


#: Rows of a batch for Python, and the setting's own default.
BATCH, DEFAULT = "2000", "10000"
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are anomalous go."""
    return rules.keep_good(docs, _labels(spark, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts."""
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts alike in 0.8 or more of their five-word shingles stays."""
    return nearcopies.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _short_batches(stage: Callable) -> Callable:
    """The stage, with batches of ``BATCH`` rows unless the session says otherwise."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_SETTING, DEFAULT) == DEFAULT:
            spark.conf.set(_SETTING, BATCH)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _short_batches(drop_toxic)),
    ("quality rules", _short_batches(drop_low_quality)),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", _short_batches(drop_near_duplicates)),
    ("best-fit packing", _short_batches(pack)),
]

#: Learned scores and tokenization are beyond SQL; tests compare near dedup, packing and the rules' verdicts with brute force
#: and the toxicity scores with labels held out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
