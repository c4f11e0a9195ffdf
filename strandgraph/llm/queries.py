"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import bpe, chat, embedding, langid, linededup, ordinal, packing, rules, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(chat.events_of_turns(rows)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    out = linededup.dedup_lines(docs, runs_as="runs")
    gone = F.aggregate(F.coalesce("runs", F.array().cast("array<struct<b:int,e:int>>")), F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["b"] + 1)
    return out.select("doc_id", "n_lines", gone.alias("n_deleted"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", *rules.COUNTS, "base_failed", "kept", "score")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.grade(_table(spark, sf_dir, "documents"), ordinal.grades_of_labels(_table(spark, sf_dir, "labels")))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op5_linededup": _OP5}


#: Every run of lines is compared by its text, without ranks.
_OP5 = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents
), seq AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), cum AS (
  SELECT *, row_number() OVER o AS p, sum(w) OVER o AS after FROM seq WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), often AS (
  SELECT line FROM seq GROUP BY line HAVING count(*) > 1
), act AS (
  SELECT * FROM cum WHERE line IN (SELECT line FROM often)
), fwd AS (
  SELECT a.doc_id, a.p AS s, min(b.p) AS l FROM act a JOIN cum b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.after - a.after + a.w >= 50
  GROUP BY a.doc_id, a.p
), bwd AS (
  SELECT b.doc_id, max(a.p) AS s, b.p AS l FROM act b JOIN cum a ON a.doc_id = b.doc_id AND a.p <= b.p AND b.after - a.after + a.w >= 50
  GROUP BY b.doc_id, b.p
), win AS (SELECT * FROM fwd UNION SELECT * FROM bwd), said AS (
  SELECT win.doc_id, s, l, string_agg(line, chr(10) ORDER BY p) AS body
  FROM win JOIN cum ON cum.doc_id = win.doc_id AND p BETWEEN s AND l GROUP BY win.doc_id, s, l
), later AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS k FROM said
), gone AS (
  SELECT DISTINCT cum.doc_id, p FROM cum JOIN later ON cum.doc_id = later.doc_id AND p BETWEEN s AND l WHERE k > 1
), marks AS (
  SELECT raw.doc_id, raw.i, raw.line, CASE WHEN cum.p IS NOT NULL THEN gone.p IS NOT NULL END AS g
  FROM raw LEFT JOIN cum ON raw.doc_id = cum.doc_id AND raw.i = cum.i LEFT JOIN gone ON cum.doc_id = gone.doc_id AND cum.p = gone.p
), fin AS (
  SELECT doc_id, i, line, coalesce(g, last_value(g IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AND first_value(g IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS x
  FROM marks
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (x) AS n_deleted,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT x), '')) AS kept_sha256
FROM fin GROUP BY doc_id
"""
