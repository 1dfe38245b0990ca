"""The driver's tables as the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.shipping import ship

#: Corpus of the queries in SQL: language as class, source as subclass, split by keyed hash of the file name.
CORPUS_SQL = """corpus AS (
  SELECT doc_id, 'doc_' || doc_id AS filename, lang AS doc_type, source AS subclass, text AS doc_text,
         sha256(text) AS content_sha256, split_part(text, chr(10), 1) AS title,
         CASE WHEN substr(sha256('42:doc_' || doc_id), 1, 1) IN ('0', '1') THEN 'test'
              WHEN substr(sha256('42:doc_' || doc_id), 1, 1) IN ('2', '3') THEN 'validation' ELSE 'train' END AS split
  FROM documents)"""

#: Scores: a prediction and a confidence per line item, and window logits of the embeddings.
CONF_SQL = "conf AS (SELECT l_quantity / 50.0::DOUBLE AS conf, (l_partkey % 100) < l_quantity * 2 AS correct FROM lineitem)"

LOGITS_SQL = """logits AS (
  SELECT vec_id, vec_id // 4 AS document, (vec_id % 4)::INT AS window_index, label,
         list_transform(embedding, lambda x: x::DOUBLE) AS logits FROM embeddings)"""

PREDICTIONS_SQL = """predictions AS (
  SELECT 'doc_' || doc_id AS filename, lang AS gt_doc_type, source AS gt_subclass,
         CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS pred_doc_type,
         CASE WHEN doc_id % 5 = 0 THEN 'src1' ELSE source END AS pred_subclass,
         1 + (n_chars // 2000)::INT AS n_windows, ((doc_id * 37) % 101) / 100.0::DOUBLE AS agreement
  FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id"))
    digit = F.substring(F.sha2(F.concat(F.lit("42:"), name), 256), 1, 1)
    split = F.when(digit.isin("0", "1"), "test").when(digit.isin("2", "3"), "validation").otherwise("train")
    return docs.select("doc_id", name.alias("filename"), F.col("lang").alias("doc_type"), F.col("source").alias("subclass"), F.col("text").alias("doc_text"), F.sha2("text", 256).alias("content_sha256"), F.substring_index("text", "\n", 1).alias("title"), split.alias("split"))


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50.0).alias("conf"), ((F.col("l_partkey") % 100) < F.col("l_quantity") * 2).alias("correct"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", F.floor(F.col("vec_id") / 4).alias("document"), (F.col("vec_id") % 4).cast("int").alias("window_index"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    said = F.when(i % 11 == 0, None).when(i % 7 == 0, "en").otherwise(F.col("lang"))
    sub = F.when(i % 5 == 0, "src1").otherwise(F.col("source"))
    return docs.select(F.concat(F.lit("doc_"), i).alias("filename"), F.col("lang").alias("gt_doc_type"), F.col("source").alias("gt_subclass"), said.alias("pred_doc_type"), sub.alias("pred_subclass"), (F.floor(F.col("n_chars") / 2000) + 1).cast("int").alias("n_windows"), ((i * 37) % 101 / 100.0).alias("agreement"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    return rows.withColumn("dt_correct", F.col("gt_doc_type").eqNullSafe(F.col("pred_doc_type"))).withColumn("sc_correct", F.col("gt_subclass") == F.col("pred_subclass"))


JUDGED_SQL = PREDICTIONS_SQL + """, judged AS (
  SELECT *, coalesce(gt_doc_type = pred_doc_type, false) AS dt_correct, gt_subclass = pred_subclass AS sc_correct FROM predictions)"""
