"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curata.llm import byte_bpe, fertility, html_text, iblt, katz, packing, quality, simhash, token_counts, url_filter
from curata.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.fewer_tasks(_table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op4_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.measure(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


#: Rules of the url query.
URL_RULES = [url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("allow", "net", "/de/"), url_filter.Rule("block", "example.net", "/de/8"), url_filter.Rule("block", "org", "/es/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_edited(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3)


def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_katz_scores, op3_token_counts, op4_fertility_rules, op5_url_filter, op6_tag_path_text, op7_iblt_fingerprints, op8_simhash_near_dedup, op9_differencing_packing, op10_pairwise_quality)}

#: None of these can be written in DuckDB SQL at whole-table size (tokenizers, models, sketches).
ORACLE_SQL: dict[str, str] = {}
