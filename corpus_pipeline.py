"""Training corpus from the documents table: stages that each keep, drop or pack documents.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  All but the last return the columns of documents.

Edge cases, for every stage: an empty table gives an empty result; other columns, whatever their names, are passed through by
all stages but the last, which ignores them; repeated rows get equal verdicts.  A null text counts as empty, and empty texts
are scored by the classifier, rejected by the rules, equal to each other for near dedup and one end id for packing.  Rows
without an id are never removed as near copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curata.llm import fertility, near_texts, packing, quality
from curata.llm.shared import written
from curata.shipping import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pairwise ranking (operator 10): documents below the accepted score go; without labels of both classes none goes."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizer fertility (operator 4): documents that the base rules or the bands reject go; the bands are measured on the stage's own input."""
    ship(spark)
    return fertility.keep_fertile(docs, public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (operator 8) on five-word shingles, its links verified, and those beyond its bits by prefixes: of each group of similarity 0.8 or more the least id stays, and one row of it."""
    ship(spark)
    return near_texts.keep_one(docs, size=5, similarity=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Differencing (operator 9): one row per piece of a sequence; documents of equal id are packed like any others."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules), ("near dedup", near_dedup), ("packing", pack_sequences)]

#: Learned scores, tokenizers and packing can't be written in DuckDB SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
