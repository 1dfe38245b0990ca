"""Sinks: staged Parquet by split, registers, sidecars, manifest."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.sources.readers import exists


def stage(df: DataFrame, path: str) -> None:
    """Parquet by split; only the splits in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)


def stage_config(df: DataFrame, root: str, config: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> None:
    """Parquet of one config of a staged tree: root/data/config/split, a folder per split; rows of other splits are not written."""
    for split in splits:
        df.where(F.col("split") == split).write.mode("overwrite").parquet(f"{root}/data/{config}/{split}")


def stage_tree(spark: SparkSession, docs: DataFrame, root: str, windows: DataFrame | None = None) -> dict[str, dict[str, int]]:
    """Documents of all splits and windows of train and validation; without windows those of an earlier build go.  The tree's rows by config and split."""
    stage_config(docs, root, "documents")
    if windows is None:
        remove(spark, f"{root}/data/windows")
    else:
        stage_config(windows, root, "windows", ("train", "validation"))
    return stage_counts(spark, root)


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a folder in whatever store it is; whether it was there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage_counts(spark: SparkSession, root: str) -> dict[str, dict[str, int]]:
    """Rows by config and split of the tree as it is, all shards counted from their footers."""
    out: dict[str, dict[str, int]] = {}
    for config, splits in (("documents", ("train", "validation", "test")), ("windows", ("train", "validation"))):
        for split in splits:
            if exists(spark, f"{root}/data/{config}/{split}"):
                out.setdefault(config, {})[split] = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data/{config}/{split}").count()
    return out


def dataset_info(spark: SparkSession, root: str) -> dict:
    """The card of a staged tree: per config its columns with their types, and its rows by split."""
    out = {}
    for config, splits in stage_counts(spark, root).items():
        schema = spark.read.parquet(f"{root}/data/{config}/{next(iter(splits))}").schema
        out[config] = {"features": {f.name: {"dtype": f.dataType.simpleString()} for f in schema.fields}, "splits": {s: {"name": s, "num_examples": n} for s, n in splits.items()}}
    return out


def replace_shards(spark: SparkSession, df: DataFrame, root: str, config: str, name: str = "enrichment") -> None:
    """Enrichment rows beside the canonical train rows, instead of those of an earlier run."""
    df.write.mode("overwrite").parquet(f"{root}/data/{config}/train/{name}")


def write_audit(df: DataFrame, path: str) -> None:
    """Audit records as JSON lines, in order."""
    df.orderBy(*[c for c in ("pool", "filename", "reason") if c in df.columns]).write.mode("overwrite").json(path)


def register(rejects: DataFrame, path: str, pool: str) -> None:
    """Reject register: (filename, reason, detail, pool), appended."""
    detail = F.col("detail") if "detail" in rejects.columns else F.lit("")
    rejects.select("filename", "reason", detail.alias("detail"), F.lit(pool).alias("pool")).write.mode("append").parquet(path)


def read_register(df: DataFrame) -> DataFrame:
    """The register in order."""
    return df.orderBy("pool", "filename", "reason")


def write_text(path: str, text: str) -> None:
    """A small local file, written whole or not at all."""
    with open(f"{path}.tmp", "w") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)


def write_sidecar(path: str, value: dict) -> None:
    write_text(path, json.dumps(value, indent=2, sort_keys=True) + "\n")


def read_sidecar(path: str) -> dict | None:
    """A sidecar; an absent or unreadable one is None."""
    try:
        with open(path) as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def manifest(df: DataFrame, revision: str) -> dict:
    """Build facts: schema, rows by split and class, and their hash; no times, so rebuilds are equal."""
    counts = [r.asDict() for r in df.groupBy("split", "doc_type").agg(F.count("*").alias("n")).orderBy("split", "doc_type").collect()]
    facts = {"revision": revision, "schema": {f.name: f.dataType.simpleString() for f in df.schema.fields}, "counts": counts}
    return facts | {"sha256": hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()}
