"""Tables written to cut lineage, in the folder that driver and executors share; they go when the application ends."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which is deleted when the application ends.

    Where that is unset, a temporary folder of a local application; on a cluster that would not be shared, so it raises.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    key = f"{context.applicationId} {base}"
    if key not in _FOLDERS:
        if not base:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = os.path.join(tempfile.gettempdir(), f"checkpoint-{uuid.uuid4().hex}")
            context.setCheckpointDir(base)
            key = f"{context.applicationId} {context.getCheckpointDir()}"
        path = f"{base}/{context.applicationId}"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(where)
        store.deleteOnExit(where)
        _FOLDERS[key] = path
    return _FOLDERS[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
