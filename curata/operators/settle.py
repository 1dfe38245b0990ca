"""Cuts the lineage of a DataFrame by a checkpoint in the folder that the cluster names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in spark.checkpoint.dir; where that is unset, as in tests, in a temporary folder of a local application."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(base or os.path.join(tempfile.gettempdir(), f"checkpoint-{uuid.uuid4().hex}"))
    return df.checkpoint()
