"""Where jobs keep tables of their own: a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session names for checkpoints; a temporary one only where all runs on this machine."""
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir()
    base = named.get() if named.isDefined() else context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        base = tempfile.mkdtemp(prefix="turnlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
