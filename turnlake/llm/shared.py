"""Storing intermediate tables where every executor can read them."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

#: Seconds after which ``stored`` lets go of what earlier tables have left, and when it last did.
LET_GO_S, _let_go = 10, [time.monotonic()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a temporary one only where all runs on this machine."""
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir()
    folder = named.get() if named.isDefined() else context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return tempfile.mkdtemp(prefix="turnlake-")


def stored(frame: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the shared folder.

    Spark drops shuffles, broadcasts and checkpoints that nothing refers to only when the driver collects its garbage,
    which it else does when its heap has grown to the limit; a long run of steps asks for it now and then.
    """
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    kept = frame.checkpoint(eager=True)
    if time.monotonic() - _let_go[0] >= LET_GO_S:
        gc.collect()
        context._jvm.System.gc()
        _let_go[0] = time.monotonic()
    return kept
