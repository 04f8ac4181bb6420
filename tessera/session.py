"""Spark session settings the library is tuned for, and the checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; an existing one is reused."""
    b = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the one that ``spark.checkpoint.dir`` names.

    Where that is unset, a local master gets a temporary folder; a cluster, whose executors
    wouldn't see it, gets an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut through the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
