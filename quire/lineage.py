"""Cutting lineage: reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder that was set on the context.

    Where neither is set, a temporary folder serves a Spark that runs in one
    machine (``local``); on a cluster executors would not share it, so that is
    an error.
    """
    context = spark.sparkContext
    already = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (already.get() if already.isDefined() else None)
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = context.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quire-shared-")
        folder = _own[app]
    if not already.isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Actions inside the block delete their shuffle files when they end.

    Else those stay until the driver happens to collect its garbage, so the
    disk holds the shuffles of all steps at once.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; Spark deletes it when it is no longer used, if so configured."""
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own, so that none that ran needs the files again


def stored(df: DataFrame) -> DataFrame:
    """A :func:`checkpoint` of what was read from packages, of which no join sends a side through the driver.

    Spark takes the size of such a table from the plan before it, where all
    cells or blocks of a package count for one short text, and so would
    broadcast tables of many times its limit.
    """
    return checkpoint(df).hint("merge")
