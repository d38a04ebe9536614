"""Session settings, the shared folder, and intermediate tables that several branches read."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_RUNTIME_SETTINGS = {
    # Day arithmetic and month truncation are defined on UTC instants.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # held tables have as many partitions as their bytes need: each job over them sends a result per partition
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_held: list[DataFrame] = []
_written: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on.

    Python workers look for this package where the driver found it, whatever folder they start in.
    """
    for key, value in _RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return spark


def build_session(app: str = "holdfast", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**_RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hold(df: DataFrame) -> DataFrame:
    """Persist a table that more than one branch of a plan reads.

    Blocks of a lost executor are rebuilt from the lineage; a range layout keeps its boundaries in
    the shuffle dependency, so rebuilt partitions hold the same rows. `release()` frees everything.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(df)
    return df


def release() -> None:
    while _held:
        _held.pop().unpersist()


def release_of(df: DataFrame) -> None:
    """Free one held table."""
    _held[:] = [held for held in _held if held is not df]
    df.unpersist()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by spark.checkpoint.dir.

    A private folder is made only in local mode, when the session names none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="holdfast-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/holdfast/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back: a restart point for training loops."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


def clear_written(spark: SparkSession) -> int:
    """Delete the tables that `cut_lineage` has written since the last call; returns how many.

    Call it when the results that were built from them are written: plans that read them no longer run.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = 0
    while _written:
        path = folder(_written.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows as a local relation (no Python workers at run time)."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), schema)
