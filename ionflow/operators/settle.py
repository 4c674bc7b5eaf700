"""Cutting lineage where a derived table is used several times, or where each round builds on the last."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder that driver and executors share, if the session names one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    return root.rstrip("/") if root else None


def settle(df: DataFrame) -> DataFrame:
    """Compute once: written to the shared checkpoint folder where the session names one, else kept by the executors (and recomputed if lost)."""
    return df.checkpoint() if shared_folder(df.sparkSession) else df.persist()


def cut(df: DataFrame) -> DataFrame:
    """A written table of ``df``, for rounds that join the last round's result: ``drop`` removes it.

    A checkpoint keeps Spark's guess of its size, and guesses multiply at every join, so after some
    ten rounds they are numbers that no memory holds; a table has the size of its files. Without a
    shared folder only local masters are served, in a temporary one.
    """
    spark = df.sparkSession
    root = shared_folder(spark)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ionflow-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root}/ionflow-round-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def written(df: DataFrame) -> DataFrame:
    """``cut``, whose files take less room than checkpoints, where the session has a place for it; else kept by the executors."""
    return cut(df) if shared_folder(df.sparkSession) or df.sparkSession.sparkContext.master.startswith("local") else df.persist()


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` has written."""
    for df in tables:
        path = getattr(df, "written_to", None)
        if path:
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
