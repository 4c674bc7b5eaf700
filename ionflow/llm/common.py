"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SLICE_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors; only where none is set and the master is local (tests), a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ionflow-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/ionflow-{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str, held: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors.

    The table's path is added to ``held``, for ``drop_all`` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_all(spark: SparkSession, held: list[str]) -> None:
    """Delete the scratch tables of ``held``."""
    while held:
        drop_path(spark, held.pop())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop, whatever store holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``; Catalyst can't inline it again into a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``limit`` bytes, one row at least."""
    sizes = np.cumsum(np.nan_to_num(np.array(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), np.int64)))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield at, end
        at = end


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which gives back what Arrow holds free when a task ends: Spark keeps the worker, beside those of later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task


def whole_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """(vec_id long, x array<long>, *more): the rows whose vector has only finite entries, each entry c as floor(scale * c).

    Rows of a null vector or with a null or non-finite entry go, and so do those with an entry whose
    product is beyond 2^62, since it is no long. Vectors of a space have one length: where a table
    mixes lengths, that of most rows counts (of equals the larger) and rows of other lengths go.
    """
    entries = F.col(vector_col).cast("array<double>")
    good = F.col(vector_col).isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < float(1 << 62)))
    rows = df.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(entries, lambda c: F.floor(c * scale)).alias("x"), *more)
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["size"] if lengths else 0))


def rows_of(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))
