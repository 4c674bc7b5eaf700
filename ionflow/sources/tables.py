"""Tables of Parquet folders: checked inserts, updates and deletes that rewrite the partitions they touch, cascades.

Every table is partitioned: by columns of its own, or by a hash of its key. A change finds the
partitions that it touches, computes their new rows and puts these in place by Spark's own dynamic
partition overwrite; files of other partitions stay as they are, and the table's folder is there at
every moment. Until the write is committed nothing of the old rows is gone, so a job that fails
leaves the table as it was. Partitions that a change empties are deleted after that; should this
step fail, the rows are still there and the change can be asked for again.

Files of a partition are sorted by the key and have Bloom filters of the key and of the columns in
``indexes``, so a lookup by one of them reads few row groups, and one by the whole key one partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionflow.operators.settle import settle
from ionflow.sources import layout

PART = "_part"


class Table:
    """A Parquet folder with a unique key."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partitions: list[str] | None = None, buckets: int = 16, indexes: list[str] | None = None):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.partitions, self.hashed = partitions or [PART], not partitions
        self.indexes = list(dict.fromkeys([*keys, *(indexes or [])]))

    def exists(self) -> bool:
        p = self._hadoop(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, columns: list[str] | None = None) -> DataFrame:
        df = self._rows()
        return df.select(*columns) if columns else df.drop(PART) if self.hashed else df

    def count(self, predicate: Column | None = None) -> int:
        """Without a predicate Spark answers from the files' footers."""
        df = self._rows()
        return (df if predicate is None else df.where(predicate)).count()

    def find(self, **values) -> DataFrame:
        """Rows with these values. With the whole key one partition is read, and of any indexed column the row groups that may hold it."""
        df = self._rows()
        for c, v in values.items():
            df = df.where(F.col(c).eqNullSafe(F.lit(v)) if v is None else F.col(c) == F.lit(v))
        if self.hashed and set(self.keys) <= set(values):
            types = dict(df.dtypes)
            key = self.spark.range(1).select(self._part(*[F.lit(values[k]).cast(types[k]) for k in self.keys]).alias("p")).first()["p"]
            df = df.where(F.col(PART) == key)
        return df.drop(PART) if self.hashed else df

    def insert(self, rows: DataFrame) -> None:
        """Append; keys must be new, unique and not null."""
        bad = rows.groupBy(*self.keys).count().where("count > 1").isEmpty()
        null = rows.where(" OR ".join(f"`{k}` IS NULL" for k in self.keys)).isEmpty()
        if not bad or not null:
            raise ValueError(f"keys {self.keys} are repeated or null")
        if self.exists() and not rows.join(self.read(self.keys), self.keys, "left_semi").isEmpty():
            raise ValueError(f"keys {self.keys} are there already")
        self._write(self._placed(rows), "append")

    def update(self, predicate: Column, values: dict[str, Column]) -> None:
        changed = lambda df: df.withColumns({c: F.when(predicate, v).otherwise(F.col(c)) for c, v in values.items()})
        self._rewrite(self._rows().where(predicate), changed, moves=bool({*self.keys, *self.partitions} & set(values)))

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of the same key and are added otherwise."""
        rows = settle(self._placed(rows))
        old = self._rows().join(rows.select(*self.keys), self.keys, "left_semi")
        touched = rows.select(*self.partitions) if self.hashed else old.select(*self.partitions).union(rows.select(*self.partitions))
        self._rewrite(touched, lambda df: df.join(rows.select(*self.keys), self.keys, "left_anti").unionByName(rows.select(*df.columns)))

    def patch(self, rows: DataFrame) -> None:
        """Non-null values of ``rows`` replace those of the same key; other keys are ignored."""
        rows = settle(rows)
        new = [c for c in rows.columns if c not in self.keys]
        patches = rows.select(*self.keys, *[F.col(c).alias(f"_{c}") for c in new])
        changed = lambda df: df.join(patches, self.keys, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])
        touched = self._placed(rows) if self.hashed else self._rows().join(patches, self.keys, "left_semi")
        self._rewrite(touched, changed, moves=bool(set(self.partitions) & set(new)))

    def delete(self, predicate: Column) -> None:
        gone = F.coalesce(predicate, F.lit(False))
        self._rewrite(self._rows().where(gone), lambda df: df.where(~gone))

    def delete_matching(self, keys: DataFrame, on: list[str]) -> None:
        """Rows whose ``on`` columns are among ``keys``: one step of a cascade."""
        listed = settle(keys.select(*on).distinct())
        near = layout.prune_hint(self.spark, listed, on)
        if near is not None:
            self._rewrite(self._rows().where(near).join(listed, on, "left_semi"), lambda df: df.join(listed, on, "left_anti"))

    # ------------------------------------------------------------------------------------------
    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _part(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(PART, self._part(*[F.col(k) for k in self.keys])) if self.hashed else rows

    def _write(self, rows: DataFrame, mode: str) -> None:
        # Rows of a partition come together, and a partition of many rows is split again by adaptive execution.
        dealt = rows.hint("rebalance", *[F.col(p) for p in self.partitions]).sortWithinPartitions(*self.partitions, *self.keys)
        writer = layout.with_blooms(dealt.write.mode(mode).partitionBy(*self.partitions), [c for c in self.indexes if c not in self.partitions], 100_000)
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)
        self.spark.catalog.refreshByPath(self.path)

    def _rewrite(self, touched: DataFrame, changed: Callable[[DataFrame], DataFrame], moves: bool = False) -> None:
        """Replace the rows of the partitions of ``touched`` by ``changed`` of them; with ``moves`` rows may land in other partitions, which are then rewritten too."""
        same = lambda a, b: [a[p].eqNullSafe(b[p]) for p in self.partitions]
        parts = settle(touched.select(*self.partitions).distinct())
        if moves:
            old = self._rows()
            landed = self._landed(changed(old.join(F.broadcast(parts), same(old, parts), "left_semi"))).select(*self.partitions)
            parts = settle(parts.union(landed).distinct())
        if parts.isEmpty():
            return
        old = self._rows()
        # Partitions of a table are folders, of which there are few enough to list.
        new = self._landed(changed(old.join(F.broadcast(parts), same(old, parts), "left_semi")))
        left = new.select(*self.partitions).distinct()
        emptied = parts.join(left, same(parts, left), "left_anti")
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        where = self._rows().withColumn("_folder", folder)
        folders = [r["_folder"] for r in where.join(F.broadcast(emptied), same(where, emptied), "left_semi").select("_folder").distinct().collect()]
        if not left.isEmpty():
            self._write(new, "overwrite")
        self._drop(folders)
        self.spark.catalog.refreshByPath(self.path)

    def _landed(self, rows: DataFrame) -> DataFrame:
        """Changed rows with the partition that their key has now."""
        return self._placed(rows.drop(PART)) if self.hashed else rows

    def _drop(self, folders: list[str]) -> None:
        for folder in folders:
            p = self._hadoop(folder)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cascade(steps: list[tuple[Table, list[str]]], keys: DataFrame) -> None:
    """Delete the rows of ``keys`` from tables in turn, children first."""
    for t, on in steps:
        if t.exists():
            t.delete_matching(keys, on)


def write_report(report: DataFrame, path: str, order: str) -> None:
    """CSV files with a header, in order from file to file and within each; a small report is one file."""
    report.orderBy(order).write.mode("overwrite").option("header", True).csv(path)
