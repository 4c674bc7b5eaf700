"""A log of tasks in a table: begun, told, ended; newest first.

Each entry is a row of its own, so writers never rewrite one another's, and a task is what its
entries say. ``entries``: task_id, name, at (timestamp), status (null where an entry tells none), content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "task_id string, name string, at timestamp, status string, content string"
STARTED, ENDED = "Task Started", "Task Ended"


def entry(spark, task_id: str, content: str, name: str | None = None, status: str | None = None, at=None) -> DataFrame:
    """One entry, to be appended; the time is that of the call unless one is given."""
    row = spark.createDataFrame([(task_id, name, at, status, content)], SCHEMA)
    return row.withColumn("at", F.coalesce("at", F.current_timestamp()))


def started(spark, task_id: str, name: str, at=None) -> DataFrame:
    return entry(spark, task_id, STARTED, name, "RUNNING", at)


def ended(spark, task_id: str, status: str, content: str | None = None, at=None) -> DataFrame:
    """The last entries of a task: ``content`` if there is any, and the end with its status."""
    last = entry(spark, task_id, ENDED, None, status, at)
    return last if content is None else entry(spark, task_id, content, None, None, at).unionByName(last)


def tasks(entries: DataFrame) -> DataFrame:
    """One row per task, newest first: task_id, name, status (the last one told), start, entries, and the seconds from its first entry to its end (null while it runs)."""
    known = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", (F.col("content") == ENDED).alias("end"), c)))[c]
    end = F.max(F.when(F.col("content") == ENDED, F.col("at")))
    g = entries.groupBy("task_id").agg(known("name").alias("name"), known("status").alias("status"), F.min("at").alias("start"), F.count(F.lit(1)).alias("entries"), end.alias("_end"))
    seconds = F.col("_end").cast("double") - F.col("start").cast("double")
    return g.select("task_id", "name", "status", "start", "entries", seconds.alias("seconds")).orderBy(F.col("start").desc(), "task_id")


def log_of(entries: DataFrame, task_id: str) -> DataFrame:
    """The entries of one task in order of time, the start first and the end last where times are equal."""
    rank = F.when(F.col("content") == STARTED, 0).when(F.col("content") == ENDED, 2).otherwise(1)
    return entries.where(F.col("task_id") == task_id).orderBy("at", rank, "content").select("at", "content")
