import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ionflow.functions import numbers as N
from ionflow.operators import learning
from ionflow.plans import tasks as T


def test_numbers(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 5, 1024, 1025, -7)], "v long").select("v", N.log2n(F.col("v")).alias("n")).collect()
    for r in rows:
        n = 0
        while r.v > 2**n:
            n += 1
        assert r.n == n
    got = spark.createDataFrame([(-0.05,), (0.1,), (0.4,)], "d double").select(N.huber_loss(F.col("d"), 0.1).alias("h"), N.shifted_sigmoid(F.col("d")).alias("s")).collect()
    assert [r.h for r in got] == pytest.approx([0.00125, 0.005, 0.035]) and got[2].s == pytest.approx(math.tanh(0.4))
    at = spark.sql("SELECT TIMESTAMP'2024-02-03 04:05:06' AS t").select(N.stamped(F.lit("run"), F.col("t")).alias("n")).first()
    assert at.n == "run-20240203040506"


def test_split(spark):
    df = spark.createDataFrame([(run, f"p{i}", d, g) for run, n in (("a", 11), ("b", 4)) for i in range(n) for d in (False, True) for g in range(3)], "run string, peptide string, decoy boolean, g int")
    half = learning.split(df, ["run"], "peptide", "decoy", 0.5)
    counts = {(r.run, r.decoy): r.n for r in half.groupBy("run", "decoy").agg(F.countDistinct("peptide").alias("n")).collect()}
    assert counts == {("a", False): 6, ("a", True): 6, ("b", False): 2, ("b", True): 2} and half.count() == 16 * 3
    assert sorted(half.collect()) == sorted(learning.split(df, ["run"], "peptide", "decoy", 0.5).collect())
    assert sorted(half.collect()) != sorted(learning.split(df, ["run"], "peptide", "decoy", 0.5, seed=8).collect())
    assert learning.split(df, ["run"], "peptide", "decoy", 1.0).count() == df.count()


def test_tasks(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 12)
    path = f"{tmp_path}/log"
    for rows in (T.started(spark, "1", "first", t0), T.entry(spark, "1", "half way", at=t0 + timedelta(seconds=5)), T.started(spark, "2", "second", t0 + timedelta(seconds=7)), T.ended(spark, "1", "SUCCESS", "all done", t0 + timedelta(seconds=9.5))):
        rows.write.mode("append").parquet(path)
    entries = spark.read.parquet(path)
    listed = T.tasks(entries).collect()
    assert [(r.task_id, r.name, r.status, r.entries, r.seconds) for r in listed] == [("2", "second", "RUNNING", 1, None), ("1", "first", "SUCCESS", 4, 9.5)]
    assert [r.content for r in T.log_of(entries, "1").collect()] == [T.STARTED, "half way", "all done", T.ENDED]
    assert T.tasks(entries.where("false")).count() == 0 and T.entry(spark, "3", "now").first().at is not None
