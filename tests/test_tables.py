import os

import pytest
from pyspark.sql import functions as F

from ionflow.sources import layout
from ionflow.sources.tables import Table


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def partition(files_, value):
    return {f for f in files_ if f.startswith(f"{value}/")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", ["k"], ["run"])
    t.insert(spark.createDataFrame([(i, float(i), f"r{i % 4}") for i in range(40)], "k long, v double, run string"))
    return t, f"{tmp_path}/t"


def test_only_touched_partitions_are_rewritten(spark, table):
    t, path = table
    before = files(path)
    t.update(F.col("k") == 5, {"v": F.lit(-1.0)})
    after = files(path)
    assert {f for f in before if not f.startswith("run=r1/")} <= after and not partition(before, "run=r1") & after
    t.upsert(spark.createDataFrame([(6, 66.0, "r2"), (100, 1.0, "new")], "k long, v double, run string"))
    assert {f for f in after if f.startswith(("run=r0/", "run=r1/", "run=r3/"))} <= files(path)
    t.patch(spark.createDataFrame([(7, 77.0), (999, 0.0)], "k long, v double"))
    t.delete(F.col("k").isin(0, 4))
    want = {i: (i, float(i), f"r{i % 4}") for i in range(40)} | {5: (5, -1.0, "r1"), 6: (6, 66.0, "r2"), 100: (100, 1.0, "new"), 7: (7, 77.0, "r3")}
    assert rows(t.read()) == sorted((v for k, v in want.items() if k not in (0, 4)), key=str)
    before = files(path)
    t.update(F.col("k") == 12345, {"v": F.lit(0.0)})
    assert files(path) == before  # nothing matches, nothing is written


def test_rows_that_move_and_partitions_that_empty(spark, table):
    t, path = table
    t.update(F.col("run") == "r3", {"run": F.lit("r2")})
    assert not partition(files(path), "run=r3") and t.count(F.col("run") == "r2") == 20 and t.count() == 40
    t.delete(F.col("run") == "r2")
    assert t.count() == 20 and not os.path.isdir(f"{path}/run=r2") and os.path.isdir(f"{path}/run=r0")
    t.delete_matching(spark.createDataFrame([("r0",), ("none",)], "run string"), ["run"])
    assert {r.run for r in t.read().select("run").distinct().collect()} == {"r1"}
    t.update(F.lit(True), {"k": F.col("k") + 1000})
    assert t.count(F.col("k") >= 1000) == 10 == t.count()


def test_a_failure_leaves_the_table(spark, table, monkeypatch):
    t, path = table
    want, names = rows(t.read()), files(path)
    for change in (lambda: t.update(F.col("k") == 5, {"v": F.raise_error(F.lit("no")).cast("double")}), lambda: t.upsert(spark.createDataFrame([(5, 1.0, "r1")], "k long, v double, run string").withColumn("v", F.raise_error(F.lit("no")).cast("double")))):
        with pytest.raises(Exception, match="no"):
            change()
        assert rows(t.read()) == want and files(path) == names
    monkeypatch.setattr(Table, "_drop", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        t.delete(F.col("run") == "r1")
    assert rows(t.read()) == want  # still there, and asked for again:
    monkeypatch.undo()
    t.delete(F.col("run") == "r1")
    assert t.count() == 30


def test_hashed_tables_and_lookups(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/h", ["run", "peptide"], indexes=["protein"], buckets=8)
    t.insert(spark.range(4000).select(F.concat(F.lit("r"), F.col("id") % 5).alias("run"), F.col("id").alias("peptide"), F.concat(F.lit("P"), F.col("id") % 1000).alias("protein")))
    assert "_part" not in t.read().columns and t.count() == 4000
    hit = t.find(run="r2", peptide=17)
    assert rows(hit) == [("r2", 17, "P17")] and layout.scan_numbers(hit)["files"] == 1
    before = files(f"{tmp_path}/h")
    t.update((F.col("run") == "r2") & (F.col("peptide") == 17), {"protein": F.lit("Q")})
    after = files(f"{tmp_path}/h")
    assert len(before - after) == 1 and rows(t.find(protein="Q")) == [("r2", 17, "Q")]
    t.upsert(spark.createDataFrame([("r2", 17, "Z"), ("x", 1, "N")], "run string, peptide long, protein string"))
    assert rows(t.find(run="r2", peptide=17)) == [("r2", 17, "Z")] and t.count() == 4001
    t.delete(F.lit(True))
    assert not files(f"{tmp_path}/h")


def test_clustered_files_and_bloom_filters(spark, tmp_path):
    df = spark.range(40_000).select("id", F.concat(F.lit("p"), F.xxhash64("id")).alias("name"), F.lit("x" * 20).alias("pad"))
    layout.write_clustered(df, f"file://{tmp_path}/c", ["id"], bloom=["name"], files=8, distinct=5000, **{"parquet.block.size": "40000", "parquet.page.size": "2000"})
    data = spark.read.parquet(f"file://{tmp_path}/c")
    everything = data.select("id", "name", "pad")
    everything.write.format("noop").mode("overwrite").save()
    one = data.where("id = 12345")
    assert len(one.collect()) == 1
    found = layout.scan_numbers(one)["rows"]
    assert 0 < found <= 5000  # row groups of one file
    name = df.where("id = 777").first().name
    hit = data.where(F.col("name") == name)
    assert [r.id for r in hit.collect()] == [777] and layout.scan_numbers(hit)["rows"] <= 5000
    miss = data.where("name = 'p0'")
    assert miss.collect() == [] and layout.scan_numbers(miss)["rows"] <= 5000


def test_buckets_join_without_exchange(spark):
    for n in ("left_side", "right_side"):
        spark.sql(f"DROP TABLE IF EXISTS {n}")
    a = layout.write_bucketed(spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("a")), "left_side", ["k"], 4)
    b = layout.write_bucketed(spark.range(300).select(F.col("id").alias("k"), F.lit(2).alias("b")), "right_side", ["k"], 4)
    joined = a.join(b.hint("merge"), "k").groupBy("k").count()
    assert joined.count() == 300
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    for n in ("left_side", "right_side"):
        spark.sql(f"DROP TABLE {n}")


def test_prune_hints(spark):
    keys = spark.createDataFrame([(1, "a"), (9, "b"), (None, "c")], "k long, s string")
    assert spark.range(20).select(F.col("id").alias("k")).where(layout.prune_hint(spark, keys, ["k"])).count() == 2
    assert spark.range(20).select(F.col("id").alias("k")).where(layout.prune_hint(spark, keys, ["k"], most=1)).count() == 9
    assert layout.prune_hint(spark, keys.where("false"), ["k"]) is None
