import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow.functions import simulate as S
from ionflow.plans import crossrun as X


def test_defaults_clinic_and_items(spark):
    o = spark.createDataFrame([("o1", "r1", False, "2024-01-01 00:00:00"), ("o2", "r1", True, "2024-01-02 00:00:00"), ("o3", "r2", False, "2024-01-03 00:00:00"), ("o4", "r2", False, "2024-01-04 00:00:00")], "overview_id string, run_id string, default_one boolean, t string").withColumn("create_date", F.to_timestamp("t"))
    assert {r.overview_id for r in X.default_overviews(o).where("default_one").collect()} == {"o2", "o3"}
    runs = spark.createDataFrame([("p", "r1", "b", None), ("p", "r2", "a", "z")], "project_id string, run_id string, name string, alias string")
    rows = {r.run_id: r for r in X.clinic(runs, o).collect()}
    assert rows["r2"].position == 1 and rows["r1"].overviews == ["o1", "o2"]
    assert {r.run_id: r.alias for r in X.ordinal_aliases(runs, "x").collect()} == {"r2": "x-1", "r1": "x-2"}
    items = spark.createDataFrame([([("a", "1")],)], "i array<struct<key:string,value:string>>")
    assert [tuple(x) for x in items.select(X.set_item(F.col("i"), "b", "2").alias("x")).first().x] == [("a", "1"), ("b", "2")]
    assert items.select(X.set_item(F.col("i"), "a", None).alias("x")).first().x == []


def test_sums_folds_and_leave_one_out(spark):
    data = spark.createDataFrame([("o", "p1", False, 0, [1.0, 2.0]), ("o", "p2", False, 0, [3.0])], "overview_id string, peptide_ref string, decoy boolean, status int, selected_rts array<double>")
    sums = spark.createDataFrame([("o", "p1", False, 1, 0.001, 0.001, 5.0, 2.0)], "overview_id string, peptide_ref string, decoy boolean, status int, fdr double, q_value double, total_score double, selected_rt double")
    assert {r.peptide_ref: (r.status, r.select_index) for r in X.with_sums(data, sums).collect()} == {"p1": (1, 1), "p2": (4, None)}
    results = spark.createDataFrame([(f"r{k}", p, False, [pr], True, 1, None, v * (1 + k % 2)) for k in range(4) for p, pr, v in (("x", "A_HUMAN", 8.0), ("y", "B_YEAS8", 2.0), ("z", "reverse_1", 1.0))], "run_id string, peptide_ref string, decoy boolean, proteins array<string>, is_unique boolean, status int, fit_int_sum double, intensity_sum double")
    folds = {r.species: (r.x, r.y) for r in X.fold_changes(results, ["r1", "r3"], ["r0", "r2"]).collect()}
    assert folds == {"HUMAN": (3.0, 1.0), "YEAST": (1.0, 1.0)}
    stats, pct = X.fold_summary(X.fold_changes(results, ["r1"], ["r0"]))
    assert {r.species: r["mean"] for r in stats.collect()} == {"HUMAN": 1.0, "YEAST": 1.0} and pct.count() == 198
    coords = spark.createDataFrame([("p", [("y1", 1.0), ("y2", 2.0)])], "peptide_ref string, fragments array<struct<cut_info:string,mz:double>>")
    assert {(r.without, r.fragments[0].cut_info) for r in X.leave_one_out(coords).collect()} == {("y1", "y2"), ("y2", "y1")}


def test_simulator(spark):
    model = {("bias", ""): -0.5, ("residue", "0:P"): 1.0, ("kr_left", "0"): 0.1}
    rows = S.y_ions("APK", model)
    assert [r["cut_info"] for r in rows] == ["y2", "y1"] and rows[0]["intensity"] == 10_000
    assert rows[1]["intensity"] == pytest.approx(10_000 * np.exp(-0.5 + 1.0 + 0.1))
    assert rows[1]["mz"] == pytest.approx(147.1128, abs=0.01)
    df = spark.createDataFrame([("PEPTIDEK", 2), ("PEPTIDEK", 3)], "s string, z int")
    got = S.predict(df, "s", "z", model, top=3).orderBy("z").collect()
    assert len(got[0].predicted) == 3 and got[1].predicted is None
    table = spark.createDataFrame([("bias", "", -0.5)], "term string, key string, weight double")
    assert S.model_of(table) == {("bias", ""): -0.5}
