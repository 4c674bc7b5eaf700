import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow.operators import fdr, filters, groups, learning, ordered, ranges, series, similarity
from ionflow.operators import settle as settling

TARGETS, DECOYS = [9, 8, 7, 6, 5, 4, 3, 2], [6.5, 3.5, 2.5, 1]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(f"t{i}", float(s), False) for i, s in enumerate(TARGETS)] + [(f"d{i}", float(s), True) for i, s in enumerate(DECOYS)], "id string, s double, decoy boolean")


def test_hand_case(spark, scored):
    p = fdr.empirical(scored, "s", "decoy")
    assert {r.score: r.p for r in p.collect()} == {9: 0.25, 8: 0.25, 7: 0.25, 6: 0.25, 5: 0.25, 4: 0.25, 3: 0.5, 2: 0.75}
    assert fdr.pi0(p) == pytest.approx(0.357143, abs=1e-6)
    rows = {r.score: r for r in fdr.pipeline(scored, ["id"], "s", "decoy", 0.2).collect()}
    assert [round(rows[s].fdr, 6) for s in TARGETS] == [0.119048] * 6 + [0.204082, 0.267857]
    assert [round(rows[s].q_value, 6) for s in TARGETS] == [0.119048] * 6 + [0.204082, 0.267857]
    assert [rows[s].status for s in TARGETS] == [1] * 6 + [2, 2]
    m = p.select("score", "p").join(fdr.metrics(p, fdr.pi0(p)).select("p", "fdr"), "p").drop("p")
    d = fdr.decoy_rates(scored.join(m, scored.s == m.score, "left"), "s", "decoy", "fdr").collect()
    assert {r.score: None if r.fdr is None else round(r.fdr, 6) for r in d} == {1: None, 2.5: 0.204082, 3.5: 0.119048, 6.5: 0.119048}


def test_separated_scores_have_least_pi0(spark):
    df = spark.createDataFrame([("a", 5.0, False), ("b", 6.0, False), ("c", 1.0, True)], "id string, s double, decoy boolean")
    assert {r.pi0 for r in fdr.pipeline(df, ["id"], "s", "decoy").collect()} == {1e-6}


def test_running_over_buckets(spark):
    rng = np.random.default_rng(1)
    v = rng.permutation(500)
    df = spark.createDataFrame([(int(x), int(x) % 7) for x in v], "k long, v long")
    for buckets in (1, 3, 16):
        rows = ordered.running(df, "k", {"s": ("sum", "v"), "m": ("max", "v")}, buckets=buckets).orderBy("k").collect()
        assert [r.s for r in rows] == np.cumsum(np.arange(500) % 7).tolist() and rows[3].m == 3
        rows = ordered.running(df, "k", {"s": ("sum", "v")}, descending=True, exclusive=True, buckets=buckets).orderBy("k").collect()
        assert rows[-1].s == 0 and rows[0].s == sum(i % 7 for i in range(1, 500))


def test_interval_join_matches_nested_loop(spark):
    rng = np.random.default_rng(2)
    p, w = [(i, float(x)) for i, x in enumerate(rng.uniform(0, 100, 200))], [(i, float(a), float(a + d)) for i, (a, d) in enumerate(zip(rng.uniform(0, 100, 40), rng.uniform(0, 30, 40), strict=True))]
    points, windows = spark.createDataFrame(p, "i long, x double"), spark.createDataFrame(w, "w long, lo double, hi double")
    got = {(r.i, r.w) for r in ranges.interval_join(points, windows, "x", "lo", "hi", 7.0).collect()}
    assert got == {(i, k) for i, x in p for k, a, b in w if a <= x < b}
    pairs = {(r.i, r.i_b) for r in ranges.band_pairs(points, "x", 2.5, "i").collect()}
    assert pairs == {(i, j) for i, x in p for j, y in p if i < j and abs(x - y) <= 2.5}
    plan = ranges.interval_join(points, windows, "x", "lo", "hi", 7.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_histogram_and_percentile(spark):
    df = spark.createDataFrame([(900.0,), (900.5,), (905.0,)], "v double")
    assert groups.histogram(df, "v", 900, 1000, 20).orderBy("bin").first().n == 2
    one = spark.createDataFrame([("g", float(x)) for x in range(1, 11)], "g string, v double")
    assert {r.pct: r.value for r in groups.percentiles(one, "g", "v").collect()}[25] == 2.75
    assert one.groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("a")).select(groups.legacy_percentile(F.col("a"), F.lit(25)).alias("x")).first().x == 2.75
    assert len(groups.FDR_BINS) == 29


def test_percentiles_rank_only_what_they_need(spark, monkeypatch):
    rng = np.random.default_rng(4)
    held = {"a": rng.lognormal(0, 3, 12_000), "b": rng.random(6_000), "c": rng.integers(-3, 3, 2_000).astype(float), "d": np.full(50, 7.0), "e": np.array([2.0, -0.0, 0.0, np.inf, -np.inf, np.nan])}
    rows = [(g, float(v)) for g, values in held.items() for v in values]
    df = spark.createDataFrame([*rows, (None, 1.0), ("a", None), ("f", None)], "g string, v double").repartition(3)
    tables = []
    for name in ("settle", "written"):
        real = getattr(settling, name)
        monkeypatch.setattr(settling, name, lambda t, real=real: tables.append(real(t)) or tables[-1])
    found = {(r.g, r.pct): r.value for r in groups.percentiles(df, "g", "v", settled=True).collect()}
    assert len(found) == 99 * len(held)
    for g, values in held.items():
        v, n = np.sort(values), len(values)
        for p in range(1, 100):
            pos = min(max(p / 100 * (n + 1), 1.0), float(n))
            low, high = v[int(np.floor(pos)) - 1], v[int(np.ceil(pos)) - 1]
            with np.errstate(invalid="ignore"):
                np.testing.assert_equal(found[g, p], low + (pos - np.floor(pos)) * (high - low))
    # Counts of ranges, and the ranges that hold a wanted rank: neither grows with the values.
    assert [t.count() <= len(held) * most for t, most in zip(tables, (groups.RANGES + 1, 2 * 99), strict=True)] == [True, True]


def test_merge(spark):
    df = spark.createDataFrame([("X", "1", 10.0), ("X", "2", 20.0), ("Y", "1", 4.0)], "pep string, run string, v double")
    m = groups.merge_runs(df, "run", "pep", F.col("v"))
    assert {r.pep: r.intensity for r in m.collect()} == {"X": 15, "Y": 4}
    s = groups.merge_summary(m, 2).first()
    assert (s.hit1, s.hit2, s.missing_ratio) == (1, 1, 0.25)


def test_similarity_case(spark):
    df = spark.createDataFrame([(1, 50.0, 0.6), (1, 30.0, 0.3), (1, 20.0, 0.1)], "k long, r double, l double")
    s = similarity.scores(df, ["k"], "r", "l").first()
    want = {"dotprod": 0.989144, "sangle": 0.197052, "rsmd": 0.066667, "avg_sqr": 0.081650, "int_shift": 0.583333, "manhattan": 0.139517, "pearson": 0.997176}
    assert {k: round(s[k], 6) for k in want} == want


def test_series_kernels():
    assert [round(x, 6) for x in series.weights("savitzky_golay", 5)] == [0.485714, 0.342857, -0.085714]
    assert series.weights("gauss", 5) == [0.402619947, 0.244201342, 0.054488685] and series.weights("linear", 7) == [0.25, 0.1875, 0.125, 0.0625]
    x = np.arange(0, 200.0, 1.0)
    y = 100 * np.exp(-((x - 80.3) ** 2) / (2 * 5.0**2)) + 60 * np.exp(-((x - 140.0) ** 2) / (2 * 4.0**2)) + 1e-3
    peaks = series.pick_peaks(x, y)
    assert [round(p["apex"], 1) for p in peaks][:2] == [80.3, 140.0]
    c = series.cross_correlation(y, y)
    assert c.argmax() == len(y) - 1 and c.max() == pytest.approx(1.0)
    assert (series.gauss_filter(x, np.ones(200)) == pytest.approx(1.0)) and (series.signal_to_noise(x[:5], y[:5]) == y[:5] / 2).all()
    brute = []
    sn = series.signal_to_noise(x, y, 50.0)
    size = max(1.0, (y.mean() + 3 * y.std()) / 30)
    for i in range(200):
        inside = y[np.abs(x - x[i]) <= 25]
        h = np.bincount(np.minimum((inside / size).astype(int), 29), minlength=30).cumsum()
        brute.append(y[i] / max(1.0, (np.argmax(h >= (len(inside) + 1) // 2) + 0.5) * size))
    assert sn == pytest.approx(np.array(brute))


def test_smoothing_and_maxima_on_rows(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.0, 0.0, 1.0, 0.0, 0.0])], "k string, t long, v double")
    got = [round(r.smooth, 6) for r in series.smooth(df, ["k"], "t", "v", "savitzky_golay", 5).orderBy("t").collect()]
    assert got == [-0.085714, 0.342857, 0.485714, 0.342857, -0.085714]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, 3.0, 2.0, 0.0, 5.0, 4.0])], "k string, t long, v double")
    assert [r.t for r in series.local_maxima(df, ["k"], "t", "v").collect()] == [1]


def test_lines_and_weights(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 100, 60)
    y = 0.05 * x - 2 + rng.normal(0, 0.01, 60)
    y[:3] += 40
    r = learning.calibrate(y, x)
    assert r["slope"] == pytest.approx(0.05, abs=0.005) and not r["selected"][:3].any()
    df = spark.createDataFrame([(float(a), float(b), float(2.0 * a - b)) for a, b in rng.normal(size=(50, 2))], "a double, b double, y double")
    w = learning.least_squares(df, ["a", "b"], "y", muted=())
    assert w["a"] == pytest.approx(2) and w["b"] == pytest.approx(-1)


def test_filters(spark):
    df = spark.createDataFrame([(1, "Ab", ["x"], False), (2, "cd", ["x", "y"], True), (3, None, None, None)], "i long, s string, p array<string>, disable boolean")
    ids = lambda *p: [r.i for r in filters.where(df, *p).orderBy("i").collect()]
    assert ids(None, filters.equal("s", None)) == [1, 2, 3] and ids(filters.matches("s", "A")) == [1] and ids(filters.enabled()) == [1]
    assert ids(filters.fewer_than("p", 2)) == [1, 3] and ids(filters.contains("p", "y")) == [2] and ids(filters.half_open("i", 1, 3)) == [1, 2]
    assert ids(filters.one_of("i", [1, 2], 3)) == [1, 2] and ids(filters.one_of("i", [1, 2], 3, single_wins=True)) == [3] and ids(filters.not_prefixed("p", "x")) == [3]
    assert [r.i for r in filters.page(df, [F.col("i")], 2, 2).collect()] == [3] and filters.exists(df, F.col("i") == 2)


def test_fits_and_point_sets(spark):
    rng = np.random.default_rng(4)
    x = np.arange(40.0)
    y = 2 * x + 5 + rng.normal(0, 0.1, 40)
    y[[3, 30]] += 40
    lines = {k: learning.robust_line(x, y, 0.5, k) for k in ("huber", "log", "squares")}
    assert abs(lines["log"][0] - 2) < 0.01 and abs(lines["huber"][0] - 2) < 0.02
    assert lines["squares"] == pytest.approx(tuple(np.polyfit(x, y, 1)))
    losses = lambda a, b: sum(r * r / 2 if r <= 0.5 else (np.log(r / 0.5) + 0.5) * 0.25 for r in np.abs(y - a * x - b))
    assert losses(*lines["log"]) <= min(losses(lines["log"][0] + d, lines["log"][1] - 20 * d) for d in (-0.01, 0.01))
    df = spark.createDataFrame([("r", float(a), float(b)) for a, b in zip(x, y, strict=True)], "run string, x double, y double")
    r = learning.calibrate_groups(df, ["run"], "y", "x", "log").first()
    assert r.selected == len(r.points) and len(r.points) + len(r.left_out) == 40


def test_small_kernels():
    assert series.moments(np.array([1.0, np.nan, 3.0])) == {"sum": 4.0, "mean": 2.0, "variance": 1.0, "sd": 1.0} and series.moments(np.array([np.nan]))["sd"] == 0
    x = np.array([1.0, 2.0, 4.0])
    assert [series.first_at_least(x, t) for t in (0, 2, 3, 5)] == [0, 1, 2, -1] and series.around(x, 1.5, 4) == (1, 2) and series.around(x, 2.5, 3) == (-1, -1)
    mz, y = np.array([100.0, 100.002, 100.004, 100.006, 100.05]), np.array([1.0, 5.0, 9.0, 4.0, 7.0])
    assert series.adaptive_sum(mz, y, 100.0045) == 19.0 and series.adaptive_sum(mz, y, 100.03) == 0.0 and series.adaptive_sum(mz[:0], y[:0], 1.0) == 0.0


def test_found_under(spark):
    df = spark.createDataFrame([("a", 0.001), ("a", 0.5), ("b", 0.2)], "run string, fdr double")
    assert {r.run: r.found for r in fdr.found_under(df, ["run"], "fdr").collect()} == {"a": 1, "b": 0}
