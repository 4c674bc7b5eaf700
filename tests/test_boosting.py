import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow.operators import boosting as B
from ionflow.plans import analysis as A
from tests.test_analysis import scored_run

SMALL = B.Settings(rounds=3, depth=3, rate=0.3, bins=8)


def plain_trees(x, y, s):
    """A booster of one run, row by row and node by node: (trees as {node: (feature, threshold, value)}, margins)."""
    cuts = [sorted({sorted(x[:, j])[max(0, -(-len(x) * i // s.bins) - 1)] for i in range(1, s.bins)}) for j in range(x.shape[1])]
    margin, trees = [np.log(s.base / (1 - s.base))] * len(x), []

    def sums(rows):
        g = h = 0
        for i in rows:
            p = 1 / (1 + np.exp(-margin[i]))
            g, h = g + int(np.rint((p - y[i]) * B.UNIT)), h + int(np.rint(p * (1 - p) * B.UNIT))
        return g / B.UNIT, h / B.UNIT

    def value(rows):
        g, h = sums(rows)
        return float(np.clip(-g / (h + s.ridge), -s.largest_step, s.largest_step)) * s.rate

    for _ in range(s.rounds):
        tree, places = {}, {0: list(range(len(x)))}
        for node in range(2**s.depth - 1):
            rows = places.get(node)
            if not rows:
                continue
            g, h = sums(rows)
            best = (1e-9, None)
            for j, own in enumerate(cuts):
                for c in own:
                    left = [i for i in rows if x[i, j] <= c]
                    gl, hl = sums(left)
                    if hl < s.least_weight or h - hl < s.least_weight:
                        continue
                    gain = (gl * gl / (hl + s.ridge) + (g - gl) * (g - gl) / (h - hl + s.ridge) - g * g / (h + s.ridge)) / 2 - s.least_gain
                    if gain > best[0]:
                        best = (gain, (j, c, left))
            if best[1]:
                j, c, left = best[1]
                tree[node] = (j, c)
                places[2 * node + 1], places[2 * node + 2] = left, [i for i in rows if i not in set(left)]
        values = {node: value(rows) for node, rows in places.items()}
        for node, rows in places.items():
            if node not in tree:
                for i in rows:
                    margin[i] += values[node]
        trees.append((tree, values))
    return trees, margin


def frame(spark, runs, seed=1, n=120):
    rng = np.random.default_rng(seed)
    rows, data = [], {}
    for r in runs:
        x = np.round(rng.normal(0, 1, (n, 4)), 2)
        y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, n) > 0).astype(int)
        data[r] = x, y
        rows += [(r, i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))]
        rows += [(r, n + i, *map(float, v), None) for i, v in enumerate(rng.normal(0, 1, (5, 4)))]
    return spark.createDataFrame(rows, "run string, i long, a double, b double, c double, d double, y int").repartition(3), data


def model(trees, run):
    out = {}
    for r in trees.where(F.col("run") == run).collect():
        out[r.tree] = {k: (f, t) for k, (f, t) in enumerate(zip(r.feature, r.threshold, strict=True)) if f >= 0}
    return [out[k] for k in sorted(out)]


def test_trees_equal_a_plain_booster(spark):
    df, data = frame(spark, ["u", "v"])
    scored, trees = B.boost(df, ["run"], list("abcd"), "y", settings=SMALL)
    rows, trees = scored.collect(), trees.cache()
    assert len(rows) == df.count() and scored.columns == [*df.columns, "margin"]
    for run, (x, y) in data.items():
        want, margin = plain_trees(x, y, SMALL)
        assert model(trees, run) == [t for t, _ in want]
        assert [r.margin for r in sorted((r for r in rows if r.run == run and r.y is not None), key=lambda r: r.i)] == pytest.approx(margin, abs=1e-9)
    # A run has the same trees and margins alone.
    alone, own = B.boost(df.where("run = 'v'"), ["run"], list("abcd"), "y", settings=SMALL)
    assert model(own, "v") == model(trees, "v")
    assert {r.i: r.margin for r in alone.collect()} == {r.i: r.margin for r in rows if r.run == "v"}
    # Rows without a label are scored by the same trees.
    (tree, values), extra = plain_trees(*data["u"], B.Settings(**{**SMALL.__dict__, "rounds": 1}))[0][0], None
    one, _ = B.boost(df, ["run"], list("abcd"), "y", settings=B.Settings(**{**SMALL.__dict__, "rounds": 1}))
    for r in one.where("run = 'u' AND y IS NULL").collect():
        node = 0
        while node in tree:
            f, t = tree[node]
            node = 2 * node + (1 if r["abcd"[f]] <= t else 2)
        assert r.margin == pytest.approx(values[node])


def test_odd_scores(spark):
    rows = [("u", 1.0, 0), ("u", None, 1), ("u", float("nan"), 1), ("u", 2.0, None), ("v", 1.0, None), (None, 1.0, 0), (None, 5.0, 1)]
    df = spark.createDataFrame(rows, "run string, a double, y int")
    scored, trees = B.boost(df, ["run"], ["a"], "y", settings=B.Settings(rounds=1, depth=1, least_weight=0.0))
    got = {(r.run, r.y, str(r.a)): r.margin for r in scored.collect()}
    assert len(got) == 7 and got["v", None, "1.0"] == 0.0  # no label in its run
    assert got["u", 1, "None"] == got["u", 1, "nan"] > 0 > got["u", 0, "1.0"] == got["u", None, "2.0"]
    assert B.boost(df.where("false"), ["run"], ["a"], "y", settings=B.Settings(rounds=1, depth=1))[0].count() == 0


def test_identify_by_trees(spark):
    a, b = scored_run(spark, "a"), scored_run(spark, "b", 6, 5.0)
    s = B.Settings(rounds=2, depth=2, rate=0.8, bins=8)
    rows = lambda d: {(r.run_id, r.peptide_ref): (r.total_score, r.selected_rt, r.status, round(r.fdr, 9)) for r in A.identify(d, 0.05, learner="boosted", trees=s).collect()}
    together = rows(a.unionByName(b))
    assert {k: v for k, v in together.items() if k[0] == "a"} == rows(a)
    planted = [v for k, v in together.items() if int(k[1][1:]) < 60]
    assert sum(v[2] == 1 for v in planted) > 0.8 * len(planted) and sum(v[1] < 100 for v in planted) > 0.95 * len(planted)
    with pytest.raises(ValueError):
        A.identify(a, learner="forest")
