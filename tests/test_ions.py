import itertools

import numpy as np
import pytest

from ionflow.operators import ions as I


def test_removal_equals_recomputation():
    rng = np.random.default_rng(1)
    for _ in range(80):
        k = int(rng.integers(2, 9))
        base = rng.random(20)
        m = I.correlations(np.array([base * rng.random() + rng.random(20) * rng.choice([0.05, 1.0]) for _ in range(k)]))
        left, score = I.strict(m, 0.9)
        kept = list(range(k))
        mean = lambda ids: np.mean([m[a, b] for a in ids for b in ids if a != b])  # noqa: B023, E731
        while len(kept) > 2 and mean(kept) < 0.9:
            kept.remove(min(kept, key=lambda i: (sum(m[i, j] for j in kept if j != i), i)))  # noqa: B023
        assert left == kept and score == pytest.approx(mean(kept))
    flat = I.correlations(np.array([[1.0, 1, 1], [1, 2, 3]]))
    assert flat.tolist() == [[1, 0], [0, 1]]


def test_subsets_equal_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 13))
        size, own = int(rng.integers(0, n + 1)), np.round(rng.normal(0, 1, n), 2)
        pairs = np.round(rng.normal(0, 1, (n, n)), 2)
        pairs = (pairs + pairs.T) / 2
        value = lambda c: sum(own[list(c)]) + sum(pairs[a, b] for a, b in itertools.combinations(c, 2))  # noqa: B023, E731
        best = max(map(value, itertools.combinations(range(n), size)))
        chosen, total = I.best_subset(own, pairs, size)
        assert total == pytest.approx(best) and value(chosen) == pytest.approx(best) and len(chosen) == size
    assert I.best_subset(np.ones(2), np.zeros((2, 2)), 3) == ([], 0.0)


def test_planted_curves_are_recovered():
    rng = np.random.default_rng(3)
    truth = np.array([[h, w, s, z] for h, w, s, z in zip(rng.uniform(100, 9000, 40), rng.uniform(3, 8, 40), rng.uniform(3, 12, 40), rng.uniform(80, 120, 40), strict=True)])
    t = np.tile(np.arange(40.0, 200, 2.0), (40, 1))
    y = I.emg(t, np.concatenate([np.log(truth[:, :3]), truth[:, 3:]], axis=1))
    there = np.ones_like(t, bool)
    there[::2, 70:] = False
    found, score = I.emg_fits(t, y, there)
    assert np.allclose(found, truth, rtol=0.01) and (score > 0.9999).all()
    # The closed form against its convolution, point by point.
    u = np.arange(0, 400, 0.01)
    for h, w, s, z in truth[:3]:
        at = np.array([z - w, z, z + s, z + 3 * s])
        plain = [h * np.sum(np.exp(-u / s) / s * np.exp(-((x - u - z) ** 2) / (2 * w * w))) * 0.01 for x in at]
        assert np.allclose(I.emg(at[None], np.array([[np.log(h), np.log(w), np.log(s), z]]))[0], plain, rtol=5e-3)
    noisy, score = I.emg_fits(t, y + rng.normal(0, 0.01, y.shape) * y.max(axis=1, keepdims=True), np.ones_like(t, bool))
    assert (np.abs(noisy[:, 3] - truth[:, 3]) < 2).all() and (score > 0.99).all()


def test_as_operators(spark):
    t = np.arange(30.0)
    bell = lambda z, w=3.0: np.exp(-((t - z) ** 2) / (2 * w * w)).tolist()
    rows = [("a", ["x", "y", "z"], [bell(15), bell(15), bell(4)], [1.0, 2.0, 3.0]), ("b", ["x"], [bell(9)], [1.0]), ("c", None, None, None), ("d", [], [], [])]
    df = spark.createDataFrame(rows, "k string, ions array<string>, curves array<array<double>>, scores array<double>")
    got = {r.k: r for r in I.strict_shapes(df, 0.9).collect()}
    assert got["a"].kept == ["x", "y"] and got["a"].strict and got["b"].kept == ["x"] and not got["b"].strict and got["c"].kept == got["d"].kept == []
    best = {r.k: (r.chosen, r.total) for r in I.best_ions(df, 2, weight=10.0).collect()}
    assert best["a"] == (["x", "y"], pytest.approx(13.0)) and best["b"] == ([], None) == best["c"]
    assert {r.k: r.chosen for r in I.best_ions(df, 2, weight=0.0).collect()}["a"] == ["y", "z"]
    assert {r.k: r.chosen for r in I.best_ions(df, 2, weight=0.0, fixed=1).collect()}["a"] == ["x", "z"]
    curves = spark.createDataFrame([("p", t.tolist(), bell(15)), ("flat", t.tolist(), [5.0] * 30), ("none", None, None), ("short", [1.0, 2.0], [1.0, 2.0]), ("gap", t.tolist(), [None, *bell(15)[1:]])], "k string, rt array<double>, intensity array<double>")
    fit = {r.k: r for r in I.elution_fits(curves).collect()}
    assert fit["p"].elution > 0.999 and fit["gap"].elution > 0.999 and all(fit[k].time is None and fit[k].elution == 0 for k in ("flat", "none", "short"))
    points = spark.createDataFrame([("a", ion, float(i), y) for ion, z in (("u", 5), ("v", 9)) for i, y in enumerate(bell(z))], "k string, ion string, rt double, intensity double")
    (one,) = I.as_curves(points, ["k"]).collect()
    assert one.ions == ["u", "v"] and one.curves[1] == bell(9) and one.rt == t.tolist()
