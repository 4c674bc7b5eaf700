"""Queries that SQL can't express, against slow versions of their own making."""

import os
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from ionflow import catalog
from ionflow.operators import series

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def dense_spline(x, y):
    """Second derivatives of the natural cubic spline, from the whole linear system."""
    n, h = len(x), np.diff(x)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)

    def value(t):
        k = min(max(int(np.sum(x <= t)) - 1, 0), n - 2)
        u, v = x[k + 1] - t, t - x[k]
        return (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v

    return value


def flank(y, top, step):
    """Where a flank ends: at a zero, at the end, or at the second rise; a rise over the top ends it at once."""
    at, rises = top + step, 0
    while 0 < at < len(y) - 1 and y[at + step] > 0:
        if y[at + step] > y[at]:
            rises += 1
            if rises > 1 or y[at + step] > y[top]:
                break
        at += step
    return at


def plain_peaks(x, y):
    out, i = [], 1
    while i < len(x) - 1:
        if min(y[i] - y[i - 1], y[i] - y[i + 1]) > 0 and min(y[i - 1], y[i + 1]) >= 1e-6:
            left, right = flank(y, i, -1), flank(y, i, 1)
            f = dense_spline(x[left : right + 1], y[left : right + 1])
            low, high = x[i - 1], x[i + 1]
            for _ in range(3):
                grid = np.linspace(low, high, 101)
                apex = grid[int(np.argmax([f(t) for t in grid]))]
                low, high = apex - (grid[1] - grid[0]), apex + (grid[1] - grid[0])
            out.append((apex, f(apex), i))
            i = right
        i += 1
    return out


def around(x, y, top):
    """Sum of the peak: points are taken while they fall, or lie within 5 of the top."""
    lo = hi = top
    while lo > 0 and (y[lo - 1] < y[lo] or x[top] - x[lo - 1] < 5):
        lo -= 1
    while hi < len(x) - 1 and (y[hi + 1] < y[hi] or x[hi + 1] - x[top] < 5):
        hi += 1
    return x[lo], x[hi], float(np.sum(y[lo : hi + 1]))


def test_peak_pick(spark):
    rows = duckdb.sql(f"SELECT event_type, date_diff('hour', TIMESTAMP '1970-01-01', ts) AS hour, sum(floor(value * 100 + 0.5)) / 100 AS v FROM '{SF}/events.parquet' GROUP BY 1, 2").fetchall()
    by = defaultdict(list)
    for kind, hour, v in rows:
        by[kind].append((float(hour), float(v)))
    want = []
    for kind, points in by.items():
        x, y = (np.array(c) for c in zip(*sorted(points), strict=True))
        smooth = series.gauss_filter(x, y)  # held by an oracle of its own
        want += [(kind, apex, height, *around(x, y, i)) for apex, height, i in plain_peaks(x, smooth)]
    got = [tuple(r) for r in catalog.QUERIES["peak_pick"](spark, SF).select("event_type", "apex", "height", "start", "stop", "total").collect()]
    assert len(got) == len(want) > 20
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=0.02) and a[2] == pytest.approx(b[2], rel=1e-4) and a[3:5] == b[3:5] and a[5] == pytest.approx(b[5])


def huber(x, y, delta):
    """Line of the least Huber loss: a ternary search for the intercept inside one for the slope."""

    def loss(k, b):
        r = np.abs(y - k * x - b)
        return np.sum(np.where(r <= delta, r * r / 2, delta * (r - delta / 2)))

    def least(f, lo, hi, rounds):
        for _ in range(rounds):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (lo, b) if f(a) <= f(b) else (a, hi)
        return (lo + hi) / 2

    wide = 4 * (np.abs(y).max() + 1)
    intercept = lambda k: least(lambda b: loss(k, b), -wide, wide, 62)
    k = least(lambda k: loss(k, intercept(k)), -10.0, 10.0, 46)
    return k, intercept(k)


def test_robust_fit(spark):
    rows = duckdb.sql(f"SELECT l_returnflag, l_quantity, avg(l_extendedprice) / 1000 FROM '{SF}/lineitem.parquet' GROUP BY 1, 2").fetchall()
    got = {r["l_returnflag"]: r for r in catalog.QUERIES["robust_fit"](spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    for flag, r in got.items():
        x, y = (np.array(c, float) for c in zip(*[(q, p) for f, q, p in rows if f == flag], strict=True))
        delta = (y.max() - y.min()) / 30
        a, b = int(np.argmin(x * y)), int(np.argmax(x * y))
        far = np.abs(y - (y[a] + (y[b] - y[a]) / (x[b] - x[a]) * (x - x[a]))) > 50
        x, y = x[~far], y[~far]
        while True:
            k, c = huber(x, y, delta)
            r2 = np.corrcoef(x, y)[0, 1] ** 2
            if r2 >= 0.95 or len(x) <= 3:
                break
            worst = int(np.argmax(np.abs(y - k * x - c)))
            x, y = np.delete(x, worst), np.delete(y, worst)
        assert (r.slope, r.intercept) == (pytest.approx(k, abs=1e-5), pytest.approx(c, abs=1e-3)) and r.selected == len(x) and r.r2 == pytest.approx(r2)
