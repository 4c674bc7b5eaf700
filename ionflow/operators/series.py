"""Kernels over series: fixed-weight smoothing, local maxima, noise, Gaussian smoothing, peaks, cross-correlation.

Column versions work on rows with a window per series; array versions are NumPy functions that
run per series in ``applyInPandas``, for what no window expression says.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weights(kind: str, points: int) -> list[float]:
    """Weights by distance from the centre, rounded to nine digits: linear (triangle), gauss (sigma a quarter of the span), savitzky_golay (quadratic)."""
    m = (points - 1) // 2
    if kind == "linear":
        w = [(m + 1 - j) / (m + 1) ** 2 for j in range(m + 1)]
    elif kind == "gauss":
        raw = [math.exp(-((j / (m / 2)) ** 2) / 2) for j in range(m + 1)]
        w = [x / (2 * sum(raw) - raw[0]) for x in raw]
    elif kind == "savitzky_golay":
        w = [3 * (3 * m * m + 3 * m - 1 - 5 * j * j) / ((2 * m + 3) * (2 * m + 1) * (2 * m - 1)) for j in range(m + 1)]
    else:
        raise ValueError(kind)
    return [round(x, 9) for x in w]


def smooth(df: DataFrame, keys: list[str], order: str, value: str, kind: str, points: int, out: str = "smooth") -> DataFrame:
    """Weighted sum of the neighbours; what lies beyond the ends counts as zero and weights are not scaled up."""
    w = Window.partitionBy(*keys).orderBy(order)
    total: Column = F.lit(0.0)
    for j, x in enumerate(weights(kind, points)):
        total = total + (x * F.col(value) if j == 0 else x * (F.coalesce(F.lag(value, j).over(w), F.lit(0.0)) + F.coalesce(F.lead(value, j).over(w), F.lit(0.0))))
    return df.withColumn(out, total)


def local_maxima(df: DataFrame, keys: list[str], order: str, value: str, least: float = 1e-6) -> DataFrame:
    """Rows above both neighbours, where both neighbours are there and at least ``least``."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    marked = df.withColumn("_max", (F.col(value) > before) & (F.col(value) > after) & (before >= least) & (after >= least))
    return marked.where("_max").drop("_max")


# Arrays -----------------------------------------------------------------------------------------


def signal_to_noise(rt: np.ndarray, y: np.ndarray, window: float = 1000.0, bins: int = 30, enough: int = 10, sparse: float = 2.0) -> np.ndarray:
    """Intensity over the median histogram bin of the closed window around each point."""
    size = max(1.0, (y.mean() + 3 * y.std()) / bins)
    slot = np.minimum((y / size).astype(int), bins - 1)
    left, right = np.searchsorted(rt, rt - window / 2, "left"), np.searchsorted(rt, rt + window / 2, "right")
    upto = np.zeros((len(y) + 1, bins), int)
    np.add.at(upto[1:], (np.arange(len(y)), slot), 1)
    upto = upto.cumsum(axis=0)
    inside = upto[right] - upto[left]
    n = right - left
    median = (inside.cumsum(axis=1) >= ((n + 1) // 2)[:, None]).argmax(axis=1)
    noise = np.where(n < enough, sparse, np.maximum(1.0, (median + 0.5) * size))
    return y / noise


def denoise(y: np.ndarray, sn: np.ndarray) -> np.ndarray:
    return y * sn / (sn + 1)


def gauss_filter(x: np.ndarray, y: np.ndarray, sigma: float = 6.25, spacing: float = 0.01) -> np.ndarray:
    """Gaussian smoothing of an uneven grid: trapezoids over kernel weights interpolated on a fine grid."""
    half = int(math.ceil(4 * sigma / spacing)) + 1
    grid = np.exp(-((np.arange(half) * spacing) ** 2) / (2 * sigma * sigma))
    reach = (half - 1) * spacing
    out = np.zeros(len(y))
    for i in range(len(x)):
        lo, hi = np.searchsorted(x, x[i] - reach, "right"), np.searchsorted(x, x[i] + reach, "left")
        d = np.abs(x[lo:hi] - x[i]) / spacing
        at = np.minimum(d.astype(int), half - 2)
        k = grid[at] + (d - at) * (grid[at + 1] - grid[at])
        if hi - lo == 1:
            out[i] = y[lo]
            continue
        dx = np.diff(x[lo:hi])
        norm = (dx * (k[1:] + k[:-1]) / 2).sum()
        out[i] = (dx * (k[1:] * y[lo + 1 : hi] + k[:-1] * y[lo : hi - 1]) / 2).sum() / norm if norm > 0 else 0.0
    return out


def natural_spline(x: np.ndarray, y: np.ndarray):
    """Coefficients (y, b, c, d) of the natural cubic spline through the points."""
    n, h = len(x) - 1, np.diff(x)
    slope = np.diff(y) / h
    c, left, right = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)  # two sweeps over the tridiagonal system
    for i in range(1, n):
        pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * left[i - 1]
        left[i], right[i] = h[i] / pivot, (3 * (slope[i] - slope[i - 1]) - h[i - 1] * right[i - 1]) / pivot
    for i in range(n - 1, 0, -1):
        c[i] = right[i] - left[i] * c[i + 1]
    return y[:-1], np.diff(y) / h - h * (2 * c[:-1] + c[1:]) / 3, c[:-1], np.diff(c) / (3 * h)


def pick_peaks(x: np.ndarray, y: np.ndarray, least: float = 1e-6, missing: int = 1) -> list[dict]:
    """Local maxima with descending flanks (``missing`` rises allowed), the apex refined on a spline by bisecting its slope; picking goes on past a peak's right end."""
    peaks, i = [], 1
    while i < len(x) - 1:
        if not (y[i] > y[i - 1] and y[i] > y[i + 1] and y[i - 1] >= least and y[i + 1] >= least):
            i += 1
            continue
        left, right = i - 1, i + 1
        gap = 0
        while left > 0 and y[left - 1] > 0:
            if y[left - 1] > y[left]:
                gap += 1
                if gap > missing or y[left - 1] > y[i]:
                    break
            left -= 1
        gap = 0
        while right < len(x) - 1 and y[right + 1] > 0:
            if y[right + 1] > y[right]:
                gap += 1
                if gap > missing or y[right + 1] > y[i]:
                    break
            right += 1
        lo, hi = max(0, left), min(len(x), right + 1)
        v, b, c, d = natural_spline(x[lo:hi], y[lo:hi])
        start, end = x[i - 1], x[i + 1]
        k = lambda t: min(max(int(np.searchsorted(x[lo:hi], t, "right")) - 1, 0), len(b) - 1)  # noqa: B023, E731
        for _ in range(60):
            mid = (start + end) / 2
            s = mid - x[lo + k(mid)]
            if b[k(mid)] + 2 * c[k(mid)] * s + 3 * d[k(mid)] * s * s > 0:
                start = mid
            else:
                end = mid
        apex = (start + end) / 2
        s = apex - x[lo + k(apex)]
        peaks.append({"apex": apex, "height": v[k(apex)] + b[k(apex)] * s + c[k(apex)] * s**2 + d[k(apex)] * s**3, "left": x[left], "right": x[right], "index": i})
        i = right + 1
    return peaks


def integrate(x: np.ndarray, y: np.ndarray, apex: int, width: float = 5.0) -> tuple[int, int, float]:
    """Borders that go on while the curve falls or the apex is within ``width``, and the sum between them."""
    left, right = apex, apex
    while left > 0 and (y[left - 1] < y[left] or abs(x[left - 1] - x[apex]) < width):
        left -= 1
    while right < len(x) - 1 and (y[right + 1] < y[right] or abs(x[right + 1] - x[apex]) < width):
        right += 1
    return left, right, float(y[left : right + 1].sum())


def moments(y: np.ndarray) -> dict[str, float]:
    """Sum, mean, population variance and standard deviation of the numbers that are there; zeros if none is."""
    y = y[~np.isnan(y)]
    return {"sum": float(y.sum()), "mean": float(y.mean()), "variance": float(y.var()), "sd": float(y.std())} if len(y) else dict.fromkeys(("sum", "mean", "variance", "sd"), 0.0)


def first_at_least(x: np.ndarray, target: float) -> int:
    """Index of the first of ascending numbers that is not below ``target``; -1 if there is none."""
    i = int(np.searchsorted(x, target, "left"))
    return i if i < len(x) else -1


def around(x: np.ndarray, low: float, high: float) -> tuple[int, int]:
    """Indexes of the first and last of ascending numbers in [low, high]; (-1, -1) if none lies there."""
    a, b = int(np.searchsorted(x, low, "left")), int(np.searchsorted(x, high, "right")) - 1
    return (a, b) if a <= b else (-1, -1)


def adaptive_sum(mz: np.ndarray, y: np.ndarray, target: float, reach: float = 0.01) -> float:
    """Intensity of the peak nearest to ``target``, within ``reach``: its flanks go on while they fall and gaps stay under twice the peak's own."""
    if not len(mz):
        return 0.0
    k = int(np.abs(mz - target).argmin())
    if abs(mz[k] - target) > reach:
        return 0.0
    last = len(mz) - 1
    left, right = max(k - 1, 0), min(k + 1, last)
    pace = 2 * min(mz[k] - mz[left], mz[right] - mz[k])
    while left > 0 and mz[left] - mz[left - 1] < pace and y[left] > y[left - 1]:
        left -= 1
    while right < last and mz[right + 1] - mz[right] < pace and y[right] > y[right + 1]:
        right += 1
    return float(y[left : right + 1].sum())


def standardise(y: np.ndarray) -> np.ndarray:
    sd = y.std()
    return (y - y.mean()) / sd if sd > 0 else np.zeros(len(y))


def cross_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at lags -(n - 1) to n - 1."""
    return np.correlate(standardise(a), standardise(b), "full") / len(a)


def shape_scores(curves: list[np.ndarray], library: np.ndarray) -> dict[str, float]:
    """Mean and library-weighted peak correlation, and coelution from the lags of the peaks, over all pairs i <= j."""
    w = library / library.sum()
    best, lag, weight = [], [], []
    for i in range(len(curves)):
        for j in range(i, len(curves)):
            r = cross_correlation(curves[i], curves[j])
            k = int(r.argmax())
            best.append(r[k])
            lag.append(abs(k - (len(curves[i]) - 1)))
            weight.append(w[i] * w[j] * (1 if i == j else 2))
    lag, weight, best = np.array(lag, float), np.array(weight), np.array(best)
    sd = lag.std(ddof=1) if len(lag) > 1 else 0.0
    return {"shape": best.mean(), "shape_weighted": (best * weight).sum(), "coelution": lag.mean() + sd, "coelution_weighted": (lag * weight).sum()}


def per_series(df: DataFrame, keys: list[str], order: str, value: str, kernel, schema: str) -> DataFrame:
    """Run ``kernel(x, y) -> dict of columns`` on every series; a series is one key's rows in order."""
    import pandas as pd

    fields = [f.split()[0] for f in schema.split(",")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = pd.DataFrame(kernel(pdf[order].to_numpy(float), pdf[value].to_numpy(float)))
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        return out[fields] if len(out) else pd.DataFrame(columns=fields)

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


def shape_of_pairs(df: DataFrame, keys: list[str], name: str, order: str, value: str) -> DataFrame:
    """``shape_scores`` of the curves ``name`` of each key with equal weights, on the key's points of any curve (0 where a curve has none).

    Each pair of curves is a row of its own, so pairs spread over the tasks; a curve is one array.
    """
    points = df.select(*keys, order).distinct().join(df.select(*keys, name).distinct(), keys).join(df.select(*keys, name, order, value), [*keys, name, order], "left")
    filled = points.select(*keys, name, F.struct(F.col(order), F.coalesce(F.col(value), F.lit(0.0)).alias("v")).alias("p"))
    curves = filled.groupBy(*keys, name).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]).alias("curve"))
    other = curves.select(*keys, F.col(name).alias("_other"), F.col("curve").alias("_curve"))
    pairs = curves.join(other, keys).where(F.col(name) <= F.col("_other"))

    @F.pandas_udf("struct<best:double,lag:double>")
    def correlate(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b, strict=True):
            r = np.round(cross_correlation(np.asarray(x, float), np.asarray(y, float)), 9)
            out.append((r.max(), abs(int(r.argmax()) - (len(x) - 1))))
        return pd.DataFrame(out, columns=["best", "lag"])

    count = curves.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = pairs.withColumn("c", correlate("curve", "_curve")).join(count, keys).withColumn("w", F.when(F.col(name) == F.col("_other"), 1.0).otherwise(2.0) / (F.col("_n") * F.col("_n")))
    best, lag = F.col("c.best"), F.col("c.lag")
    return found.groupBy(*keys).agg(F.avg(best).alias("shape"), F.sum(best * F.col("w")).alias("shape_weighted"), (F.avg(lag) + F.coalesce(F.stddev_samp(lag), F.lit(0.0))).alias("coelution"), F.sum(lag * F.col("w")).alias("coelution_weighted"))
