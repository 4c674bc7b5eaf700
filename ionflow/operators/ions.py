"""Choice of ions by their curves, and fits of elution curves, over rows that hold the curves as arrays.

``strict_shapes`` removes ions from a group until those left rise and fall together; ``best_ions``
chooses the subset of a fixed size with the largest sum of its own and its pairs' scores;
``elution_fits`` fits exponentially modified Gaussians, all rows of a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _mapped(df: DataFrame, columns: list[str], more: str, of_row, kinds: dict[str, pa.DataType]) -> DataFrame:
    """``df`` with what ``of_row`` makes of ``columns`` in each row."""
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [of_row(*values) for values in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            new = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *kinds])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(more).fields]))


# Shapes -------------------------------------------------------------------------------------------


def correlations(curves: np.ndarray) -> np.ndarray:
    """Pearson correlation of every two curves; 0 with a flat one, 1 with itself."""
    c = curves - curves.mean(axis=1, keepdims=True)
    norm = np.sqrt((c * c).sum(axis=1))
    c = np.divide(c, norm[:, None], out=np.zeros_like(c), where=norm[:, None] > 0)
    out = c @ c.T
    np.fill_diagonal(out, 1.0)
    return out


def strict(matrix: np.ndarray, threshold: float, least: int = 2) -> tuple[list[int], float]:
    """(ions kept, mean correlation of their pairs): the ion that fits the others worst goes, again and again, until the mean reaches ``threshold`` or ``least`` ions are left.

    The sums of the matrix are taken down by what the ion had in them and never made anew.
    """
    left = list(range(len(matrix)))
    sums = matrix.sum(axis=1) - np.diag(matrix)
    total = float(sums.sum())
    mean = lambda: total / (len(left) * (len(left) - 1)) if len(left) > 1 else 0.0
    while len(left) > max(least, 2) and mean() < threshold:
        worst = min(left, key=lambda i: (sums[i], i))
        left.remove(worst)
        total -= 2 * float(sums[worst])
        sums = sums - matrix[worst]
    return left, mean()


def strict_shapes(df: DataFrame, threshold: float, ions: str = "ions", curves: str = "curves", least: int = 2) -> DataFrame:
    """``df`` with ``kept`` (ions), ``shape`` (their mean correlation) and ``strict`` (whether that reaches the threshold).

    ``curves`` has an array per ion, all of one length. Rows without curves, or of one ion, keep what they have at 0.
    """

    def of_row(names, values):
        if not names or not values or len(values) < 2:
            return list(names or []), 0.0, False
        left, score = strict(correlations(np.array(values, float)), threshold, least)
        return [names[i] for i in left], score, score >= threshold

    return _mapped(df, [ions, curves], "kept array<string>, shape double, strict boolean", of_row, {"kept": pa.list_(pa.string()), "shape": pa.float64(), "strict": pa.bool_()})


# Subsets ------------------------------------------------------------------------------------------


def best_subset(own: np.ndarray, pairs: np.ndarray, size: int) -> tuple[list[int], float]:
    """The ``size`` items with the largest sum of their own scores and those of their pairs; of equals the first in order. Empty if there are too few.

    Branch and bound: a partial choice is given up when its sum, and the most that its best
    completions could add (each with half its best pairs among the rest), do not beat the best so far.
    """
    n = len(own)
    if size > n or size < 0:
        return [], 0.0
    both = pairs - np.diag(np.diag(pairs))
    best: tuple[float, list[int]] = (-math.inf, [])

    def descend(chosen: list[int], start: int, value: float, gain: np.ndarray) -> None:
        nonlocal best
        left = size - len(chosen)
        if not left:
            if value > best[0] + 1e-12:
                best = value, list(chosen)
            return
        rest = np.arange(start, n)
        if len(rest) < left:
            return
        among = np.sort(both[np.ix_(rest, rest)] + np.diag(np.full(len(rest), -np.inf)), axis=1)[:, ::-1][:, : left - 1]
        hopes = gain[rest] + np.where(np.isfinite(among), among, 0.0).sum(axis=1) / 2
        if value + np.sort(hopes)[::-1][:left].sum() <= best[0] + 1e-12:
            return
        for i in range(start, n - left + 1):
            descend([*chosen, i], i + 1, value + gain[i], gain + both[i])

    descend([], 0, 0.0, np.asarray(own, float))
    return best[1], best[0] if best[1] or not size else 0.0


def best_ions(df: DataFrame, size: int, ions: str = "ions", own: str = "scores", curves: str = "curves", weight: float = 1.0, fixed: int = 0) -> DataFrame:
    """``df`` with ``chosen``: the ``size`` ions whose scores and ``weight`` times pairwise correlations sum to the most, and the sum; the first ``fixed`` ions are always among them."""

    def of_row(names, scores, values):
        if not names or not values or len(names) < size:
            return [], None
        y = np.array([s or 0.0 for s in scores], float)
        y[:fixed] += 1e6
        left, total = best_subset(y, weight * correlations(np.array(values, float)), size)
        return [names[i] for i in left], total - 1e6 * min(fixed, size)

    return _mapped(df, [ions, own, curves], "chosen array<string>, total double", of_row, {"chosen": pa.list_(pa.string()), "total": pa.float64()})


# Elution ------------------------------------------------------------------------------------------


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function to seven digits (Chebyshev fit of the scaled function)."""
    # Coefficients of the fit.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    z = np.abs(x)
    t = 1 / (1 + z / 2)
    power = np.zeros_like(t)
    for c in reversed(terms):
        power = power * t + c
    y = t * np.exp(-z * z + power)
    return np.where(x >= 0, y, 2 - y)


def emg(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exponentially modified Gaussians of rows of (height, width, symmetry, time), height and widths as logarithms."""
    h, w, s = (np.exp(p[:, i : i + 1]) for i in range(3))
    d = t - p[:, 3:4]
    x = (w / s - d / w) / math.sqrt(2)
    with np.errstate(over="ignore", invalid="ignore"):
        # Left of the tail the product of a huge and a tiny number is taken as one exponential.
        left = np.exp(-(d * d) / (2 * w * w)) * _scaled(np.maximum(x, 0))
        right = np.exp(np.minimum(w * w / (2 * s * s) - d / s, 700)) * _erfc(np.minimum(x, 0))
    return h * w / s * math.sqrt(math.pi / 2) * np.where(x >= 0, left, right)


def _scaled(x: np.ndarray) -> np.ndarray:
    """exp(x^2) erfc(x) of numbers that are not negative."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        small = np.exp(np.minimum(x, 5) ** 2) * _erfc(np.minimum(x, 5))
        big = 1 / (x * math.sqrt(math.pi)) * (1 - 1 / (2 * x * x) + 3 / (4 * x**4))
    return np.where(x < 5, small, big)


def emg_fits(t: np.ndarray, y: np.ndarray, there: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(height, width, symmetry, time) of each row, and Pearson's correlation of data and model, by damped least squares over all rows at once.

    ``there`` marks the points of each row. Rows of fewer than 5 points, or flat ones, have NaN and correlation 0.
    """
    w = there.astype(float)
    n = w.sum(axis=1)
    y = np.where(there, np.maximum(y, 0), 0.0)
    area = y.sum(axis=1)
    flat = (n < 5) | (area <= 0) | (np.where(there, y, -np.inf).max(axis=1) - np.where(there, y, np.inf).min(axis=1) <= 0)
    area = np.where(flat, 1.0, area)
    mean = (y * t).sum(axis=1) / area
    d = t - mean[:, None]
    var = np.maximum((y * d * d).sum(axis=1) / area, 1e-12)
    third = (y * d**3).sum(axis=1) / area
    tail = np.clip(np.cbrt(np.maximum(third, 0) / 2), 0.3 * np.sqrt(var), 0.9 * np.sqrt(var))
    width = np.sqrt(var - tail**2)
    p = np.stack([np.log(np.maximum(y.max(axis=1), 1e-12)), np.log(width), np.log(tail), mean - tail], axis=1)
    damp, eye = np.full(len(p), 1e-2), np.eye(4)
    cost = lambda q: (w * (emg(t, q) - y) ** 2).sum(axis=1)
    now = np.nan_to_num(cost(p), nan=np.inf)
    for _ in range(rounds):
        base = emg(t, p)
        step = np.array([1e-6, 1e-6, 1e-6, 0.0]) + np.stack([np.zeros(len(p))] * 3 + [1e-6 * np.exp(p[:, 1])], axis=1)
        jacobian = np.stack([(emg(t, p + step * eye[k]) - emg(t, p - step * eye[k])) / (2 * step[:, k : k + 1]) for k in range(4)], axis=2) * w[:, :, None]
        a = np.einsum("rnk,rnl->rkl", jacobian, jacobian)
        b = np.einsum("rnk,rn->rk", jacobian, (y - base) * w)
        scale = np.maximum(np.einsum("rkk->rk", a), 1e-12)
        move = np.linalg.solve(np.nan_to_num(a + damp[:, None, None] * scale[:, :, None] * eye), np.nan_to_num(b)[:, :, None])[:, :, 0]
        new = p + np.clip(move, -np.array([1, 1, 1, np.inf]), np.array([1, 1, 1, np.inf]))
        then = np.nan_to_num(cost(new), nan=np.inf)
        good = then < now
        done = np.abs(now - then) <= 1e-14 * now
        p, now = np.where(good[:, None], new, p), np.where(good, then, now)
        damp = np.clip(np.where(good, damp / 3, damp * 4), 1e-12, 1e12)
        if (done | flat | (damp >= 1e12)).all():
            break
    model = emg(t, p)
    centred = lambda x: (x - (x * w).sum(axis=1, keepdims=True) / np.maximum(n, 1)[:, None]) * w
    u, v = centred(y), centred(model)
    norm = np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1))
    score = np.where(flat | (norm <= 0), 0.0, (u * v).sum(axis=1) / np.where(norm > 0, norm, 1))
    fitted = np.concatenate([np.exp(p[:, :3]), p[:, 3:]], axis=1)
    fitted[flat] = np.nan
    return fitted, score


def elution_fits(df: DataFrame, rt: str = "rt", intensity: str = "intensity") -> DataFrame:
    """``df`` with height, width, symmetry, time and ``elution`` (correlation of curve and model) of each row's curve; null fits and 0 for flat, short and missing curves."""
    at = [df.columns.index(c) for c in (rt, intensity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                curves = [([u for u, v in zip(x or [], y or [], strict=False) if u is not None and v is not None], [v for u, v in zip(x or [], y or [], strict=False) if u is not None and v is not None]) for x, y in zip(*(part.column(i).to_pylist() for i in at), strict=True)]
                most = max(5, *(len(x) for x, _ in curves))
                t, y, there = np.zeros((len(curves), most)), np.zeros((len(curves), most)), np.zeros((len(curves), most), bool)
                for k, (u, v) in enumerate(curves):
                    t[k, : len(u)], y[k, : len(u)], there[k, : len(u)] = u, v, True
                fitted, score = emg_fits(t, y, there)
                new = [pa.array([None if math.isnan(v) else v for v in fitted[:, k].tolist()], pa.float64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new, pa.array(score)], [*part.schema.names, "height", "width", "symmetry", "time", "elution"])

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL("height double, width double, symmetry double, time double, elution double").fields]))


def as_curves(df: DataFrame, keys: list[str], ion: str = "ion", rt: str = "rt", intensity: str = "intensity") -> DataFrame:
    """Rows of points (as ``analysis.chromatogram_view`` gives them) to one row per key: ions, curves over the same times, and the times."""
    points = df.groupBy(*keys, ion).agg(F.array_sort(F.collect_list(F.struct(rt, intensity))).alias("_p"))
    rows = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(ion).alias("ion"), "_p"))).alias("_c"))
    return rows.select(*keys, F.transform("_c", lambda c: c["ion"]).alias("ions"), F.transform("_c", lambda c: F.transform(c["_p"], lambda x: x[intensity])).alias("curves"), F.transform(F.get("_c", F.lit(0))["_p"], lambda x: x[rt]).alias("rt"))
