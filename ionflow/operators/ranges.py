"""Interval joins as equi-joins over bins; Spark has no range join of its own.

Windows are put into every bin that they touch and points into the one they lie in, so a join on
the bin finds each pair once or not at all and the interval test stays as residual filter. The
windows are exploded, never the points. ``width`` should be about the windows' width.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionflow.operators import ordered
from ionflow.operators.settle import settle


def _bin(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("long")


def interval_join(points: DataFrame, windows: DataFrame, point: str, low: str, high: str, width: float, on: list[str] | None = None, closed: str = "left", how: str = "inner") -> DataFrame:
    """Points with the windows that hold them; ``closed``: left [low, high), both [low, high], right (low, high] or neither."""
    if closed not in ("left", "right", "both", "neither"):
        raise ValueError(closed)
    p = points.withColumn("_bin", _bin(F.col(point), width))
    w = windows.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(_bin(F.col(low), width), _bin(F.col(high), width))))
    joined = p.join(w, ["_bin", *(on or [])], how)
    above = F.col(point) >= F.col(low) if closed in ("left", "both") else F.col(point) > F.col(low)
    below = F.col(point) <= F.col(high) if closed in ("right", "both") else F.col(point) < F.col(high)
    return joined.where(above & below).drop("_bin")


def band_pairs(df: DataFrame, value: str, band: float, key: str, on: list[str] | None = None, suffix: str = "_b") -> DataFrame:
    """Pairs (key < key of the partner) whose values differ by at most ``band``: one side goes into its own bin and both neighbours."""
    names = {c: c + suffix for c in df.columns if c not in (on or [])}
    left = df.withColumn("_bin", _bin(F.col(value), band))
    right = df.select(*(on or []), *[F.col(c).alias(n) for c, n in names.items()])
    right = right.withColumn("_bin", F.explode(F.array(*[_bin(F.col(names[value]), band) + d for d in (-1, 0, 1)])))
    joined = left.join(right, ["_bin", *(on or [])])
    return joined.where((F.col(key) < F.col(names[key])) & (F.abs(F.col(value) - F.col(names[value])) <= band)).drop("_bin")


def _farthest(band: float):
    """Column function: the largest double whose difference to a value, as doubles subtract, is at most ``band``."""

    def order(bits: np.ndarray) -> np.ndarray:
        """Whole numbers in the order of the doubles with these bits, and back."""
        return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))

    @F.pandas_udf("double")
    def farthest(values: pd.Series) -> pd.Series:
        v = np.ascontiguousarray(values, np.float64)
        low, high = order(v.view(np.int64)), np.full(len(v), order(np.float64(np.inf).view(np.int64)))
        with np.errstate(over="ignore"):
            for _ in range(64):
                mid = (low >> 1) + (high >> 1) + (low & high & 1)
                within = order(mid).view(np.float64) - v <= band
                low, high = np.where(within, mid, low), np.where(within, high, mid)
        return pd.Series(order(low).view(np.float64))

    return farthest


def _band_totals(df: DataFrame, value: str, bands: dict[str, float], on: list[str]) -> DataFrame:
    """Pairs of rows by values of ``on``, whatever their keys: what lies up to a value's farthest partner, less what lies up to the value."""
    zero, extra = F.lit(0).cast("long"), [f"_w{i}" for i in range(len(bands))]
    values = df.groupBy(*on, F.col(value).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    places = [F.struct("_at", "_n", *[zero.alias(w) for w in extra])]
    for w, band in zip(extra, bands.values(), strict=True):
        places.append(F.struct(_farthest(band)("_at").alias("_at"), zero.alias("_n"), *[(F.col("_n") if w == x else zero).alias(x) for x in extra]))
    places = values.select(*on, F.explode(F.array(*places)).alias("_p")).select(*on, "_p.*")
    places = settle(places.groupBy(*on, "_at").agg(*[F.sum(c).alias(c) for c in ("_n", *extra)]))
    run = ordered.running(places, "_at", {"_upto": ("sum", "_n")}, keys=on, settled=True)
    below = F.expr("sum(_n * _upto - _n * (_n - 1) div 2)")  # of equal values each pair stays once
    return run.groupBy(*on).agg(*[(F.expr(f"sum({w} * _upto)") - below).alias(name) for w, name in zip(extra, bands, strict=True)])


def band_counts(df: DataFrame, value: str, bands: dict[str, float], key: str, on: list[str]) -> DataFrame:
    """How many pairs ``band_pairs`` would give for each values of ``on``, without forming any; ``bands``: new column -> band.

    Counted are all pairs by running sums over the distinct values, less those of rows that share a key.
    """
    number = F.col(value).cast("double")
    known = [F.col(c).isNotNull() for c in (*on, key)] + [F.abs(number) < float("inf")]
    rows = df.where(functools.reduce(Column.__and__, known)).select(*on, key, number.alias(value))
    repeated = rows.join(rows.groupBy(*on, key).count().where("count > 1").drop("count"), [*on, key], "left_semi")
    totals = _band_totals(rows, value, bands, on)
    if repeated.isEmpty():
        return totals
    same = _band_totals(repeated, value, bands, [*on, key]).groupBy(*on).agg(*[F.sum(c).alias(f"_{c}") for c in bands])
    return totals.join(same, on, "left").select(*on, *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in bands])


def nearest(marks: DataFrame, events: DataFrame, mark: str, at: str, span: float, on: list[str], order: list[str]) -> DataFrame:
    """For each mark and group the nearest event at most ``span`` away; ties by ``order``. Times are numbers."""
    bounds = marks.withColumn("_low", F.col(mark) - span).withColumn("_high", F.col(mark) + span)
    pairs = interval_join(events, bounds, at, "_low", "_high", span, closed="both")
    rest = [c for c in pairs.columns if c not in (*on, mark, "_low", "_high")]
    best = pairs.groupBy(mark, *on).agg(F.min(F.struct(F.abs(F.col(at) - F.col(mark)).alias("_distance"), *[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])).alias("_best"))
    return best.select(mark, *on, *[F.col(f"_best.{c}").alias(c) for c in rest])


def window_sums(points: DataFrame, windows: DataFrame, point: str, low: str, high: str, columns: list[str], on: list[str] | None = None, closed: str = "both") -> DataFrame:
    """Each window with the sums of ``columns`` over the points in [low, high] (closed both) or (low, high) (neither) of its values of ``on`` (not null), without forming pairs: differences of running sums.

    Windows in which no point lies have sums of zero; sums are exact for whole numbers.
    """
    if closed not in ("both", "neither"):
        raise ValueError(closed)
    on = list(on or [])
    windows = windows.where(F.col(low) <= F.col(high) if closed == "both" else F.col(low) < F.col(high))
    at = points.where(F.col(point).isNotNull()).select(*on, F.col(point).alias("_at"), *columns)
    for bound in (low, high):
        at = at.unionByName(windows.select(*on, F.col(bound).alias("_at"), *[F.lit(0).cast("long").alias(c) for c in columns]))
    values = settle(at.groupBy(*on, "_at").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]))
    run = settle(ordered.running(values, "_at", {f"_to_{c}": ("sum", c) for c in columns}, keys=on, settled=True))
    before = lambda c: F.col(f"_to_{c}") - F.col(c)
    below = run.select(*on, F.col("_at").alias(low), *[(before(c) if closed == "both" else F.col(f"_to_{c}")).alias(f"_below_{c}") for c in columns])
    upto = run.select(*on, F.col("_at").alias(high), *[(F.col(f"_to_{c}") if closed == "both" else before(c)).alias(f"_to_{c}") for c in columns])
    return windows.join(below, [*on, low]).join(upto, [*on, high]).select(*windows.columns, *[(F.col(f"_to_{c}") - F.col(f"_below_{c}")).alias(c) for c in columns])


def nearest_of_all(marks: DataFrame, events: DataFrame, mark: str, at: str, step: int, on: list[str], order: list[str]) -> DataFrame:
    """For each mark and group the nearest event, however far; ties by ``order``. Marks are multiples of ``step``.

    Events are cut down to the first and last of each step, so the windows run over steps and not over events.
    """
    rest = [c for c in events.columns if c not in (*on, at)]
    body = [F.col(c) for c in (at, *[c for c in order if c != at], *[c for c in rest if c not in order])]
    e = events.where(F.col(at).isNotNull()).withColumn("_step", F.floor(F.col(at) / F.lit(step)).cast("long"))
    ends = e.groupBy(*on, "_step").agg(F.min(F.struct(*body)).alias("_first"), F.min(F.struct((-F.col(at)).alias("_back"), *body)).alias("_last"))
    ends = ends.withColumn("_last", F.struct(*[F.col("_last")[f.name].alias(f.name) for f in ends.schema["_first"].dataType.fields]))
    grid = ends.select(*on).distinct().crossJoin(marks.select(mark)).withColumn("_step", F.floor(F.col(mark) / F.lit(step)).cast("long"))
    both = ends.unionByName(grid, allowMissingColumns=True).groupBy(*on, "_step").agg(F.max(mark).alias(mark), F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    w = Window.partitionBy(*on)
    before = F.last("_last", True).over(w.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_first", True).over(w.orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, 0))
    found = both.select(*on, mark, before.alias("_before"), after.alias("_after")).where(F.col(mark).isNotNull())
    far = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.{at}") - F.col(mark)).alias("_distance"), F.col(c).alias("_event"))) for c in ("_before", "_after")]
    return found.withColumn("_best", F.least(*far)).select(mark, *on, *[F.col(f"_best._event.{c}").alias(c) for c in (at, *rest)])
