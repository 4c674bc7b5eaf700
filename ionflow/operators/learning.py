"""Linear scores: weighted sums, no-intercept least squares against labels, robust lines.

Training passes are aggregates: each partition adds up its part of the normal equations, so only
a matrix of the columns' number squared reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Score columns of a peak group, in order; fixed names.
SCORES = "CorrShape CorrShapeW CorrCoe CorrCoeW Pearson Dotprod IntShift Rsmd Manhattan Sangle AvgSqr NormRt IonsDelta IsoCorr IsoOverlap MassDev MassDevW LogSn Elution MS1 SELF MS1_SELF SELF_DP".split()
#: The scores of a perfect target; those not named are zero.
IDEAL = {"CorrShape": 1.0, "CorrShapeW": 1.0, "Pearson": 1.0, "Dotprod": 1.0, "IsoCorr": 1.0, "Elution": 1.0, "MS1": 1.0, "SELF": 1.0, "MS1_SELF": 1.0, "SELF_DP": 1.0, "LogSn": 5.0}
#: Columns that the discriminant leaves at weight zero.
MUTED = ("CorrShape", "CorrShapeW")


def weighted(weights: dict[str, float]) -> Column:
    """Sum of weight times score; a null score counts as zero."""
    total: Column = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(float(w)) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return total


def least_squares(df: DataFrame, columns: list[str], label: str, muted: tuple[str, ...] = MUTED) -> dict[str, float]:
    """Weights of the least-squares fit of the label without intercept; muted columns get zero."""
    found = least_squares_by(df.withColumn("_all", F.lit(0)), ["_all"], columns, label, muted).first()
    return dict(zip(columns, found["w"], strict=True)) if found else dict.fromkeys(columns, 0.0)


def least_squares_by(df: DataFrame, by: list[str], columns: list[str], label: str, muted: tuple[str, ...] = MUTED) -> DataFrame:
    """(by..., w array<double>): ``least_squares`` of each group (a run), in the order of ``columns``.

    One aggregate adds up the normal equations of all groups; each group's row is solved where it lies.
    """
    used = [c for c in columns if c not in muted]
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in used}
    pairs = [(i, j) for i in range(len(used)) for j in range(i, len(used))]
    sums = [*[F.sum(x[used[i]] * x[used[j]]) for i, j in pairs], *[F.sum(x[a] * F.col(label)) for a in used]]
    names = [f"_s{i}" for i in range(len(sums))]
    rows = df.groupBy(*by).agg(*[s.alias(n) for s, n in zip(sums, names, strict=True)])
    rows = rows.select(*by, F.array(*[F.coalesce(n, F.lit(0.0)) for n in names]).alias("w"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.column(len(by)).to_pylist():
                m, w = np.zeros((len(used), len(used))), np.zeros(len(columns))
                for (i, j), v in zip(pairs, s, strict=False):
                    m[i, j] = m[j, i] = v
                w[[columns.index(c) for c in used]] = np.linalg.pinv(m) @ np.array(s[len(pairs) :])
                out.append(w.tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=b.schema.names)

    return rows.mapInArrow(solve, rows.schema)


def weight_table(spark: SparkSession, by: list[str], weights: dict[tuple, dict[str, float]], columns: list[str], types: dict[str, str]) -> DataFrame:
    """Weights by hand as a table of ``least_squares_by``."""
    return spark.createDataFrame([(*k, [float(w[c]) for c in columns]) for k, w in weights.items()], ", ".join([*(f"`{k}` {types[k]}" for k in by), "w array<double>"]))


def with_total(df: DataFrame, by: list[str], weights: DataFrame | dict[tuple, dict[str, float]], columns: list[str], name: str) -> DataFrame:
    """``df`` with the weighted sum of each row under its group's weights; rows of groups without weights go."""
    if isinstance(weights, dict):
        weights = weight_table(df.sparkSession, by, weights, columns, dict(df.dtypes))
    scores = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    total = F.aggregate(F.zip_with(scores, "_w", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return df.join(weights.withColumnRenamed("w", "_w"), by).withColumn(name, total).drop("_w")


def training_rows(top: DataFrame, by: list[str], decoy: str, total: str, fdr: float, small: DataFrame) -> DataFrame:
    """Of the best rows per peptide all decoys (label 0) and the targets from a cutoff on (label 1), run by run.

    The cutoff is the score whose q-value lies nearest to ``fdr`` (0.02 at most in the runs of
    ``small``); under 100 targets it is the middle between the best decoy and the best target, none
    of them below zero.
    """
    from ionflow.operators.fdr import levels_by, rates_by

    value = F.col(total).cast("double")
    rates = rates_by(levels_by(top, by, total, decoy), by)
    few = small.select(*by, F.lit(min(fdr, 0.02)).alias("_rate"))
    near = rates.join(few, by, "left").withColumn("_rate", F.coalesce("_rate", F.lit(fdr)))
    near = near.groupBy(*by).agg(F.min_by("score", F.struct(F.abs(F.col("q_value") - F.col("_rate")).alias("d"), F.col("score").alias("s"))).alias("cut"))
    best = lambda kind: F.greatest(F.max(F.when(kind, value)), F.lit(0.0))
    tops = top.groupBy(*by).agg(F.sum(F.when(F.col(decoy), 0).otherwise(1)).alias("n"), ((best(F.col(decoy)) + best(~F.col(decoy))) / 2).alias("middle"))
    cuts = tops.join(near, by, "left").select(*by, F.when(F.col("n") < 100, F.col("middle")).otherwise(F.col("cut")).alias("cut"))
    rows = top.join(cuts, by).where(F.col(decoy) | (value >= F.col("cut")))
    return rows.drop("cut").withColumn("label", F.when(F.col(decoy), 0.0).otherwise(1.0))


def small_runs(df: DataFrame, by: list[str], group: str, decoy: str) -> DataFrame:
    """Runs of under 500 peptides and decoys."""
    return df.select(*by, group, decoy).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n < 500").select(*by)


def split(df: DataFrame, by: list[str], group: str, decoy: str, share: float, seed: int = 7) -> DataFrame:
    """The rows of ``share`` of each run's peptides and of its decoys, rounded up: the first ones in the order of a hash."""
    each = df.select(*by, group, decoy).distinct()
    kind = Window.partitionBy(*by, decoy)  # a run has as many peptides as the library
    ranked = each.withColumns({"_k": F.row_number().over(kind.orderBy(F.xxhash64(group, F.lit(seed)), group)), "_n": F.count(F.lit(1)).over(kind)})
    return df.join(ranked.where(F.col("_k") <= F.ceil(F.col("_n") * share)).select(*by, group, decoy), [*by, group, decoy], "left_semi")


def train(df: DataFrame, by: list[str], group: str, columns: list[str], decoy: str, first: str = "Dotprod", iterations: int = 20, blend: float = 0.8, fdr: float = 0.05, muted: tuple[str, ...] = MUTED, share: float = 1.0) -> DataFrame:
    """(by..., w): semi-supervised weights of each run in ``by``, as if it were alone: best rows per group, decoys against targets over a cutoff.

    The first weights set all decoys (best by ``first``) against one ideal target; the next round's
    replace them, and from then on new weights are blended with the last ones. A run with under 500
    peptides and decoys makes 10 rounds at most; see ``training_rows`` for the cutoffs. Weights are
    a table of one row per run in every round; nothing of them passes through the driver. With a
    ``share`` under 1 only so many of the peptides and decoys train (see ``split``).
    """
    from ionflow.operators.groups import best
    from ionflow.operators.settle import cut, drop, settle

    df = settle(df if share >= 1 else split(df, by, group, decoy, share))
    ideal = df.select(*by).distinct().select(*by, *[F.lit(IDEAL.get(c, 0.0)).alias(c) for c in columns], F.lit(1.0).alias("label"))
    decoys = best(df.where(F.col(decoy)), [*by, group], first, [F.col(columns[0])], columns).select(*by, *columns).withColumn("label", F.lit(0.0))
    weights = cut(least_squares_by(decoys.unionByName(ideal), by, columns, "label", muted))
    small = cut(small_runs(df, by, group, decoy))
    for turn in range(iterations):
        top = cut(best(with_total(df, by, weights, columns, "_total"), [*by, group, decoy], "_total", [F.col(columns[0])], [*columns, "_total"]))
        new = least_squares_by(training_rows(top, by, decoy, "_total", fdr, small), by, columns, "label", muted).withColumnRenamed("w", "_new")
        if turn >= 10:
            new = new.join(small, by, "left_anti")
        mixed = F.col("_new") if turn == 0 else F.zip_with("_new", "w", lambda a, b: blend * a + (1 - blend) * b)
        last, weights = weights, cut(weights.join(new, by, "left").select(*by, F.when(F.col("_new").isNull(), F.col("w")).otherwise(mixed).alias("w")))
        drop(last, top)
    return weights


def line(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and R squared of y on x per group."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def robust_line(x: np.ndarray, y: np.ndarray, delta: float, loss: str = "huber", rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept by iteratively reweighted least squares: squares up to ``delta``, then linear (huber), logarithmic (log) or squares throughout (squares)."""
    tail = {"huber": lambda r: delta / r, "log": lambda r: (delta / r) ** 2, "squares": np.ones_like}[loss]
    w = np.ones(len(x))
    slope = intercept = 0.0
    for _ in range(rounds):
        sw, sx, sy = w.sum(), (w * x).sum(), (w * y).sum()
        d = sw * (w * x * x).sum() - sx * sx
        new = ((sw * (w * x * y).sum() - sx * sy) / d, 0.0) if d else (0.0, 0.0)
        new = (new[0], (sy - new[0] * sx) / sw)
        if abs(new[0] - slope) + abs(new[1] - intercept) < 1e-12:
            break
        slope, intercept = new
        w = np.minimum(1.0, tail(np.maximum(np.abs(y - slope * x - intercept), 1e-12)))
    return slope, intercept


def huber_line(x: np.ndarray, y: np.ndarray, delta: float, rounds: int = 100) -> tuple[float, float]:
    return robust_line(x, y, delta, "huber", rounds)


def calibrate(lib: np.ndarray, real: np.ndarray, r2: float = 0.95, most: float = 50.0, loss: str = "huber") -> dict:
    """Robust line lib = slope * real + intercept: points far off the line through the extremes go first, then the worst one until R squared suffices."""
    delta = (lib.max() - lib.min()) / 30
    lo, hi = int(np.argmin(lib * real)), int(np.argmax(lib * real))
    keep = np.ones(len(lib), bool)
    if real[hi] != real[lo]:
        k = (lib[hi] - lib[lo]) / (real[hi] - real[lo])
        keep = np.abs(lib - (lib[lo] + k * (real - real[lo]))) <= most
    while True:
        slope, intercept = robust_line(real[keep], lib[keep], delta, loss)
        with np.errstate(invalid="ignore"):
            found = np.corrcoef(real[keep], lib[keep])[0, 1] ** 2 if keep.sum() > 2 else 1.0
        if found >= r2 or keep.sum() <= 3:
            return {"slope": slope, "intercept": intercept, "r2": float(found), "selected": keep}
        worst = np.where(keep, np.abs(lib - slope * real - intercept), -1).argmax()
        keep[worst] = False


def calibrate_groups(df: DataFrame, keys: list[str], lib: str, real: str, loss: str = "huber") -> DataFrame:
    """``calibrate`` per group; a group holds the standards of one run, a few hundred rows.

    ``points`` lists what the line was laid through and ``left_out`` the rest, as (real, lib).
    """
    import pandas as pd

    fields = [*keys, "slope", "intercept", "r2", "selected", "points", "left_out"]
    types = dict(df.dtypes)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[real].to_numpy(float), pdf[lib].to_numpy(float)
        r = calibrate(y, x, loss=loss)
        sets = [[{"real": a, "lib": b} for a, b, k in zip(x.tolist(), y.tolist(), r["selected"].tolist(), strict=True) if k is side] for side in (True, False)]
        return pd.DataFrame([[*key, r["slope"], r["intercept"], r["r2"], int(r["selected"].sum()), *sets]], columns=fields)

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "slope double, intercept double, r2 double, selected long, points array<struct<real:double,lib:double>>, left_out array<struct<real:double,lib:double>>"])
    return df.select(*keys, lib, real).groupBy(*keys).applyInPandas(run, schema)
