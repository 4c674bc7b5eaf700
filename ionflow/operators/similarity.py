"""Library similarity of peak groups in long form (one row per fragment), as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scores(df: DataFrame, keys: list[str], run: str, lib: str) -> DataFrame:
    """dotprod, sangle, rsmd, avg_sqr, int_shift, manhattan and pearson per group of (run, lib) intensities."""
    totals = df.groupBy(*keys).agg(
        F.sum(run).alias("_r"), F.sum(lib).alias("_l"), F.sum(F.sqrt(run)).alias("_sr"), F.sum(F.sqrt(lib)).alias("_sl"), F.sum(F.col(run) * F.col(run)).alias("_rr"), F.sum(F.col(lib) * F.col(lib)).alias("_ll"),
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(run) * F.col(lib)).alias("_rl"), F.sum(F.sqrt(F.col(run) * F.col(lib))).alias("_dp"), F.max(F.when(F.col(lib) > 0, F.col(run) / F.col(lib))).alias("_hi"), F.min(F.when(F.col(lib) > 0, F.col(run) / F.col(lib))).alias("_lo"),
    )
    share = lambda c, total: F.when(F.col(total) > 0, F.col(c) / F.col(total)).otherwise(0.0)
    rows = df.join(totals, keys)
    d = share(run, "_r") - share(lib, "_l")
    moved = F.abs(F.when(F.col("_sr") > 0, F.sqrt(run) / F.col("_sr")).otherwise(0.0) - F.when(F.col("_sl") > 0, F.sqrt(lib) / F.col("_sl")).otherwise(0.0))
    var_r, var_l = F.col("_rr") - F.col("_r") * F.col("_r") / F.col("_n"), F.col("_ll") - F.col("_l") * F.col("_l") / F.col("_n")
    cosine: Column = F.col("_rl") / F.sqrt(F.col("_rr") * F.col("_ll"))
    g = rows.groupBy(*keys, *[c for c in totals.columns if c not in keys]).agg(F.avg(F.abs(d)).alias("rsmd"), F.sqrt(F.avg(d * d)).alias("avg_sqr"), F.sum(moved).alias("manhattan"))
    return g.select(
        *keys,
        (F.col("_dp") / F.sqrt(F.col("_r") * F.col("_l"))).alias("dotprod"),
        F.acos(F.least(F.lit(1.0), cosine)).alias("sangle"),
        "rsmd", "avg_sqr", "manhattan",
        ((F.col("_hi") - F.col("_lo")) / F.col("_hi")).alias("int_shift"),
        F.when((var_r > 1e-6) & (var_l > 1e-6), (F.col("_rl") - F.col("_r") * F.col("_l") / F.col("_n")) / F.sqrt(var_r * var_l)).otherwise(0.0).alias("pearson"),
    )
