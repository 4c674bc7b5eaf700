"""Target/decoy statistics: p-values, pi0, q-values, error rates, status.

All of them depend on a row's score alone, so they are computed once per distinct score (or
p-value) and joined back; running counts go over quantile buckets, never through one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionflow.operators.ordered import running
from ionflow.operators.settle import settle

LAMBDAS = tuple(i / 20 for i in range(10))
SUCCESS, FAILED = 1, 2
PRECISION = 1e6


def erf(x: Column, steps: int = 100) -> Column:
    """Error function as the sum over the right ends of ``steps`` strips; Spark SQL has none."""
    strips = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + F.exp(-F.pow(i * x / float(steps), F.lit(2.0))))
    return strips * x * 2.0 / math.sqrt(math.pi) / float(steps)


def levels(df: DataFrame, score: str, decoy: str) -> DataFrame:
    """Per distinct score: targets, decoys, and decoys with a higher score."""
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(decoy), 0).otherwise(1)).cast("long").alias("targets"), F.sum(F.when(F.col(decoy), 1).otherwise(0)).cast("long").alias("decoys")
    )
    return running(counts, "score", {"above": ("sum", "decoys")}, descending=True, exclusive=True)


def empirical(df: DataFrame, score: str, decoy: str) -> DataFrame:
    """Per score with targets: p = decoys above over all decoys, at least one over all decoys."""
    found = settle(levels(df, score, decoy))
    total = found.agg(F.sum("decoys").alias("n")).first()["n"] or 0
    if not total:
        raise ValueError("no decoys")
    return found.where("targets > 0").select("score", "targets", F.greatest(F.col("above") / F.lit(float(total)), F.lit(1.0 / total)).alias("p"))


def parametric(df: DataFrame, score: str, decoy: str) -> DataFrame:
    """Targets with p from a normal distribution of the decoys' scores; no p without decoys, 1 up to and 0 over their score if they all have one."""
    s = F.col(score).cast("double")
    m = df.where(F.col(decoy)).agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd")).first()
    if not m["sd"]:
        p = F.lit(None) if m["mean"] is None else F.when(s > m["mean"], 0.0).otherwise(1.0)
        return df.where(~F.col(decoy)).withColumn("p", p.cast("double"))
    z = (s - F.lit(m["mean"])) / F.lit(m["sd"])
    return df.where(~F.col(decoy)).withColumn("p", 1 - 0.5 * (1 + erf(z / math.sqrt(2.0))))


def pi0_table(p: DataFrame, lambdas=LAMBDAS) -> list[dict]:
    """Per lambda: count of targets with p at or over it, its estimate and its error; one aggregate row reaches the driver."""
    row = p.agg(F.sum("targets").alias("n"), *[F.sum(F.when(F.col("p") >= x, F.col("targets")).otherwise(0)).alias(f"w{i}") for i, x in enumerate(lambdas)]).first()
    n = row["n"]
    out = [{"lambda": x, "w": row[f"w{i}"], "pi0": row[f"w{i}"] / n / (1 - x)} for i, x in enumerate(lambdas)]
    least = min(r["pi0"] for r in out)
    for r in out:
        r["mse"] = r["w"] / (n**2 * (1 - r["lambda"]) ** 2) * (1 - r["w"] / n) + (r["pi0"] - least) ** 2
    return out


def pi0(p: DataFrame, lambdas=LAMBDAS) -> float:
    """Bootstrap estimate: the positive one with the least error, at most 1."""
    found = [r for r in pi0_table(p, lambdas) if r["pi0"] > 0]
    if not found:
        raise ValueError("pi0 is not positive")
    return min(min(found, key=lambda r: (r["mse"], r["lambda"]))["pi0"], 1.0)


def separated(df: DataFrame, score: str, decoy: str) -> bool:
    """Whether the lowest target beats the highest decoy."""
    s = F.col(score).cast("double")
    r = df.agg(F.min(F.when(~F.col(decoy), s)).alias("t"), F.max(F.when(F.col(decoy), s)).alias("d")).first()
    return r["t"] is not None and r["d"] is not None and r["t"] > r["d"]


def metrics(p: DataFrame, share: float) -> DataFrame:
    """Per p: n_positive, q_value, fdr, fnr, sensitivity, s_value, fp, tp, fn, tn; ``p``: rows of (score, targets, p)."""
    by_p = settle(p.groupBy("p").agg(F.sum("targets").alias("targets")))
    n = by_p.agg(F.sum("targets").alias("n")).first()["n"]
    null = share * n
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    m = running(by_p, "p", {"n_positive": ("sum", "targets")}, settled=True)
    negative = F.lit(n) - F.col("n_positive")
    fp, fn = F.col("p") * null, negative - (1 - F.col("p")) * null
    m = m.select(
        "p", "n_positive", (F.col("p") * (share * n) / F.col("n_positive")).alias("raw"),
        (F.col("n_positive") - fp).alias("tp"), fp.alias("fp"), ((1 - F.col("p")) * null).alias("tn"), fn.alias("fn"),
        clip(fp / F.col("n_positive")).alias("fdr"), F.when(negative == 0, 0.0).otherwise(clip(fn / negative)).alias("fnr"),
        clip((F.col("n_positive") - fp) / F.lit(float(n) - null) if n != null else F.lit(0.0)).alias("sensitivity"),
    )
    m = running(settle(m).withColumn("capped", F.least("raw", F.lit(1.0))), "p", {"q_value": ("min", "capped")}, descending=True, settled=True)
    return running(m, "p", {"s_value": ("max", "sensitivity")}).drop("raw", "capped")


def pipeline(df: DataFrame, keys: list[str], score: str, decoy: str, cut: float = 0.01) -> DataFrame:
    """Targets with p, pi0, q, fdr and status: selected groups to identification rows."""
    p = empirical(df, score, decoy)
    share = 1 / PRECISION if separated(df, score, decoy) else pi0(p)
    per_score = p.select("score", "p").join(metrics(p, share), "p")
    rows = df.where(~F.col(decoy)).select(*keys, F.col(score).cast("double").alias("score")).join(per_score, "score")
    return rows.select(*keys, "score", "p", F.lit(share).alias("pi0"), "q_value", "fdr", F.when(F.col("fdr") <= cut, SUCCESS).otherwise(FAILED).alias("status"))


def decoy_rates(scored: DataFrame, score: str, decoy: str, fdr: str) -> DataFrame:
    """Decoy scores with the fdr of the nearest target score (ties to the higher): null below all targets, the last above all.

    The nearest targets on both sides come from running extremes over score levels that carry their
    target's fdr along.
    """
    level = scored.groupBy(F.col(score).cast("double").alias("score")).agg(F.max(F.when(~F.col(decoy), F.struct(F.col(score).cast("double").alias("s"), F.col(fdr).alias("fdr")))).alias("t"), F.max(F.col(decoy)).alias("has_decoy"))
    level = running(level, "score", {"left": ("max", "t")})
    level = running(level, "score", {"right": ("min", "t")}, descending=True)
    nearest = F.when(F.col("left").isNull(), F.lit(None)).when(F.col("right").isNull(), F.col("left.fdr")).when(F.col("score") - F.col("left.s") < F.col("right.s") - F.col("score"), F.col("left.fdr")).otherwise(F.col("right.fdr"))
    return level.where("has_decoy").select("score", nearest.alias("fdr"))


def found_under(df: DataFrame, by: list[str], fdr: str, cut: float = 0.01) -> DataFrame:
    """Per group how many rows have a rate of at most ``cut``."""
    return df.groupBy(*by).agg(F.sum(F.when(F.col(fdr) <= cut, 1).otherwise(0)).cast("long").alias("found"))


def threshold(df: DataFrame, score: str, fdr: str, cut: float = 0.01) -> DataFrame:
    """Score of the row with the largest fdr under the cut; of equals the lowest score; no row if there is none."""
    return df.where(F.col(fdr) < cut).agg(F.min_by(score, F.struct((-F.col(fdr)).alias("f"), F.col(score).alias("s"))).alias("score")).where("score IS NOT NULL")


def nearest_cutoff(df: DataFrame, score: str, q: str, cutoff: float) -> DataFrame:
    """Score whose q lies nearest to the cutoff; of equals the lowest score."""
    return df.agg(F.min_by(score, F.struct(F.abs(F.col(q) - cutoff).alias("d"), F.col(score).alias("s"))).alias("score"))


# Per group ---------------------------------------------------------------------------------------


def levels_by(df: DataFrame, by: list[str], score: str, decoy: str) -> DataFrame:
    """Per group and distinct score with targets: p, and the group's pi0 with its best lambda.

    The windows run over one group each. A group is a run: it has no more scores than the library
    has peptides, while the number of runs has no bound.
    """
    counts = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(F.when(F.col(decoy), 0).otherwise(1)).alias("targets"), F.sum(F.when(F.col(decoy), 1).otherwise(0)).alias("decoys"))
    down = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    some = lambda c: F.when(c > 0, F.col("score"))
    seen = counts.select(
        "*", F.coalesce(F.sum("decoys").over(down), F.lit(0)).alias("above"), F.sum("decoys").over(every).alias("all_decoys"),
        (F.min(some(F.col("targets"))).over(every) > F.max(some(F.col("decoys"))).over(every)).alias("apart"),
    )
    total = F.nullif(F.col("all_decoys"), F.lit(0)).cast("double")
    return seen.where("targets > 0").select(*by, "score", "targets", F.greatest(F.col("above") / total, 1.0 / total).alias("p"), "apart")


def shares_by(p: DataFrame, by: list[str], lambdas=LAMBDAS) -> DataFrame:
    """Per group of ``levels_by``: its targets and pi0, next to none where targets and decoys are apart."""
    sums = p.groupBy(*by).agg(F.sum("targets").alias("n"), F.max("apart").alias("apart"), *[F.sum(F.when(F.col("p") >= x, F.col("targets")).otherwise(0)).alias(f"w{i}") for i, x in enumerate(lambdas)])
    estimate = [F.col(f"w{i}") / F.col("n") / (1 - x) for i, x in enumerate(lambdas)]
    least = F.array_min(F.array(*estimate))
    error = [F.col(f"w{i}") / (F.col("n") * F.col("n") * F.lit((1 - x) ** 2)) * (1 - F.col(f"w{i}") / F.col("n")) + (estimate[i] - least) * (estimate[i] - least) for i, x in enumerate(lambdas)]
    options = F.array(*[F.struct(error[i].alias("mse"), F.lit(x).alias("lambda"), estimate[i].alias("pi0")) for i, x in enumerate(lambdas)])
    best = F.array_min(F.filter(options, lambda o: o["pi0"] > 0))["pi0"]
    return sums.select(*by, "n", F.when(F.col("apart"), 1 / PRECISION).otherwise(F.least(best, F.lit(1.0))).alias("pi0"))


def rates_by(p: DataFrame, by: list[str]) -> DataFrame:
    """Per group and score of ``levels_by``: p, pi0, q_value, fdr."""
    points = p.groupBy(*by, "p").agg(F.sum("targets").alias("targets")).join(shares_by(p, by), by)
    up = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    raw = points.withColumn("raw", F.col("p") * F.col("pi0") * F.col("n") / F.sum("targets").over(up))
    clip = F.greatest(F.least(F.col("raw"), F.lit(1.0)), F.lit(0.0))
    rates = raw.select(*by, "p", "pi0", F.min(F.least("raw", F.lit(1.0))).over(down).alias("q_value"), clip.alias("fdr"))
    return p.select(*by, "score", "p").join(rates, [*by, "p"])


def pipeline_by(df: DataFrame, by: list[str], keys: list[str], score: str, decoy: str, cut: float = 0.01) -> DataFrame:
    """``pipeline`` for each group of ``by`` as if it were alone; targets of a group without decoys have no rates and fail."""
    per_score = rates_by(settle(levels_by(df, by, score, decoy)), by)
    rows = df.where(~F.col(decoy)).select(*by, *keys, F.col(score).cast("double").alias("score")).join(per_score, [*by, "score"], "left")
    return rows.select(*by, *keys, "score", "p", "pi0", "q_value", "fdr", F.when(F.col("fdr") <= cut, SUCCESS).otherwise(FAILED).alias("status"))
