"""Aggregations: best per group, modes, histograms, percentiles, merges over runs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lower bounds of the 29 bins of an fdr distribution; fixed values.
FDR_BINS = (*(i / 1000 for i in range(10)), *(i / 100 for i in range(1, 10)), *(i / 10 for i in range(1, 11)))

#: Ranges of values that ``percentiles`` counts before it ranks those it needs.
RANGES = 2048


def fixed(c: Column, digits: int = 4) -> Column:
    """Round half up by floor, alike on every engine."""
    return F.floor(c * 10**digits + 0.5) / float(10**digits)


def best(df: DataFrame, keys: list[str], score: str, ties: list[Column], keep: list[str]) -> DataFrame:
    """The row with the largest score per group, of equals the first in ``ties`` (ascending); null scores never win.

    A minimum over a struct aggregates partially before the shuffle; a ranking would move every row.
    """
    order = [(-F.col(score)).alias("_o"), *[c.alias(f"_t{i}") for i, c in enumerate(ties)]]
    rows = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*keep).alias("row"))).alias("x"))
    return rows.select(*keys, *[F.col(f"x.row.{c}").alias(c) for c in keep])


def mode_then_max(df: DataFrame, group: str, value: str, score: str) -> DataFrame:
    """Per group the most frequent value (of equals the smallest), its count and its largest score."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("top"))
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("o"), F.col(value).alias("v"), F.col("top"))).alias("x")).select(group, F.col("x.v").alias(value), (-F.col("x.o")).alias("n"), F.col("x.top").alias("top"))


def histogram(df: DataFrame, value: str, low: float, high: float, slices: int) -> DataFrame:
    """Equal slices (lo, hi], all of them listed."""
    spark, step = df.sparkSession, (high - low) / slices
    bins = spark.range(slices).select(F.col("id").cast("int").alias("bin"))
    hit = df.where((F.col(value) > low) & (F.col(value) <= high)).groupBy((F.ceil((F.col(value) - low) / step) - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(F.broadcast(hit), "bin", "left").select("bin", (low + F.col("bin") * step).alias("lo"), (low + (F.col("bin") + 1) * step).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def snapped_bounds(df: DataFrame, value: str) -> tuple[int, int]:
    """Whole hundreds around the values: those below the least and above the greatest whole part."""
    r = df.agg(F.min(F.col(value).cast("long")).alias("a"), F.max(F.col(value).cast("long")).alias("b")).first()
    low = -100 if -100 < r["a"] < 0 else int(r["a"] / 100) * 100
    return low, (int(r["b"] / 100) + 1) * 100


def uneven_histogram(df: DataFrame, value: str, lower: tuple[float, ...] = FDR_BINS) -> DataFrame:
    """Bins [lower[i], lower[i + 1]) and one from the last bound on, all of them listed."""
    edges = F.lit(list(lower))
    bins = df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(lower)], "bin int, lo double")
    hit = df.where(F.col(value) >= lower[0]).groupBy((F.size(F.filter(edges, lambda e: e <= F.col(value))) - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(F.broadcast(hit), "bin", "left").select("bin", "lo", F.coalesce("n", F.lit(0)).alias("n"))


def legacy_percentile(values: Column, percent: Column) -> Column:
    """Percentile at position (n + 1) p of a sorted array, linear between neighbours, ends clamped."""
    n = F.size(values)
    pos = percent / 100.0 * (n + 1)
    at = F.floor(pos).cast("int")
    inner = F.element_at(values, at) + (pos - at) * (F.element_at(values, at + 1) - F.element_at(values, at))
    return F.when(pos < 1, F.element_at(values, 1)).when(pos >= n, F.element_at(values, -1)).otherwise(inner)


def percentiles(df: DataFrame, group: str, value: str, percents: range = range(1, 100), settled: bool = False) -> DataFrame:
    """(n + 1) p percentiles per group; rows without a group are left out.

    Quantile cuts divide the values into ``RANGES``, whose rows are counted by group. Running sums of
    the counts tell which ranges hold a rank that a percentile needs; only their rows are taken
    apart by value and ranked, each range of a group on its own, so no group is gathered or sorted in
    one task. The cuts bear on cost only: ranks come from exact counts.

    The input is read three times (for the cuts, the counts and the rows), so it is computed once
    beforehand, unless it is ``settled`` already.
    """
    from ionflow.operators.ordered import running, with_range
    from ionflow.operators.settle import settle, written

    pos = lambda pct: F.least(F.greatest(pct / 100.0 * (F.col("n") + 1), F.lit(1.0)), F.col("n").cast("double"))
    within = lambda rank: (rank <= F.col("upto")) & (rank > F.col("upto") - F.col("c"))
    # Percentiles that may need ranks (upto - c, upto]; the least and largest value serve those off the ends too.
    first = F.when(F.col("upto") == F.col("c"), percents[0]).otherwise(F.greatest(F.lit(percents[0]), F.floor((F.col("upto") - F.col("c")) * 100.0 / (F.col("n") + 1)) - 1))
    last = F.when(F.col("upto") == F.col("n"), percents[-1]).otherwise(F.least(F.lit(percents[-1]), F.ceil((F.col("upto") + 1) * 100.0 / (F.col("n") + 1)) + 1))
    near = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    wanted = F.filter(near, lambda p: within(F.floor(pos(p))) | within(F.ceil(pos(p))))

    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, value)
    rows = with_range(rows if settled else settle(rows), value, RANGES, "_range")
    counts = settle(rows.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("c")))  # at most RANGES + 1 rows a group
    totals = running(counts, "_range", {"upto": ("sum", "c")}, buckets=1, keys=[group], settled=True).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    needed = written(totals.where(F.size(wanted) > 0).select(group, "_range", (F.col("upto") - F.col("c")).alias("before"), "n"))  # a table, so the planner knows its size
    counts = rows.join(needed, [group, "_range"]).groupBy(group, "_range", "before", "n", value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    hit = counts.withColumn("upto", F.col("before") + upto).select(group, value, "n", "upto", "c", F.explode(wanted).alias("pct")).withColumn("pos", pos(F.col("pct")))
    low, high = (F.max(F.when(within(f("pos")), F.col(value))) for f in (F.floor, F.ceil))
    both = hit.groupBy(group, "pct", "pos").agg(low.alias("a"), high.alias("b")).where(F.col("pct").isin(list(percents)) if percents.step != 1 else F.lit(True))
    return both.select(group, "pct", (F.col("a") + (F.col("pos") - F.floor("pos")) * (F.col("b") - F.col("a"))).alias("value"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation and coefficient of variation over non-zero values."""
    v = F.when(F.col(value) > 0, F.col(value))
    g = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"))
    return g.withColumn("cv", F.col("sd") / F.col("mean"))


def merge_runs(df: DataFrame, run: str, item: str, value: Column) -> DataFrame:
    """Per item: mean over the runs that have it and their number."""
    per_run = df.groupBy(item, run).agg(F.sum(value).alias("_v"))
    return per_run.groupBy(item).agg(F.avg("_v").alias("intensity"), F.count(F.lit(1)).alias("effect_num"))


def merge_summary(merged: DataFrame, runs: int) -> DataFrame:
    """Items hit in one, two and three runs, and the ratio of missing values."""
    hits = [F.sum(F.when(F.col("effect_num") == k, 1).otherwise(0)).alias(f"hit{k}") for k in (1, 2, 3)]
    return merged.agg(*hits, F.count(F.lit(1)).alias("items"), (1 - F.sum("effect_num") / (F.lit(float(runs)) * F.count(F.lit(1)))).alias("missing_ratio"))


def fold_change(a: DataFrame, b: DataFrame, key: str, value: str, species: Column) -> DataFrame:
    """Per key of both groups: x = log2(b), y = log2(a / b), species."""
    joined = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key)
    good = joined.where((F.col("va") > 0) & (F.col("vb") > 0))
    return good.select(key, species.alias("species"), F.log2("vb").alias("x"), F.log2(F.col("va") / F.col("vb")).alias("y"))


def species_of(name: Column, endings: dict[str, str], other: str) -> Column:
    c = None
    for ending, label in endings.items():
        c = F.when(name.endswith(ending), label) if c is None else c.when(name.endswith(ending), label)
    return c.otherwise(other)


def report(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """One line per row, one summed column per listed value; missing sums are null."""
    return df.groupBy(row).pivot(column, values).agg(F.sum(value))
