"""Running aggregates over a whole table without sorting it in one task.

Quantiles of the order column cut the table into buckets; each bucket runs on its own, and the
buckets' totals, one row each, are carried into the next ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionflow.operators.settle import settle

KINDS = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
JOINED = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}


def bucket_count(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def quantile_cuts(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Ascending values that cut ``column`` into about equal shares, at most ``buckets`` of them."""
    if buckets < 2:
        return []
    shares = F.expr(f"array({', '.join(f'{i / buckets!r}D' for i in range(1, buckets))})")  # one text: thousands of literals are slow to make one by one
    cuts = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, 10_000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def with_range(df: DataFrame, column: str, ranges: int, name: str) -> DataFrame:
    """``df`` with the number of the quantile range of ``column`` (not null) as ``name``: for thousands of ranges, where ``range_bucket`` has too many conditions."""
    from pyspark.ml.feature import Bucketizer

    cuts = [c for c in quantile_cuts(df, column, ranges) if math.isfinite(c)]
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    # NaNs get a range of their own after all others ("keep").
    return Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=column, outputCol=name, handleInvalid="keep").transform(df)


def range_bucket(df: DataFrame, column: str, buckets: int) -> Column:
    """Number of the quantile range that a row of ``column`` falls in; equal values share one."""
    cuts = quantile_cuts(df, column, buckets)
    if not cuts:
        return F.lit(0)
    value = F.col(column).cast("double")
    if len(cuts) > 256:  # too many conditions to compile: a search through an array
        steps = F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda acc, step: F.when(value >= F.get(F.lit(cuts), acc + step - 1), acc + step).otherwise(acc))

    def halved(low: int, high: int) -> Column:
        """Bucket among ``low`` to ``high``: nested conditions, which are compiled where a fold over an array is not."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= cuts[mid], halved(mid + 1, high)).otherwise(halved(low, mid))

    return halved(0, len(cuts))


def running(df: DataFrame, order: str, wanted: dict[str, tuple[str, str]], descending: bool = False, exclusive: bool = False, buckets: int | None = None, keys: list[str] | None = None, settled: bool = False) -> DataFrame:
    """``df`` with running aggregates; ``wanted``: new column -> (sum, min, max or count; column). ``order`` must be unique, within the values of ``keys`` (not null) if there are any.

    The input is read three times (for the cuts, the totals and the rows), so it is computed once
    beforehand, unless it is ``settled`` already. With one bucket, for keys that all have few rows,
    nothing is carried.
    """
    keys = list(keys or [])
    df = df if settled else settle(df)
    buckets = buckets or bucket_count(df)
    if buckets == 1:
        whole = Window.partitionBy(*keys).orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        return df.select("*", *[JOINED[k](KINDS[k](c).over(whole), F.lit(None)).alias(n) for n, (k, c) in wanted.items()])
    df = df.withColumn("_bucket", range_bucket(df, order, buckets))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    across = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc() if descending else F.col("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_bucket").agg(*[KINDS[k](c).alias(f"_{n}") for n, (k, c) in wanted.items()])  # one row per key and bucket
    carried = totals.select(*keys, "_bucket", *[(F.sum if k == "count" else KINDS[k])(f"_{n}").over(across).alias(f"_{n}") for n, (k, _) in wanted.items()])
    local = df.select("*", *[KINDS[k](c).over(inside).alias(n) for n, (k, c) in wanted.items()])
    joined = local.join(carried if keys else F.broadcast(carried), [*keys, "_bucket"])
    return joined.select(*[c for c in df.columns if c != "_bucket"], *[JOINED[k](F.col(n), F.col(f"_{n}")).alias(n) for n, (k, _) in wanted.items()])
