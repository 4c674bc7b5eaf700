"""Physical layouts of Parquet data that lookups and joins can use.

Three ways, chosen per key: ranges of the key in files of their own (for a key that is looked up by
ranges or that few rows share), Bloom filters per row group (for further keys of many values that
are looked up by equality), and buckets (for keys that tables are joined on again and again).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def with_blooms(writer: DataFrameWriter, columns: list[str], distinct: int = 1_000_000) -> DataFrameWriter:
    """Parquet Bloom filters of ``columns``, sized for ``distinct`` values a row group."""
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    return writer


def write_clustered(df: DataFrame, path: str, by: list[str], bloom: list[str] | None = None, files: int | None = None, mode: str = "errorifexists", distinct: int = 1_000_000, **options) -> None:
    """Files of adjoining ranges of ``by``, sorted inside: their footers tell which rows can be in them."""
    dealt = df.repartitionByRange(*([files] if files else []), *by).sortWithinPartitions(*by)
    with_blooms(dealt.write.mode(mode).options(**options), bloom or [], distinct).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, mode: str = "errorifexists") -> DataFrame:
    """A catalog table whose rows lie in ``buckets`` by a hash of ``keys``, sorted by them; joins and groups on the keys need no exchange."""
    df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def scan_numbers(df: DataFrame) -> dict[str, int]:
    """Files and rows that the scans of ``df`` read when it was last run: rows count after whole row groups were left out."""
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.getClass().getSimpleName():
        plan = plan.executedPlan()
    out = {"files": 0, "rows": 0}
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if "QueryStageExec" in kind:
            nodes.append(node.plan())
            continue
        if kind == "FileSourceScanExec":
            metrics = node.metrics()
            out["files"] += metrics.apply("numFiles").value()
            out["rows"] += metrics.apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return out


def prune_hint(spark: SparkSession, keys: DataFrame, on: list[str], most: int = 10_000):
    """A condition on ``on`` that file readers can use: the values themselves where they are at most ``most``, else their range; None without rows."""
    if len(on) == 1:
        values = [r[0] for r in keys.select(on[0]).where(F.col(on[0]).isNotNull()).distinct().limit(most + 1).collect()]
        if len(values) <= most:
            return F.col(on[0]).isin(values) if values else None
    bounds = keys.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(on) for n, f in (("a", F.min), ("b", F.max))]).first()
    if any(bounds[f"a{i}"] is None for i in range(len(on))):
        return None
    condition = F.lit(True)
    for i, c in enumerate(on):
        condition = condition & F.col(c).between(bounds[f"a{i}"], bounds[f"b{i}"])
    return condition
