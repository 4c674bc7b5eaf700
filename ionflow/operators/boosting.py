"""Gradient-boosted trees on the scores of many runs at once, each run as if it were alone.

All runs' trees grow together: one aggregate a level sums the gradients of every (run, node,
feature, bin) and so many jobs as a tree has levels serve any number of runs. Tasks add their
rows up in arrays first. Gradients of the logistic loss are whole multiples of 2^-32, so their
sums do not depend on how rows are dealt, and a run gets the same trees in any company.

Rows carry their margin along: after each round the new tree is applied to all rows, those that
no tree was trained on too, and the trees are returned beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionflow.operators.settle import cut, drop, settle

UNIT = float(1 << 32)


@dataclass(frozen=True)
class Settings:
    """Of the trees: how many, how deep, and when a node is split. Weights are sums of second derivatives."""

    rounds: int = 40
    depth: int = 5
    rate: float = 0.1
    bins: int = 32
    ridge: float = 1.0
    least_gain: float = 0.0
    least_weight: float = 1.0
    largest_step: float = 3.0
    base: float = 0.5


def gradients(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, in whole units."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - label) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64)


def routed(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Node of each row after ``depth`` levels of its own tree: node k has children 2k + 1 and 2k + 2; rows stay where feature is -1."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[rows, node]
        on = f >= 0
        node[on] = 2 * node[on] + 1 + (bins[rows[on], f[on]] > cut[rows[on], node[on]])
    return node


def best_split(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node into bins up to and above one; ``g`` and ``h`` are (feature, bin) in units. Ties to the lower feature and bin."""
    g, h = g.cumsum(axis=1).astype(float) / UNIT, h.cumsum(axis=1).astype(float) / UNIT
    all_g, all_h = g[:, -1:], h[:, -1:]
    score = lambda a, b: a * a / (b + s.ridge)
    gain = (score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h)) / 2 - s.least_gain
    gain[(h < s.least_weight) | (all_h - h < s.least_weight)] = -np.inf
    gain[:, -1] = -np.inf
    at = int(gain.argmax())
    return (float(gain.flat[at]), *divmod(at, gain.shape[1])) if gain.flat[at] > 1e-9 else None


def leaf(g: int, h: int, s: Settings) -> float:
    return float(np.clip(-(g / UNIT) / (h / UNIT + s.ridge), -s.largest_step, s.largest_step)) * s.rate


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind, copy=False)


def quantile_cuts(df: DataFrame, run: str, columns: list[str], bins: int) -> DataFrame:
    """(run, cuts array<array<double>>): ascending distinct quantiles of each column in each run."""
    shares = F.lit([i / bins for i in range(1, bins)])
    quantiles = [F.array_sort(F.array_distinct(F.percentile_approx(number(c), shares, 10_000))) for c in columns]
    return df.groupBy(run).agg(F.array(*quantiles).alias("cuts"))


def number(c: str):
    """A score as a number; missing ones are zero."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def histograms(rows: DataFrame, trees: DataFrame, level: int, s: Settings, features: int) -> DataFrame:
    """(_run, node, feature, bin, g, h) of the labelled rows in the nodes of a level."""
    nodes, first = 2 ** (s.depth + 1) - 1, 2**level - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = _matrix(b.column(1), features, np.int64)
            node = routed(bins, _matrix(b.column(4), nodes, np.int64), _matrix(b.column(5), nodes, np.int64), level)
            here = np.flatnonzero(node >= first)
            runs = b.column(0).dictionary_encode()
            own = runs.indices.to_numpy()[here].astype(np.int64) * (first + 1) + node[here] - first
            code = ((own[:, None] * features + np.arange(features)) * s.bins + bins[here]).ravel()
            used, at = np.unique(code, return_inverse=True)
            sums = []
            for x in gradients(b.column(3).to_numpy()[here], b.column(2).to_numpy()[here]):
                # Doubles add up whole numbers exactly in halves of 16 bits.
                high, low = np.repeat(x >> 16, features).astype(float), np.repeat(x & 0xFFFF, features).astype(float)
                sums.append((np.bincount(at, high, len(used)).astype(np.int64) << 16) + np.bincount(at, low, len(used)).astype(np.int64))
            cell, feature = used // s.bins // features, used // s.bins % features
            yield pa.RecordBatch.from_arrays([runs.dictionary.take(pa.array(cell // (first + 1))), *(pa.array(x.astype(np.int32)) for x in (cell % (first + 1) + first, feature, used % s.bins)), *map(pa.array, sums)], ["_run", "node", "feature", "bin", "g", "h"])

    joined = rows.where("label IS NOT NULL").join(trees, "_run").select("_run", "bins", "label", "margin", "feature", "cut")
    parts = joined.mapInArrow(run, "_run string, node int, feature int, bin int, g long, h long")
    return parts.groupBy("_run", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def split(trees: DataFrame, sums: DataFrame, level: int, s: Settings, features: int) -> DataFrame:
    """``trees`` with the nodes of a level split where that gains; the values of their children are known at once."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        tree = {n: np.array(left[n][0].as_py()) for n in ("feature", "cut", "value")}
        node = right["node"].to_numpy()
        for k in np.unique(node).tolist():
            at = np.flatnonzero(node == k)
            g, h = np.zeros((2, features, s.bins), np.int64)
            f, b = right["feature"].to_numpy()[at], right["bin"].to_numpy()[at]
            g[f, b], h[f, b] = right["g"].to_numpy()[at], right["h"].to_numpy()[at]
            grow(tree, k, g, h, s)
        return pa.table({"_run": left["_run"], **{n: pa.array([tree[n].tolist()], left.schema.field(n).type) for n in tree}})

    return trees.groupBy("_run").cogroup(sums.groupBy("_run")).applyInArrow(run, trees.schema)


def grow(tree: dict[str, np.ndarray], node: int, g: np.ndarray, h: np.ndarray, s: Settings) -> None:
    """Split one node of a tree (arrays feature, cut, value by node) in place, or leave it."""
    if node == 0:
        tree["value"][0] = leaf(int(g[0].sum()), int(h[0].sum()), s)
    found = best_split(g, h, s)
    if found:
        _, f, b = found
        tree["feature"][node], tree["cut"][node] = f, b
        for child, part in ((2 * node + 1, slice(0, b + 1)), (2 * node + 2, slice(b + 1, None))):
            tree["value"][child] = leaf(int(g[f, part].sum()), int(h[f, part].sum()), s)


def boost(df: DataFrame, by: list[str], columns: list[str], label: str, name: str = "margin", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """``df`` with the margin of each row (the logarithm of its odds) under its run's trees, and the trees.

    Rows whose ``label`` (0 or 1) is null are scored only; rows of runs without labels keep the base
    margin. The trees: by..., tree (from 0), feature (place in ``columns``, -1 for a leaf), threshold
    (values up to it go to node 2k + 1, others to 2k + 2) and value, each by node.
    """
    s, features, nodes = settings, len(columns), 2 ** (settings.depth + 1) - 1
    held = cut(df.withColumns({"_row": F.monotonically_increasing_id(), "_run": F.to_json(F.struct(*by), {"ignoreNullFields": "false"})}))
    cuts = cut(quantile_cuts(held.where(F.col(label).isNotNull()), "_run", columns, s.bins))
    # A bin is the number of cuts below a value.
    below = lambda j, c: F.size(F.filter(F.get("cuts", F.lit(j)), lambda x: x < number(c)))
    bins = F.array(*[below(j, c) for j, c in enumerate(columns)])
    base = float(np.log(s.base / (1 - s.base)))
    rows = cut(held.join(cuts, "_run").select("_run", "_row", F.col(label).cast("double").alias("label"), bins.alias("bins"), F.lit(base).alias("margin")))
    blank = cuts.select("_run", *[F.array_repeat(F.lit(v), nodes).cast(f"array<{t}>").alias(n) for n, v, t in (("feature", -1, "int"), ("cut", 0, "int"), ("value", 0.0, "double"))])
    every = []
    for turn in range(s.rounds):
        trees = blank
        for level in range(s.depth):
            last, trees = trees, cut(split(trees, histograms(rows, trees, level, s, features), level, s, features))
            drop(last)
        every.append(trees.withColumn("tree", F.lit(turn)))

        def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = _matrix(b.column(3), features, np.int64)
                node = routed(bins, *(_matrix(b.column(i), nodes, np.int64) for i in (5, 6)), s.depth)
                value = _matrix(b.column(7), nodes, float)[np.arange(len(node)), node]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(b.column(4).to_numpy() + value)], ["_run", "_row", "label", "bins", "margin"])

        last, rows = rows, cut(rows.join(trees, "_run").select(*rows.columns, "feature", "cut", "value").mapInArrow(applied, rows.schema))
        drop(last)
    scored = held.join(rows.select("_row", F.col("margin").alias(name)), "_row", "left").withColumn(name, F.coalesce(name, F.lit(base))).drop("_row", "_run")
    of_run = held.select("_run", *by).distinct()
    model = every[0] if every else blank.withColumn("tree", F.lit(0)).where("false")
    for t in every[1:]:
        model = model.unionByName(t)
    threshold = F.zip_with("feature", "cut", lambda f, c: F.when(f >= 0, F.get(F.get("cuts", f), c)))
    return scored, model.join(cuts, "_run").join(of_run, "_run").select(*by, "tree", "feature", threshold.alias("threshold"), "value")


def rank(df: DataFrame, by: list[str], group: str, columns: list[str], decoy: str, first: str = "Dotprod", iterations: int = 2, fdr: float = 0.05, name: str = "total_score", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``df`` with a semi-supervised score: trees on the best rows per group, decoys against targets over a cutoff, again and again.

    The first rows are the best by ``first``, later ones the best by the last trees; see
    ``learning.training_rows`` for the cutoff of each run.
    """
    from ionflow.operators.groups import best
    from ionflow.operators.learning import small_runs, training_rows

    held = cut(df.withColumn("_id", F.monotonically_increasing_id()))
    small = cut(small_runs(held, by, group, decoy))
    scored = held.withColumn(name, F.col(first).cast("double"))
    for _ in range(iterations):
        top = cut(best(scored, [*by, group, decoy], name, [F.col("_id")], ["_id", name]))
        chosen = training_rows(top, by, decoy, name, fdr, small).select("_id", "label")
        scored, _trees = boost(held.join(chosen, "_id", "left"), by, columns, "label", name, settings)
        last, scored = scored, cut(scored.drop("label"))
        drop(last, top)
    return scored.drop("_id")
