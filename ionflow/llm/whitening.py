"""Whitening of embeddings by matrix-free block Lanczos.

The covariance of the distinct vectors is never formed. A pass multiplies it with a block of
vectors: each task centres its rows, multiplies them with the block and adds up one small matrix;
the tasks' matrices are summed by Spark and only (dimensions, block) numbers reach the driver.
There the block is made orthogonal to all earlier ones, twice (full reorthogonalisation), and
becomes the next block. Eigenpairs are those of the projection on all blocks so far; their
residuals are known without a further pass, and the passes end when those of the wanted pairs are
small. If nothing is left of a block (breakdown: an invariant space is exhausted), fresh directions
orthogonal to the basis take its place, so equal eigenvalues and separate spaces are found too.

``whiten`` projects every row on the leading components, over the square root of their eigenvalue.
The trace of the covariance comes exactly from the integer deviations, sum of (n x - S)^2, so the
explained shares need no further eigenvalues.

Defined results: see ``common.whole_vectors`` for the rows that go; repeated vectors count once in
the fit and each of their rows is returned; null ids stay null; components with an eigenvalue of
zero can't be whitened and are left out, so a table of one distinct vector, or none, gives an empty
result; a deviation beyond a long is null. Columns other than id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionflow.llm.common import drop_all, materialise, rows_of, whole_vectors

#: Eigenvalues under this share of the largest are rounding, not variance.
NULL_SHARE = 1e-13


@dataclass
class Whitening:
    """Fit of distinct vectors: their number, sums and trace, the components as columns, and how it went."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int = 0
    residual: float = 0.0
    breakdowns: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from n x - S in whole numbers where they fit."""
        if self._fits(x):
            return (x * np.int64(self.n) - np.array(self.sums, np.int64)) / float(self.n)
        return ((x.astype(object) * self.n - np.array(self.sums, object)) / self.n).astype(float)

    def _fits(self, x: np.ndarray) -> bool:
        return not x.size or int(np.abs(x).max()) * self.n + max(map(abs, self.sums), default=0) < 1 << 62

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        most = (int(np.abs(x).max()) if x.size else 0) * self.n + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            d = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) for v in (d * d).sum(axis=1)]

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _summed(rows: DataFrame, of_batch, shape: tuple[int, int]) -> np.ndarray:
    """Sum of a matrix per task, itself the sum of ``of_batch`` over the task's batches; Spark adds the tasks' up by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            total += of_batch(rows_of(b.column(0)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    found = np.zeros(shape[0] * shape[1])
    for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # shape[0] * shape[1] rows
        found[r["at"]] = r["v"]
    return found.reshape(shape)


def fit(distinct: DataFrame, components: int = 4, block: int = 8, tolerance: float = 1e-11, seed: int = 5) -> Whitening | None:
    """Leading eigenpairs of the covariance of the rows ``x`` (distinct whole vectors of one length); None without rows."""
    size = distinct.select(F.size("x").alias("d")).first()
    if size is None:
        return None
    d = size["d"]
    totals = distinct.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()  # d rows
    n, sums = (totals[0]["n"] if totals else 0), [int(r["s"]) for r in sorted(totals, key=lambda r: r["at"])]
    model = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)))
    if not d:
        return model
    shares = distinct.mapInArrow(lambda batches: _deviation_parts(batches, model), "part string").collect()  # a number per task
    model.trace = sum(int(r["part"]) for r in shares) / n**2 / n

    def times(q: np.ndarray) -> np.ndarray:
        def of_batch(x: np.ndarray) -> np.ndarray:
            c = model.centred(x)
            return c.T @ (c @ q)

        model.passes += 1
        return _summed(distinct, of_batch, q.shape) / n

    rng, block = np.random.default_rng(seed), min(max(block, components), d)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    q = np.linalg.qr(rng.standard_normal((d, block)))[0]
    while True:
        w = times(q)
        basis, image = np.hstack([basis, q]), np.hstack([image, w])
        t = basis.T @ image
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1][:components], y[:, ::-1][:, :components]
        ritz, scale = basis @ y, max(float(values[0]), 0.0) if len(values) else 0.0
        residuals = np.linalg.norm(image @ y - ritz * values, axis=0)
        # Of each pair relative to its own value; of small values no more than rounding leaves of the largest.
        model.residual = float((residuals / np.maximum(values, 1e-4 * scale)).max()) if scale else 0.0
        if basis.shape[1] >= d or (len(values) == components and scale and model.residual <= tolerance and basis.shape[1] > block):
            break
        q, lost = _next_block(w, basis, min(block, d - basis.shape[1]), max(scale, np.finfo(float).tiny), rng)
        model.breakdowns += lost
    real = values > max(NULL_SHARE * scale, 0.0)
    model.values, model.vectors = values[real], np.linalg.qr(ritz[:, real])[0] if real.any() else np.zeros((d, 0))
    return model


def _next_block(w: np.ndarray, basis: np.ndarray, width: int, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    """Orthonormal block of ``width`` next to ``basis``: what is new in ``w``, and fresh directions where nothing is."""
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    new = u[:, s > 1e-13 * scale][:, :width]
    lost = new.shape[1] < width
    if lost:
        new = np.hstack([new, rng.standard_normal((len(basis), width - new.shape[1]))])
    for _ in range(2):
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
    return new, lost


def _deviation_parts(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    total = sum(sum(model.deviations(rows_of(b.column(0)).astype(np.int64))) for b in batches)
    yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["part"])


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the projections minus the identity."""
    k = len(model.values)

    def of_batch(x: np.ndarray) -> np.ndarray:
        z = model.project(x)
        return np.vstack([z.T @ z, z.sum(axis=0)])

    found = _summed(distinct, of_batch, (k + 1, k)) / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max()) if k else 0.0


def whiten(rows: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component; ``options`` go to ``fit``."""
    held: list[str] = []
    spark = rows.sparkSession
    kept = materialise(whole_vectors(rows, scale, id_col, vector_col), "vectors")
    distinct = materialise(kept.select("x").distinct(), "distinct", held)
    model = fit(distinct, components, **options)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        drop_all(spark, held)
        return spark.createDataFrame([], schema)
    off, k = identity_error(distinct, model), len(model.values)
    drop_all(spark, held)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rows_of(b.column(1)).astype(np.int64)
            m = len(x)
            deviation = pa.array([v if v < 1 << 63 else None for v in model.deviations(x)], pa.int64())
            every = np.repeat(np.arange(m), k)
            columns = [b.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation.take(pa.array(every)), pa.array(model.project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, off))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(run, schema)
