"""Compression of vectors to codes by Elkan's variant of Lloyd's algorithm, in whole numbers.

A vector is cut into equal parts; each part position has a codebook of entries. Every round
assigns each part to its nearest entry (squared distance, of equals the lower index) and moves
each entry to the floored mean of its parts. The assignment is a table in the shared folder, written anew
each round: per part the assigned entry, one upper bound of the distance to it, and one lower
bound of the distance to every entry of the codebook.

When entries have moved, lower bounds fall and upper bounds rise by the movement. An entry can be
the nearest, or as near as the nearest, only if neither its lower bound nor half its distance from
the assigned entry is strictly above the upper bound; the upper bound is first made exact where
some entry passes. The rest is decided by exact distances in whole numbers, ties by index. Bounds
are rounded outward, so they prune no entry that plain Lloyd would choose, or that would tie.

Sums and counts of entries are added up per task and then by Spark; a codebook (parts x entries x
length of a part) is all that reaches the driver, and goes to the tasks in their closures.

Defined results: see ``common.whole_vectors`` for the rows that go; entries start with the least
ids, equal ids in the order of their vectors, null ids last; with fewer rows than entries the
codebook has as many entries as rows; entries without parts stay; repeated rows get equal codes.
Columns other than id, vector and label are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionflow.llm.common import drop_all, drop_path, materialise, rows_of, scratch_path, whole_vectors

STEP = 4096
STATE = "vec_id long, x array<long>, label string, code binary, upper binary, lower binary, computed long"


def _kind(x: np.ndarray, entries: np.ndarray) -> type:
    """Doubles, longs or whole numbers of any size: the first in which squared distances are exact."""
    most = max((int(np.abs(a).max()) for a in (x, entries) if a.size), default=0)
    bound = 4 * most * most * x.shape[1]
    return float if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (row, entry) of whole numbers."""
    kind = _kind(x, entries)
    a, c = x.astype(kind), entries.astype(kind)
    if kind is float:
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((a - e) ** 2).sum(axis=1) for e in c], axis=1)


def paired(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows with entries, pair by pair."""
    kind = object if _kind(x, entries) is object else np.int64
    d = x.astype(kind) - entries.astype(kind)
    return (d * d).sum(axis=1)


def _root(squared: np.ndarray, up: bool) -> np.ndarray:
    """Square roots as floats of 32 bits, rounded outward by two steps."""
    r = np.sqrt(squared.astype(float)).astype(np.float32)
    for _ in range(2):
        r = np.nextafter(r, np.float32(np.inf if up else 0))
    return r


class Codebook:
    """Entries (part, entry, position), how far each moved, and half the distances between those of a part."""

    def __init__(self, entries: np.ndarray, last: np.ndarray | None = None):
        self.entries = entries
        self.moved = None if last is None else np.stack([_root(paired(e, o), True) for e, o in zip(entries, last, strict=True)])
        self.half = np.stack([_root(distances(e, e), False) / np.float32(2) for e in entries])

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assign_all(x: np.ndarray, book: Codebook, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, squared distance, upper, lower) of rows that have no bounds yet."""
    d = distances(x, book.entries[part])
    code = d.argmin(axis=1)
    best = d[np.arange(len(d)), code]
    return code, best, _root(best, True), _root(d, False)


def assign_again(x: np.ndarray, book: Codebook, part: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, squared distance of those made exact or -1, upper, lower, distances computed) after the entries moved."""
    moved, half = book.moved[part], book.half[part]
    rows = np.arange(len(x))
    upper = np.nextafter(upper + moved[code], np.float32(np.inf))
    lower = np.maximum(np.nextafter(lower - moved, np.float32(-np.inf)), np.float32(0))
    code, exact = code.copy(), np.full(len(x), -1, np.int64 if x.dtype != object else object)
    open_ = (lower <= upper[:, None]) & (half[code] <= upper[:, None])
    open_[rows, code] = False
    near = np.flatnonzero(open_.any(axis=1))
    computed = len(near)
    if len(near):
        own = paired(x[near], book.entries[part][code[near]])
        exact = exact.astype(own.dtype)
        exact[near], upper[near] = own, _root(own, True)
        lower[near, code[near]] = _root(own, False)
        still = open_[near] & (lower[near] <= upper[near][:, None]) & (half[code[near]] <= upper[near][:, None])
        at, entry = np.nonzero(still)
        for s in range(0, len(at), 1 << 18):
            a, e = near[at[s : s + (1 << 18)]], entry[s : s + (1 << 18)]
            d = paired(x[a], book.entries[part][e])
            computed += len(a)
            lower[a, e] = _root(d, False)
            # Of the candidates of a row the least distance, of equals the lowest index.
            order = np.lexsort((e, d, a)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (a[i], d[i], e[i])), int)  # noqa: B023
            first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])]
            a, e, d = a[first], e[first], d[first]
            better = (d < exact[a]) | ((d == exact[a]) & (e < code[a]))
            a, e, d = a[better], e[better], d[better]
            code[a], exact[a], upper[a] = e, d, _root(d, True)
    return code, exact, upper, lower, computed


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    return x.reshape(len(x), parts, -1).swapaxes(0, 1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            yield b.slice(at, STEP)


def _matrix(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(shape)


def _assigned(state: DataFrame, book: Codebook, parts: int) -> DataFrame:
    """The state with parts assigned to ``book``; without bounds where the state has none."""
    k = book.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            x, m = _parts(rows_of(b.column(1)), parts), b.num_rows
            code, upper, lower, computed = np.empty((m, parts), np.uint16), np.empty((m, parts), np.float32), np.empty((m, parts, k), np.float32), 0
            if book.moved is None:
                for p in range(parts):
                    code[:, p], _, upper[:, p], lower[:, p] = assign_all(x[p], book, p)
                computed = m * parts * k
            else:
                c, u, w = _matrix(b.column(3), np.uint16, (m, parts)), _matrix(b.column(4), np.float32, (m, parts)), _matrix(b.column(5), np.float32, (m, parts, k))
                for p in range(parts):
                    code[:, p], _, upper[:, p], lower[:, p], n = assign_again(x[p], book, p, c[:, p].astype(np.int64), u[:, p], w[:, p])
                    computed += n
            share = np.zeros(m, np.int64)
            share[:1] = computed
            packed = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (code, upper, lower)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *packed, pa.array(share)], STATE_NAMES)

    return state.mapInArrow(run, STATE)


STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


def _means(state: DataFrame, book: Codebook, parts: int) -> np.ndarray:
    """Entries moved to the floored means of their parts."""
    shape = book.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
        for b in _rows(batches):
            x, code = _parts(rows_of(b.column(0)), parts), _matrix(b.column(1), np.uint16, (b.num_rows, parts)).astype(np.int64)
            small = not x.size or int(np.abs(x).max()) <= 1 << 50
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                used, starts = np.unique(code[order, p], return_index=True)
                sums[p, used] += np.add.reduceat((x[p] if small else x[p].astype(object))[order], starts, axis=0).astype(object)
                counts[p] += np.bincount(code[:, p], minlength=shape[1])
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array([list(map(str, sums[i, j])) for i, j in zip(p, e, strict=True)])], ["part", "entry", "n", "s"])

    dealt = state.select("x", "code").mapInArrow(run, "part long, entry long, n long, s array<string>")
    sums = [F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(shape[2])]
    moved = book.entries.copy()
    for r in dealt.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # a codebook
        moved[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(shape[2])]
    return moved


def compress(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", stats: list[int] | None = None) -> DataFrame:
    """(vec_id, code array<int>, error, label_error, codebooks_sha256) of every row; ``stats`` gets the distances computed in each round.

    Vectors whose length is no multiple of ``parts`` are refused. An error beyond a long is null.
    """
    spark, held = rows.sparkSession, []
    schema = "vec_id long, code array<int>, error long, label_error long, codebooks_sha256 string"
    if not 0 < entries <= 1 << 16:
        raise ValueError("a code has 16 bits")
    kept = whole_vectors(rows, scale, id_col, vector_col, F.col(label_col).cast("string").alias("label"))
    kept = materialise(kept.withColumns({c: F.lit(None).cast(t) for c, t in (("code", "binary"), ("upper", "binary"), ("lower", "binary"), ("computed", "long"))}), "vectors", held)
    first = [r["x"] for r in kept.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    if not first or not first[0]:
        drop_all(spark, held)
        return spark.createDataFrame([], schema)
    if len(first[0]) % parts:
        raise ValueError(f"{len(first[0])} entries can't be cut into {parts} parts")
    book, state = Codebook(_parts(np.array(first, np.int64), parts).copy()), kept
    for turn in range(rounds + 1):
        path = scratch_path(spark, "codes")
        _assigned(state, book, parts).write.parquet(path)
        drop_all(spark, held)
        held.append(path)
        state = spark.read.schema(STATE).parquet(path)
        if stats is not None:
            stats.append(state.agg(F.sum("computed")).first()[0])
        if turn < rounds:
            book = Codebook(_means(state, book, parts), book.entries)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            x, code = _parts(rows_of(b.column(1)), parts), _matrix(b.column(3), np.uint16, (b.num_rows, parts)).astype(np.int64)
            error = sum(paired(x[p], book.entries[p][code[:, p]]).astype(object) for p in range(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(code.tolist()), pa.list_(pa.int32())), pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    coded = materialise(state.mapInArrow(final, "vec_id long, label string, code array<int>, error long"), "coded")
    drop_path(spark, path)
    # Labels may be as many as rows, and one may hold most of them: sums are partial before they meet and are not broadcast.
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(book.sha256()).alias("codebooks_sha256"))


def hex_code(code):
    """Two hex digits per part."""
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
