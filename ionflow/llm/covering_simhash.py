"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: the majority bits of the XXH64 values of its word shingles.
For radius r, every position of the fingerprint gets a vector of r + 1 bits; each non-zero
vector v of r + 1 bits gives one table that keeps the positions whose vector has an odd product
with v. Positions in which two fingerprints within r differ give at most r linear equations in
r + 1 unknowns, so some v solves them all: that table keeps none of these positions, and the
pair collides there. Hence 2^(r+1) - 1 tables lose no pair.

Only distinct fingerprints enter the tables; copies ride on their class. A bucket is compared
within itself and yields a spanning forest, never its pairs. Buckets above ``block`` members are
dealt out as pairs of blocks; buckets above ``wide`` go by midpoints: two fingerprints within r
have a point within ceil(r/2) of both, and all members around one point are linked to each other
(for even r), so a star around each point is exact and grows linearly.

Defined results: null text counts as empty; a text without words has fingerprint zero and is
linked like any other; fewer words than the shingle length make one shingle of the whole
sequence; repeated rows and ties share a fingerprint and hence a component; an empty table gives
an empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionflow.llm.common import drop_all, drop_path, free_name, materialise, scratch_path

BITS = 64
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)), repeat(seed))
    counts = np.zeros(BITS, np.int64)
    for start in range(0, n, _CHUNK):
        h = np.fromiter(hashes, np.uint64, min(_CHUNK, n - start))
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks over 64 bits; any two words within ``radius`` agree under one of them."""
    size = (1 << (radius + 1)) - 1
    rng = np.random.default_rng(seed)
    vectors = rng.permutation(np.resize(np.arange(1, size + 1), BITS))  # every vector about equally often
    return [sum(1 << i for i, x in enumerate(vectors) if int(x & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _words(rows: np.ndarray, kind: type = np.uint64) -> np.ndarray:
    """Binary values of equal length as rows of numbers."""
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


#: Rows of a bucket that are near row i, out of some others.
Near = Callable[[int, np.ndarray], np.ndarray]


def _within(signs: np.ndarray, limit: int) -> Near:
    """Rows of 64-bit words that differ from row ``i`` in at most ``limit`` bits."""
    return lambda i, rows: rows[np.bitwise_count(signs[rows] ^ signs[i]).sum(axis=1, dtype=np.int32) <= limit]


def _forest(nodes: np.ndarray, near: Near, first: int | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``nodes``, or of those of the ``first`` ones with any.

    Rows of one ``label`` are linked already. The search spreads over the links, so a row is only
    compared with rows that no search has reached: a group of which one row is near to all costs
    one comparison a row.
    """
    label = np.arange(len(nodes)) if label is None else np.unique(label, return_inverse=True)[1]
    by_label, starts = np.argsort(label, kind="stable"), np.searchsorted(np.sort(label), np.arange(label.max() + 2 if len(label) else 1))
    members = lambda x: by_label[starts[x] : starts[x + 1]]
    left = np.ones(len(nodes), bool)
    edges = []
    for seed in range(len(nodes)):
        if not left[seed]:
            continue
        stack = members(label[seed]).tolist()
        left[stack] = False
        while stack:
            i = stack.pop()
            rows = np.flatnonzero(left if first is None or i < first else left[:first])
            found = near(i, rows) if len(rows) else rows
            labels, at = np.unique(label[found], return_index=True)
            for x, j in zip(labels.tolist(), found[at].tolist(), strict=True):
                edges.append((int(nodes[i]), int(nodes[j])))
                more = members(x)
                left[more] = False
                stack += more.tolist()
        if not left.any():
            break
    return edges


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Runs of two and more equal (key, task) in batches that are sorted by them, as their other columns; binary ones as arrays of bytes objects."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        key, task = cols[0], cols[1]
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (task[1:] != task[:-1])) + 1
        bounds = [0, *cuts.tolist()]
        for s, e in zip(bounds, bounds[1:], strict=False):
            if e - s > 1:
                yield [c[s:e] for c in cols[2:]]
        held = [c[bounds[-1] :] for c in cols]
    if held is not None and len(held[0]) > 1:
        yield held[2:]


def _compare(dealt: DataFrame, compare_with: Callable[..., Near]) -> DataFrame:
    """Edges (a, b) found by ``_forest`` in every task of ``dealt``: key, task, node, label, side (0: the first ones, null: all) and columns for ``compare_with``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, label, side, *held in _groups(batches):
            order = np.argsort(side, kind="stable")
            first = None if side.min() < 0 else int((side == 0).sum())
            edges = [e for e in _forest(node[order], compare_with(*[x[order] for x in held]), first, label[order]) if e[0] != e[1]]
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.repartition("key", "task").sortWithinPartitions("key", "task").mapInArrow(compare, "a long, b long")


def _pair_edges(members: DataFrame, compare_with: Callable[..., Near], block: int) -> DataFrame:
    """Edges (a, b) within buckets; ``members``: key, n (the bucket's size), node and columns for ``compare_with``.

    A bucket is dealt out as pairs of blocks of about ``block`` members; each is one unit of work
    and gives a spanning forest of its links.
    """
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    part = F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct((F.least(part, j) * parts + F.greatest(part, j)).alias("task"), F.when(part == j, -1).when(part < j, 0).otherwise(1).alias("side")))
    marks = [c for c in members.columns if c not in ("key", "n", "node")]
    dealt = members.select("key", F.explode(tasks).alias("t"), "node", *marks)
    return _compare(dealt.select("key", "t.task", "node", F.col("node").alias("label"), "t.side", *marks), compare_with)


def _minor_edges(members: DataFrame, compare_with: Callable[..., Near], block: int) -> DataFrame:
    """Edges between the ``minor`` members of a bucket, of which there are ``u``, and all its ``n`` members: every minor block meets every block."""
    parts, few = (F.ceil(F.col(c) / F.lit(block)).cast("int") for c in ("n", "u"))
    part, own = F.pmod(F.xxhash64("node"), parts.cast("long")).cast("int"), F.pmod(F.xxhash64("node"), few.cast("long")).cast("int")
    as_any = F.transform(F.sequence(F.lit(0), few - 1), lambda m: F.struct((m * parts + part).alias("task"), F.lit(1).alias("side")))
    as_minor = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct((own * parts + j).alias("task"), F.lit(0).alias("side")))
    marks = [c for c in members.columns if c not in ("key", "n", "u", "minor", "node", "label")]
    dealt = members.select("key", F.explode(F.when(F.col("minor"), F.concat(as_any, as_minor)).otherwise(as_any)).alias("t"), "node", "label", *marks)
    return _compare(dealt.select("key", "t.task", "node", "label", "t.side", *marks), compare_with)


def _bucket_edges(members: DataFrame, compare_with: Callable[..., Near], block: int, held: list[str] | None = None, leaders: int = 16) -> DataFrame:
    """Edges (a, b) whose components are those of all links within buckets; ``members`` as for ``_pair_edges``.

    Buckets up to ``block`` members are compared in one task each. Of wider ones ``leaders`` members
    are compared with all, which links most of a large group of copies at a cost in proportion to
    it; then only those outside the bucket's largest group so far, the minor members, are still
    compared with all, so that no link between groups is lost.
    """
    edges = _pair_edges(members.where(F.col("n") <= block), compare_with, block)
    if members.where(F.col("n") > block).isEmpty():
        return edges
    wide = materialise(members.where(F.col("n") > block), "wide", held)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
    leading = wide.select("key", "node").withColumn("rank", rank).where(F.col("rank") <= leaders).select("key", "node", F.lit(True).alias("minor"))
    led = wide.join(leading.hint("merge"), ["key", "node"], "left").withColumns({"minor": F.coalesce("minor", F.lit(False)), "u": F.lit(leaders), "label": F.col("node")})
    star = materialise(_minor_edges(led, compare_with, block), "stars", held)
    known = materialise(components(star), "known", held)
    labelled = wide.join(known.hint("merge"), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    largest = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max(F.struct("size", "label")).alias("top"))
    rest = labelled.join(largest.hint("merge"), "key").where("n > top.size").withColumns({"minor": F.col("label") != F.col("top.label"), "u": F.col("n") - F.col("top.size")}).drop("top")
    return edges.union(star).union(_minor_edges(rest, compare_with, block))


def _shared(keyed: DataFrame, tag: str, held: list[str] | None = None) -> DataFrame:
    """Rows (key, ...) whose key is not theirs alone, with the bucket's size ``n``.

    How many keys are shared has no bound, so they are merged and never broadcast.
    """
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialise(keyed.join(sizes.hint("merge"), "key"), tag, held)


def links(fps: DataFrame, radius: int = 4, block: int = 2048, wide: int = 1 << 17) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``; their components are those of all pairs within ``radius``."""
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)])
    shared = _shared(fps.select("fp", F.explode(keys).alias("key")), "buckets")
    members = shared.where(F.col("n") <= wide).select("key", "n", F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("sign"))
    edges = _pair_edges(members, lambda sign: _within(_words(sign), radius), block)

    # Wider buckets: a star around every midpoint.
    hot = shared.where(F.col("n") > wide).select("fp").distinct()
    flips = [0, *(sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(BITS), k))]
    if not hot.isEmpty():
        flips_df = np.array(flips, np.uint64).view(np.int64)

        def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for fp in b.column(0).to_numpy():
                    yield pa.RecordBatch.from_arrays([pa.array(flips_df ^ fp), pa.array(np.full(len(flips_df), fp))], ["z", "fp"])

        points = hot.mapInArrow(around, "z long, fp long")
        stars = points.groupBy("z").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
        edges = edges.union(points.join(stars, "z").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")))
    return edges.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): ``root`` is the smallest node it reaches.

    Alternating large-star and small-star rounds: each is a minimum per node and a join, no
    neighbourhood is ever gathered; every round ends in a written table.
    """
    spark = edges.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "star")
        df.write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path), path

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e, path = write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        mid, mid_path = write(large)
        down = mid.groupBy("a").agg(F.min("b").alias("m"))
        small = mid.join(down.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        nxt, nxt_path = write(small.where("a <> b").distinct())
        drop_path(spark, mid_path)
        drop_path(spark, path)
        e, path = nxt, nxt_path
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per input row; ``component_id`` is the smallest doc_id reachable by links within ``radius``."""
    marks = materialise(fingerprints(docs, shingle, seed, id_col, text_col), "simhash")
    classes = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    comp = components(links(classes.select("fp"), radius))
    labelled = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = labelled.join(lowest, "root").select("fp", "component_id")
    return marks.join(label, "fp").select("doc_id", "fp", "component_id")


#: Odd numbers to mix hashes with.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    grams = set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) if len(words) >= shingle else {b" ".join(words)} if words else set()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, len(grams)))


def minima(hashes: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """``count`` MinHash values of 32 bits: each agrees between two sets with the probability of their Jaccard similarity."""
    rng = np.random.default_rng(seed)
    mix = rng.integers(0, 1 << 63, (3, count), np.uint64)
    out = np.full(count, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 4096):
        x = (hashes[start : start + 4096, None] ^ mix[0]) * (mix[1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= mix[2] | np.uint64(1)
        out = np.minimum(out, x.min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _alike(sets: list[np.ndarray], similarity: float) -> Near:
    """Rows whose sets of distinct hashes have a Jaccard similarity of ``similarity`` and more with that of row ``i``; empty sets are equal.

    An inverted index gives the intersections with all rows at once.
    """
    size = np.array([len(x) for x in sets], np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    gram = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)[np.argsort(gram, kind="stable")]
    ends = np.cumsum(np.bincount(gram))

    def near(i: int, rows: np.ndarray) -> np.ndarray:
        own = gram[bounds[i] : bounds[i + 1]]
        starts = np.where(own > 0, ends[own - 1], 0)
        n = ends[own] - starts
        both = np.bincount(owner[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))[rows]
        return rows[both >= similarity * (size[i] + size[rows] - both)]

    return near


def packed(hashes: np.ndarray) -> bytes:
    """The distinct upper 40 bits of sorted hashes: two shingles of a pair of texts with some thousand meet in about one pair of a hundred thousand."""
    return np.unique(hashes >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def covering_positions() -> list[list[int]]:
    """The positions that each of 7 tables keeps of 7 symbols: the construction of ``covering_masks`` for radius 2."""
    return [[i for i in range(7) if ((i + 1) & v).bit_count() % 2] for v in range(1, 8)]


def _near_classes(docs: DataFrame, shingle: int, similarity: float, rounds: int, least: float, block: int, id_col: str, text_col: str, held: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, node) of the documents, and (node, lead) of their classes: ``lead`` is the least (missing, doc_id, key) of the component.

    ``key`` is a hash of the whole text, ``node`` one of its set of shingles.
    """
    count = 7 * rounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40  # a number of its own for every row
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                sets = [shingles(t.as_py(), shingle) for t in part.column(2)]
                nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), 1) for x in sets], np.uint64).view(np.int64)
                columns = [part.column(0), part.column(1), pa.array(np.arange(row, row + len(sets))), pa.array(nodes), pa.array([len(x) for x in sets], pa.int32()), pa.array([minima(x, count).tobytes() for x in sets], pa.binary()), pa.array([packed(x) for x in sets], pa.binary())]
                row += len(sets)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "row", "node", "size", "sign", "grams"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [[7 * r + i for i in kept] for r in range(rounds) for kept in covering_positions()]
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                values = _words(part.column(1).to_pylist(), np.uint32).astype(np.uint64)
                keys = np.empty((len(values), len(tables)), np.uint64)
                for t, kept in enumerate(tables):
                    x = np.full(len(values), t + 1, np.uint64)
                    for i in kept:
                        x = (x ^ values[:, i]) * _ODD[i % 8]
                        x ^= x >> np.uint64(31)
                    keys[:, t] = x
                node = np.repeat(part.column(0).to_numpy(), len(tables))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys.ravel().view(np.int64))], ["node", "key"])

    def agree(sign: np.ndarray, size: np.ndarray) -> Near:
        values = _words(sign, np.uint32)

        def near(i: int, rows: np.ndarray) -> np.ndarray:
            n = size[rows]
            rows = rows[np.minimum(n, size[i]) >= similarity * np.maximum(n, size[i])]
            return rows[(values[rows] == values[i]).sum(axis=1, dtype=np.int32) >= least * count]

        return near

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    marks = materialise(rows.mapInArrow(run, "doc_id long, key long, row long, node long, size int, sign binary, grams binary"), "marks", held)
    # Equal shingles are one class, whose hash stands for it in all that follows; one row of it brings the shingles.
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key"))
    classes = materialise(marks.groupBy("node").agg(lead.alias("lead"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("sign").alias("sign")), "classes", held)
    shared = _shared(classes.select("node", "sign").mapInArrow(keyed, "node long, key long"), "buckets", held)
    members = shared.join(classes.select("node", "sign", "size").hint("merge"), "node").select("key", "n", "node", "sign", "size")
    wide = materialise(components(_bucket_edges(members, agree, block, held).distinct()), "candidates", held)
    sizes = wide.groupBy(F.col("root").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    inside = wide.withColumnRenamed("root", "key").join(sizes.hint("merge"), "key").join(classes.select("node", "row").hint("merge"), "node")
    texts = materialise(marks.select("row", "grams").join(inside.hint("merge"), "row").select("key", "n", "node", "grams"), "texts", held)
    edges = _bucket_edges(texts, lambda grams: _alike(list(map(unpacked, grams)), similarity), max(1, block // 4), held)
    roots = materialise(components(edges), "roots", held)
    found = classes.select("node", "lead").join(roots.hint("merge"), "node", "left").select("node", "lead", F.coalesce("root", "node").alias("root"))
    labels = found.join(found.groupBy("root").agg(F.min("lead").alias("first")).hint("merge"), "root").select("node", F.col("first").alias("lead"))
    return marks.select("doc_id", "key", "node"), labels


def text_key(text_col: str):
    """Hash of a whole text; null for a null one."""
    text = F.col(text_col).cast("string")
    return F.when(text.isNotNull(), F.xxhash64(text))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, rounds: int = 6, least: float = 0.5, block: int = 2048, id_col: str = "doc_id", text_col: str = "text", held: list[str] | None = None) -> DataFrame:
    """(doc_id, component_id) of near copies: the components of all pairs whose distinct shingles have a Jaccard similarity of ``similarity`` and more.

    A SimHash within a few bits would only tell copies that are almost equal or edited word by word.
    So each round covers 7 MinHash values of the shingles for radius 2: two texts meet in one of its
    7 tables whenever at most 2 of the 7 differ. At 0.8 one round misses 14.8 % of pairs and 6 rounds
    miss 11 in a million, wherever the texts differ. Pairs of a bucket that agree in the share
    ``least`` of all values (at 0.8 fewer agree in about 2 pairs of a million) and whose numbers of
    shingles allow it are candidates, and within components of candidates the pairs are confirmed
    by the similarity of their shingles, each known by 40 bits of its hash; only there are the
    shingles needed.

    Texts without words are copies of one another. A component is named by its smallest id; one in
    which all ids are missing has none. The joins are merged at every size: none of their sides has
    a bound. ``held`` gathers the paths of the scratch tables.
    """
    rows, labels = _near_classes(docs, shingle, similarity, rounds, least, block, id_col, text_col, [] if held is None else held)
    return rows.join(labels.hint("merge"), "node").select("doc_id", F.col("lead.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, rounds: int = 6, least: float = 0.5, block: int = 2048) -> DataFrame:
    """One document (all columns) of each component of ``near_copies``: that with the smallest id, of equal ids that with the smallest hash of its text.

    Rows are told apart by id and text: different texts under one id, or without an id, are judged
    as any others, and a row without an id stays only where no row of its component has one. Of rows
    that repeat id and text of the leader one stays. The leaders are about as many as the documents,
    so they are merged with them and never broadcast.
    """
    held: list[str] = []
    rows, labels = _near_classes(docs, shingle, similarity, rounds, least, block, id_col, text_col, held)
    of, key, many = (free_name(docs, n) for n in ("_of", "_key", "_many"))
    counts = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    chosen = labels.select("lead.doc_id", "lead.key").distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & a["key"].eqNullSafe(b["key"])
    leaders = materialise(chosen.join(counts.hint("merge"), same(chosen, counts)).select(chosen["doc_id"].alias(of), chosen["key"].alias(key), (F.col("n") > 1).alias(many)), "leaders")
    drop_all(docs.sparkSession, held)

    def of_leaders(some: DataFrame) -> DataFrame:
        meet = F.col(id_col).cast("long").eqNullSafe(some[of]) & text_key(text_col).eqNullSafe(some[key])
        return docs.join(some.hint("merge"), meet, "left_semi")

    kept = of_leaders(leaders.where(~F.col(many)))
    again = leaders.where(many)
    if not again.isEmpty():
        repeated = of_leaders(again).withColumns({of: F.col(id_col).cast("long"), key: text_key(text_col)})
        kept = kept.unionByName(repeated.dropDuplicates([of, key]).drop(of, key))
    return kept.select(docs.columns)


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
