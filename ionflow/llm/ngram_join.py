"""Exact similarity join of word n-gram sets by size-banded tiles and hashed bitmaps.

A text's set holds its distinct shingles as 64-bit numbers, mixed from the hashes of their words. Equal sets
are one class, and only classes are joined. Two sets of similarity s >= t share at least the t-th
part of the larger one, so, in any order of all shingles, the first n - ceil(t n) + 1 of both meet:
a class enters one tile for each of these. The order puts common shingles last, so that a passage
of many documents makes tiles only of those that consist of little else. Shingles count as common
by their number in stretches of ``STRETCH`` shingles, over all documents; the most common ones are
kept, 2^18 at most. The order bears on the cost alone, never on the result.

Tiles of the same members are kept once. A tile is cut into bands by size, each as wide as the
similarity allows, and a band meets itself and the next one. There each class brings a bitmap of
its shingles' hashes, of two to four bits a shingle: every bit that one has and the other lacks is a shingle
outside the intersection, so bit counts bound the overlap from above. What may still be similar
is tied together, and within these groups similarity is settled by intersecting the sorted arrays
of shingles, which only these classes bring along. Both steps yield spanning forests, not pairs.

Defined results: null text counts as empty; a text without words has an empty set, linked with
nothing, not even its like, and is its own component; fewer words than the shingle length make one
shingle of the whole sequence; repeated rows are linked; a row without an id never lends its
(missing) id to a component, and is null where no row of the component has one; columns other than
id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionflow.llm.common import drop_all, materialise, slices
from ionflow.llm.covering_simhash import Near, _bucket_edges, components

STRETCH = 1 << 21
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


class _Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def shingle_sets(texts: list[str | None], shingle: int, words: dict) -> list[np.ndarray]:
    """Sorted distinct shingles of whole texts."""
    split = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    lengths = np.array([len(w) for w in split])
    h = np.fromiter((words[w] for ws in split for w in ws), np.uint64, int(lengths.sum()))
    out = []
    for end, n in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
        own = h[end - n : end]
        k = min(shingle, n)
        x = np.full(n - k + 1 if n else 0, k, np.uint64)
        for i in range(k):
            x = (x ^ own[i : n - k + 1 + i]) * _MIX[i % 3]
            x ^= x >> np.uint64(29 + i % 3)
        out.append(np.unique(x))
    return out


def _sets(batches: Iterator[pa.RecordBatch], column: int, shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    words = _Words()
    for b in batches:
        for start, end in slices(b.column(column), 2 << 20):
            part = b.slice(start, end - start)
            yield part, shingle_sets(part.column(column).to_pylist(), shingle, words)


def common_shingles(docs: DataFrame, shingle: int, least: int = 3, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, sorted, and the rank of each: the more common, the higher.

    Each stretch of a task's shingles reports those it has ``least`` times and more; the sums order
    them, and the first ``most`` are kept, whatever the input's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[n >= least].view(np.int64)), pa.array(n[n >= least])], ["shingle", "n"])

        size = 0
        for _, sets in _sets(batches, 0, shingle):
            held += sets
            size += sum(map(len, sets))
            if size >= STRETCH:
                yield counted()
                size = 0
        yield counted()

    found = docs.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.col("n").desc(), "shingle").limit(most).toPandas()  # at most ``most`` rows
    values = top["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.arange(len(values), 0, -1)[order]


def prefix(grams: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles of a set in the order of all shingles."""
    n = len(grams)
    if not n:
        return grams
    values, rank = common
    order = np.zeros(n, np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
        order = np.where(values[at] == grams, rank[at], 0)
    return grams[np.lexsort((grams, order))][: n + (-percent * n // 100) + 1]


def bitmap(grams: np.ndarray) -> bytes:
    """Two to four bits a shingle, a power of two and 64 at least; the upper half can be laid over the lower one."""
    bits = max(64, 1 << (2 * len(grams) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(grams & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def overlap_bound(a: np.ndarray, size_a: int, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most shingles that a set with bitmap ``a`` can share with each of ``b``: all but those whose bit the other lacks."""
    only_a, only_b = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
    return np.minimum(size_a - only_a, size_b - only_b)


def _linked(both: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def may_link(percent: int):
    """Rows whose sizes and bitmaps allow a link with row ``i``; bitmaps are laid over to the tile's narrowest."""

    def compare(size: np.ndarray, sign: np.ndarray) -> Near:
        size = size.astype(np.int64)
        width = min(map(len, sign)) // 8
        bits = np.stack([np.bitwise_or.reduce(np.frombuffer(s, np.uint64).reshape(-1, width)) for s in sign])

        def near(i: int, rows: np.ndarray) -> np.ndarray:
            rows = rows[100 * np.minimum(size[rows], size[i]) >= percent * np.maximum(size[rows], size[i])]
            return rows[_linked(overlap_bound(bits[i], size[i], bits[rows], size[rows]), size[i], size[rows], percent)]

        return near

    return compare


def do_link(percent: int):
    """Rows that link with row ``i``, by the exact intersection of sorted arrays."""

    def compare(grams: np.ndarray) -> Near:
        sets = [np.frombuffer(g, np.uint64) for g in grams]
        size = np.array([len(x) for x in sets], np.int64)

        def near(i: int, rows: np.ndarray) -> np.ndarray:
            own = sets[i]
            rows = rows[100 * np.minimum(size[rows], size[i]) >= percent * np.maximum(size[rows], size[i])]
            both = np.zeros(len(rows), np.int64)
            for s in range(0, len(rows), 256):
                part = rows[s : s + 256]
                others = np.concatenate([sets[r] for r in part])
                at = np.minimum(np.searchsorted(own, others), len(own) - 1)
                both[s : s + 256] = np.add.reduceat(own[at] == others, np.cumsum(size[part]) - size[part], dtype=np.int64)
            return rows[_linked(both, size[i], size[rows], percent)]

        return near

    return compare


def tiles(classes: DataFrame, percent: int, held: list[str]) -> DataFrame:
    """(key, n, node): tiles of two classes and more; of tiles with the same members one stays.

    Rows are dealt by shingle once and by tile once; counts and rows come from the same exchange.
    """
    keyed = classes.select("node", "size", F.explode("prefix").alias("shingle")).repartition("shingle")
    shared = keyed.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = keyed.join(shared.hint("merge"), "shingle")
    band = F.floor(F.log(F.col("size")) / F.lit(float(-np.log(percent / 100) * (1 + 1e-9)))).cast("long")
    banded = materialise(rows.select(F.explode(F.array(F.xxhash64("shingle", band), F.xxhash64("shingle", band + 1))).alias("key"), "node"), "banded", held).repartition("key")
    sums = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (0, 1)]).where("n > 1")
    chosen = materialise(sums.groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n"), "chosen", held)
    return banded.join(chosen.hint("merge"), "key").select("key", "n", "node")


def similar(docs: DataFrame, shingle: int = 4, percent: int = 85, block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: components of the links 100 * intersection >= ``percent`` * union, named by their smallest id."""
    held: list[str] = []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common = common_shingles(rows.select("text"), shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, sets in _sets(batches, 1, shingle):
            nodes = [xxhash.xxh64_intdigest(x.tobytes(), 1) for x in sets]
            # The first row of a class in a task brings its prefix and bitmap, if it isn't empty.
            new = [len(x) > 0 and not (node in seen or seen.add(node)) for node, x in zip(nodes, sets, strict=True)]
            first = [pa.array([prefix(x, percent, common).view(np.int64) if k else None for k, x in zip(new, sets, strict=True)], pa.list_(pa.int64())), pa.array([bitmap(x) if k else None for k, x in zip(new, sets, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), *first], ["doc_id", "node", "size", "prefix", "sign"])

    marks = materialise(rows.mapInArrow(run, "doc_id long, node long, size long, prefix array<long>, sign binary"), "marks", held)
    # A class may have been met by several tasks: one of its equal prefixes and bitmaps stays.
    firsts = marks.where("prefix IS NOT NULL").groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("sign").alias("sign"))
    classes = materialise(firsts, "classes", held)
    members = tiles(classes, percent, held).join(classes.select("node", "size", "sign").hint("merge"), "node").select("key", "n", "node", "size", "sign")
    candidates = materialise(components(_bucket_edges(members, may_link(percent), block, held).distinct()), "candidates", held)

    sizes = candidates.groupBy(F.col("root").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    inside = candidates.withColumnRenamed("root", "key").join(sizes.hint("merge"), "key")
    # Residues of the candidates, a million at most, keep most other documents' shingles from being shuffled.
    residue = lambda c: F.pmod(c, F.lit(1 << 20))
    few = candidates.select(residue(F.col("node")).alias("residue")).distinct()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, sets in _sets(batches, 0, shingle):
            nodes = [xxhash.xxh64_intdigest(x.tobytes(), 1) for x in sets]
            new = [(node, x) for node, x in zip(nodes, sets, strict=True) if len(x) and not (node in seen or seen.add(node))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([n for n, _ in new], np.uint64).view(np.int64)), pa.array([x.tobytes() for _, x in new], pa.binary())], ["node", "grams"])

    grams = rows.select("text").mapInArrow(shingled, "node long, grams binary").withColumn("residue", residue(F.col("node")))
    grams = grams.join(F.broadcast(few), "residue", "left_semi").join(inside.hint("merge"), "node").groupBy("node").agg(F.first("key").alias("key"), F.first("n").alias("n"), F.first("grams").alias("grams"))
    texts = materialise(grams, "grams", held)
    roots = materialise(components(_bucket_edges(texts.select("key", "n", "node", "grams"), do_link(percent), max(1, block // 4), held)), "roots", held)

    least = marks.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    found = least.join(roots.hint("merge"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    labels = materialise(found.join(found.groupBy("root").agg(F.min("first").alias("component_id")).hint("merge"), "root").select("node", "component_id"), "labels")
    result = marks.select("doc_id", "node", "size").join(labels.hint("merge"), "node", "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = materialise(result, "similar")
    drop_all(docs.sparkSession, held)
    return out
