"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it is b - 1 modulo the block size b; each
chunk leaves one character of the signature. b is the least 3 * 2^i for which the text has at most
``length`` blocks on average, halved while the signature stays under half that length. A second
signature is taken at 2 b, so texts of neighbouring block sizes compare. A fingerprint reads
``b:signature:signature at 2b``.

Likeness (0 to 1) is taken where block sizes agree: one minus the edit distance (insertions and
deletions) of the signatures over their summed length, runs over three characters shortened
first; the best of the compatible pairs counts, nothing when they share no three characters in
a row. Equal fingerprints are alike at 1.

Defined results: null and empty texts have the fingerprint ``3::``, alike to one another only; a
fingerprint depends on the text alone, so repeated rows agree; in ``with_next`` rows of equal ids
follow each other in the order of a hash of their texts (of equal ones in that of the texts), null
ids come first, and a single row is its own next; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionflow.llm.common import let

SMALLEST, LENGTH, WINDOW = 3, 64, 7
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_RUN = re.compile(r"(.)\1{3,}", re.S)
_STEP = 1 << 20


def rolling(data: np.ndarray, before: np.ndarray) -> np.ndarray:
    """32-bit rolling hash at each byte of ``data``; ``before``: up to six bytes that precede it."""
    pad = np.zeros(WINDOW - 1, np.uint32)
    if len(before):
        pad[-len(before) :] = before
    c = np.concatenate([pad, data.astype(np.uint32)])
    n = len(data)
    total, weighted, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for k in range(WINDOW):  # k bytes back
        x = c[WINDOW - 1 - k : WINDOW - 1 - k + n]
        total += x
        weighted += x * np.uint32(WINDOW - k)
        mixed ^= x << np.uint32(5 * k)
    return total + weighted + mixed


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the sums over all residues."""
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def _signature(data: bytes, ends: np.ndarray, most: int) -> str:
    """One character per chunk; chunks past ``most`` - 1 end together with the text."""
    ends = ends[: most - 1].tolist()
    start, out = 0, []
    for end in ends:
        out.append(ALPHABET[xxhash.xxh32_intdigest(data[start:end]) & 63])
        start = end
    if start < len(data):
        out.append(ALPHABET[xxhash.xxh32_intdigest(data[start:]) & 63])
    return "".join(out)


def _chunk_ends(raw: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks at block sizes of 3 * ``least`` and more, and for each the largest i with an end at 3 * i.

    With h = 3 q + r, h is b - 1 modulo b = 3 * 2^i exactly if r is 2 and the last i bits of q are ones.
    """
    ends, levels = [], []
    for at in range(0, len(raw), _STEP):
        h = _mix(rolling(raw[at : at + _STEP], raw[max(0, at - WINDOW + 1) : at]))
        q = h // np.uint32(SMALLEST)
        low = ~q & (q + np.uint32(1))
        here = np.flatnonzero((h % np.uint32(SMALLEST) == SMALLEST - 1) & (low >= np.uint32(least)))
        ends.append(here + at + 1)
        levels.append(low[here])
    return np.concatenate(ends), np.concatenate(levels)


def fingerprint(text: str | None) -> str:
    """Fingerprint of one whole text."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return f"{SMALLEST}::"
    raw = np.frombuffer(data, np.uint8)
    scale = 1  # block size over the smallest
    while scale * SMALLEST * LENGTH < len(data):
        scale *= 2
    least = max(1, scale // 8)
    ends, level = _chunk_ends(raw, least)
    first = _signature(data, ends[level >= scale], LENGTH)
    while scale > 1 and len(first) < LENGTH // 2:
        scale //= 2
        if scale < least:  # rarely: uniform text
            least = 1
            ends, level = _chunk_ends(raw, least)
        first = _signature(data, ends[level >= scale], LENGTH)
    return f"{SMALLEST * scale}:{first}:{_signature(data, ends[level >= 2 * scale], LENGTH // 2)}"


def common_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    a, b = _RUN.sub(r"\1\1\1", a), _RUN.sub(r"\1\1\1", b)
    if not a or not b:
        return 0.0
    thirds = {a[i : i + 3] for i in range(len(a) - 2)}
    if thirds.isdisjoint(b[i : i + 3] for i in range(len(b) - 2)):
        return float(a == b)
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1 by edit distance at compatible block sizes."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        return max(_alike(x1, y1), _alike(x2, y2))
    if bx == 2 * by:
        return _alike(x1, y2)
    return _alike(x2, y1) if by == 2 * bx else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, fingerprint, edited, edited_fingerprint, near_edited, near_next).

    The text meets the next row by ascending id (the first after the last) in one shuffle: quantiles
    of the ids cut the table into buckets, and the first row of each bucket goes along, once more,
    to the bucket before it. An id that fills more than one bucket, null for instance, is dealt to
    as many by the hash of the text. ``edited`` is the text with its last quarter replaced by the next one's
    beginning of that length.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", F.lit([i / buckets for i in range(1, buckets)]), max(10_000, 4 * buckets)).alias("c")).first()["c"] if buckets > 1 else []
    times = Counter(cuts or [])
    cuts = sorted(times)
    # A cut that comes up m times is an id that fills m buckets: its rows go to m of them by their hash, larger ids to one more.
    parts = [1] + [times[c] if times[c] > 1 else 0 for c in cuts]
    offsets = list(accumulate((m + 1 if k and m else 1 for k, m in enumerate(parts)), initial=0))
    count = offsets.pop()
    rows = rows.withColumn("hash", F.xxhash64("text"))
    bucket = F.lit(0)
    if cuts:  # binary search
        bounds, steps = F.lit(cuts), F.lit([1 << i for i in reversed(range(len(cuts).bit_length()))])
        bucket = F.aggregate(steps, F.lit(0), lambda acc, step: F.when(F.col("id") >= F.get(bounds, acc + step - 1), acc + step).otherwise(acc))

        def part_of(b: Column) -> Column:
            many = F.get(F.lit(parts), b)
            own = F.least(F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * many).cast("int"), many - 1)
            inside = F.when((b == 0) | (many == 0), 0).when(F.col("id") == F.get(bounds, b - 1), own).otherwise(many)
            return F.get(F.lit(offsets), b) + inside

        bucket = let(bucket, part_of)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    firsts = sorted((r["bucket"], r["first"]["id"], r["first"]["hash"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("id", "hash")).alias("first")).collect())  # one row per bucket
    head, mark_of, before = [None] * count, [None] * count, [0] * count
    for k, (b, i, h) in enumerate(firsts):
        head[b], mark_of[b], before[b] = i, h, firsts[k - 1][0]
    known = lambda values: F.get(F.array(*[F.lit(x).cast("long") for x in values]), F.col("bucket"))
    leads = (F.col("id") == known(head)) & (F.col("hash") == known(mark_of))
    own, ahead = F.struct("bucket", F.lit(0).alias("copy")), F.struct(F.get(F.lit(before), F.col("bucket")).alias("bucket"), F.lit(1).alias("copy"))
    dealt = rows.select("id", "hash", "doc_id", "text", F.explode(F.when(leads, F.array(own, ahead)).otherwise(F.array(own))).alias("to"))
    ordered = dealt.repartitionById(count, F.col("to.bucket")).sortWithinPartitions("to", "id", "hash", "text").select("to.bucket", "to.copy", "doc_id", "text")
    names = ["doc_id", "text", "fingerprint", "edited", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = None, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), *[pa.string()] * 4, pa.float64(), pa.float64()], strict=True)], names)

        for b in batches:
            for bucket, copy, doc_id, text in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                bucket, copy, text = bucket.as_py(), copy.as_py(), text.as_py()
                if held is not None and held[0] != bucket:
                    held = None
                if copy and held is None:
                    continue  # further rows of the id that heads the next bucket
                mark = fingerprint(text)
                if held is not None:
                    _, own_id, own, own_mark = held
                    n = len(own) // 4
                    edited = own[: len(own) - n] + text[:n]
                    other = fingerprint(edited)
                    out.append((own_id, own, own_mark, edited, other, likeness(own_mark, other), likeness(own_mark, mark)))
                    size += len(own)
                    if size > 4 << 20:
                        yield flush()
                        out, size = [], 0
                held = None if copy else (bucket, doc_id.as_py(), text, mark)
        if out:
            yield flush()

    return ordered.mapInArrow(run, "doc_id long, text string, fingerprint string, edited string, edited_fingerprint string, near_edited double, near_next double")
