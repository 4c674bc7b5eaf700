"""Language identification by string kernels.

A text is the set of its character n-grams of lengths 1 to ``MAX_N`` (a blended spectrum, presence
only), taken over its letters in lower case with one space between words and hashed to ``BUCKETS``
bits per length. The kernel of two texts sums, over the lengths, the shared n-grams over the
geometric mean of the texts' own numbers.

Training takes a bounded sample (``per_class`` documents of each label, those with the smallest
hash of their id and text, each pair of them once), of which ``landmarks`` per label span a Nyström feature space: K(x, L) times
the inverse square root of K(L, L). One ridge regression per label against all others is solved
there. Scoring multiplies a batch of presence vectors with the landmarks' vectors, scales by the
norms, and multiplies with the weights: two matrix products per batch.

The score is the share of the winning label among the clipped, squared one-versus-rest outputs.

Defined results: a null text and one without letters get ``und`` at score 0; whole texts of any
length are read, in stretches; texts of equal letters get equal results, so repeats and ties do
too (the first label in order wins a tie); without any labelled rows all are ``und``, and
``filter_documents`` keeps every text with a letter, since nothing can be told; of more than
``max_labels`` labels those of most rows are learned; a label has its sample however often ids or
texts repeat; an empty table gives an empty result; columns of the input other than id and text never reach the model's
predictions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionflow.llm.common import materialise, tidy

MAX_N = 3
BITS = 13
BUCKETS = 1 << BITS
STRETCH = 1 << 17
_GAP = re.compile(r"[\W\d_]+")
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Boolean (texts, MAX_N * BUCKETS), and whether each text has a letter."""
    flags = np.zeros(len(texts) * MAX_N * BUCKETS, bool)
    any_letter = np.zeros(len(texts), bool)
    pieces, rows = [], []
    size = 0

    def settle() -> None:
        nonlocal size
        if not pieces:
            return
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "replace"), np.uint32)
        lengths = [len(p) for p in pieces]
        row, piece = np.repeat(np.array(rows, np.int64), lengths), np.repeat(np.arange(len(pieces)), lengths)
        h = np.zeros(len(codes), np.uint32)
        for n in range(MAX_N):
            end = len(codes) - n
            if end <= 0:
                break
            h = h[:end] + codes[n:] * _MULTIPLY[n] if n else codes * _MULTIPLY[0]
            spread = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)
            inside = piece[:end] == piece[n:]
            at = row[:end] * (MAX_N * BUCKETS) + n * BUCKETS + spread
            flags[at if n == 0 else at[inside]] = True
        pieces.clear()
        rows.clear()
        size = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        letters = _GAP.sub(" ", text).lower().strip()
        if not any(map(str.isalpha, letters)):
            continue
        any_letter[i] = True
        letters = f" {letters} "
        for start in range(0, len(letters), STRETCH):
            pieces.append(letters[max(0, start - MAX_N + 1) : start + STRETCH])
            rows.append(i)
            size += len(pieces[-1])
            if size > STRETCH:
                settle()
    settle()
    return flags.reshape(len(texts), MAX_N * BUCKETS), any_letter


def _norms(flags: np.ndarray) -> np.ndarray:
    """1 / sqrt(number of n-grams) per text and length."""
    return 1 / np.sqrt(np.maximum(flags.reshape(len(flags), MAX_N, BUCKETS).sum(axis=2), 1))


class Model:
    """Landmarks and weights; ``predict`` gives (label numbers, scores) of presence vectors."""

    def __init__(self, labels: list[str], packed: np.ndarray, weights: np.ndarray):
        self.labels, self.packed, self.weights = labels, packed, weights
        self.rows, self._ready = 0, None

    def _landmarks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length: the buckets that some landmark has, and the landmarks' scaled vectors there."""
        if self._ready is None:
            flags = np.unpackbits(self.packed, axis=1).astype(bool)
            norms, self._ready = _norms(flags), []
            for n in range(MAX_N):
                part = flags[:, n * BUCKETS : (n + 1) * BUCKETS]
                used = np.flatnonzero(part.any(axis=0))
                self._ready.append((used + n * BUCKETS, (part[:, used].T * norms[:, n]).astype(np.float32)))
        return self._ready

    def kernel(self, flags: np.ndarray) -> np.ndarray:
        """K(texts, landmarks)."""
        norms = _norms(flags).astype(np.float32)
        k = np.zeros((len(flags), len(self.packed)), np.float32)
        for n, (used, matrix) in enumerate(self._landmarks()):
            k += flags[:, used].astype(np.float32) @ matrix * norms[:, n : n + 1]
        return k / MAX_N

    def predict(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.clip((self.kernel(flags) @ self.weights.astype(np.float32)).astype(np.float64) + 1, 0, 2) ** 2
        best = out.argmax(axis=1)
        return best, out[np.arange(len(out)), best] / np.maximum(out.sum(axis=1), 1e-12)

    def __getstate__(self):
        return self.labels, self.packed, self.weights

    def __setstate__(self, state):
        self.__init__(*state)


def _rows(batches: Iterator[pa.RecordBatch], column: int, step: int = 64) -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part, part.column(column).to_pylist()


def in_fold(id_col: str, folds: int = 5) -> Column:
    """Whether a document is held out: crc32 of its id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % folds == 0


def ridge_weights(k: np.ndarray, landmarks: np.ndarray, y: np.ndarray, labels: int, ridge: float) -> np.ndarray:
    """Weights (landmark, label) of one-versus-rest ridge regressions in the Nyström space of the landmarks.

    ``k`` is the kernel of all rows with the landmarks, which are rows too; every label weighs the same.
    """
    values, vectors = np.linalg.eigh(k[landmarks] / 2 + k[landmarks].T / 2)
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström map
    phi = k @ root
    weight = 1 / np.bincount(y, minlength=labels)[y]
    targets = np.where(y[:, None] == np.arange(labels), 1.0, -1.0)
    left = phi.T @ (phi * weight[:, None]) + ridge * labels / len(y) * np.eye(phi.shape[1])
    return root @ np.linalg.solve(left, phi.T @ (targets * weight[:, None]))


def fit(docs: DataFrame, per_class: int = 400, landmarks: int = 32, ridge: float = 1e-2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_labels: int = 1000) -> Model | None:
    """Fit on labelled rows that are not held out. At most ``per_class`` documents of each of ``max_labels`` labels reach the driver, as bit vectors."""
    text = F.col(text_col).cast("string")
    # Of a pair of id and text that repeats, all rows share one order and count once.
    order = F.shiftrightunsigned(F.xxhash64(F.col(id_col), text), 1)
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~in_fold(id_col))
    known = known.select(F.col(label_col).cast("string").alias("label"), order.alias("order"), text.alias("text"))
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("order", 0.02).alias("n")).orderBy(F.col("rows").desc(), "label").limit(max_labels).collect()
    if not counts:
        return None
    # Orders are spread evenly, so about twice as many pairs as wanted lie under this bound, however many there are.
    bound = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min((1 << 63) - 1, (2 * per_class << 63) // max(1, r["n"])))])
    near = known.where(F.col("order") <= F.element_at(bound, F.col("label")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("order"))
    chosen = materialise(near.select("label", "order").distinct().withColumn("rank", rank).where(F.col("rank") <= per_class).select("label", "order"), "sample")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _rows(batches, 2):
            flags, letters = presence(texts)
            bits = np.packbits(flags, axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(letters)], ["label", "order", "bits", "letters"])

    # The sample's size is bounded by per_class and max_labels, so its keys may be broadcast; rows of one pair are equal, and one of them stays.
    picked = near.join(F.broadcast(chosen), ["label", "order"]).groupBy("label", "order").agg(F.first("text").alias("text"))
    rows = sorted(picked.mapInArrow(tidy(vectors), "label string, order long, bits binary, letters boolean").where("letters").collect(), key=lambda r: (r["label"], r["order"]))
    if not rows:
        return None
    labels = sorted({r["label"] for r in rows})
    packed = np.array([np.frombuffer(r["bits"], np.uint8) for r in rows])
    y = np.array([labels.index(r["label"]) for r in rows])
    chosen_rows = np.concatenate([np.flatnonzero(y == i)[:landmarks] for i in range(len(labels))])
    model = Model(labels, packed[chosen_rows], np.zeros((len(chosen_rows), len(labels))))
    k = np.concatenate([model.kernel(np.unpackbits(packed[i : i + 256], axis=1).astype(bool)) for i in range(0, len(packed), 256)]).astype(np.float64)
    model.weights, model.rows = ridge_weights(k, chosen_rows, y, len(labels), ridge), len(rows)
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _rows(batches, 1):
            names, scores = label(model, texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def label(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    if model is None:
        return ["und"] * len(texts), [0.0] * len(texts)
    flags, letters = presence(texts)
    best, score = model.predict(flags)
    return [model.labels[b] if x else "und" for b, x in zip(best, letters, strict=True)], [float(s) if x else 0.0 for s, x in zip(score, letters, strict=True)]


def filter_documents(docs: DataFrame, model: Model | None, min_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose language is told with at least ``min_score``, with exactly their own columns; without a model, those with a letter."""
    if model is None:
        return docs.where(F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _rows(batches, at):
            names, scores = label(model, texts)
            keep = pa.array([n != "und" and s >= min_score for n, s in zip(names, scores, strict=True)])
            yield part.filter(keep)

    return docs.mapInArrow(tidy(run), docs.schema)
