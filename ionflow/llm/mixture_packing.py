"""Mixture-controlled packing: deficit round-robin over source queues, one window for each sequence.

Every source is a queue of tokens. In each window, which is one sequence, queue k earns the quantum
``seq_len`` * weight_k / sum of weights on top of the deficit it carries, and gives a token whenever
the deficit has grown to half of one. So token y of the queue is due (2y + 1) / (2 weight_k) after
the start, and the queues' tokens by due time (ties by queue), cut every ``seq_len`` tokens, are the
sequences: each is full, each queue's deficit lies within half a token when a sequence ends, and
what it owes or has given too much goes on into the next. The number of tokens that a queue has
given by any position is a closed form, so any task takes up the round at any window, and deficits
cross windows and partitions without a pass over all windows. When a queue runs dry a phase ends;
the others share its part from there on.

The weights are the ``targets`` where given (the sources that are not named share the rest as they
are); else the queues' token counts to the ``power``: 1 keeps the corpus's own mixture in every
sequence, 0 gives all sources equal shares until they run dry.

Within a sequence a queue's tokens lie together. The last, partly filled sequence is laid out as
sequences of powers of two, so nothing is padded.

Queues of their own have the sources in the targets, null sources, and every source with at least
one in ``queues`` of all tokens, of which there are no more than ``queues``. The many sources below
that, with less than ``seq_len`` / ``queues`` tokens a sequence each, form one further queue, in the
order of the table's parts; so the plan has at most ``queues`` + targets + 2 of them.

Two passes over the tokens: the first writes them with their place in the task's part of their
source; sums per source and part give each part its start.

Defined results: null and empty texts have the end id alone; repeated rows are packed each; an
empty table gives no pieces; clashing columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionflow.llm import tree_bpe
from ionflow.llm.common import SLICE_BYTES, materialise, slices, tidy

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, queue int, ids binary"
_UNITS = 1 << 30  # weights are whole numbers that add up to about this
_TICK = 31  # due times are counted in 2^-31 of the time in which all weights are given once


class MixturePlan:
    """Where each queue's tokens go; ``totals`` tokens per queue, drawn by ``weights``."""

    def __init__(self, totals: dict[int, int], weights: dict[int, float], seq_len: int):
        self.seq_len = seq_len
        self.queues = np.array(sorted(k for k, n in totals.items() if n > 0), np.int64)
        self.totals = np.array([totals[k] for k in self.queues.tolist()], np.int64)
        share = np.array([max(float(weights[k]), 0.0) for k in self.queues.tolist()])
        self.units = np.maximum(1, share / max(share.sum(), 1e-300) * (_UNITS - len(share))).astype(np.int64)
        self.total = int(self.totals.sum())
        starts, bases, rates = [], [], []
        at, given = 0, np.zeros_like(self.totals)
        while at < self.total:
            rate = np.where(given < self.totals, self.units, 0)
            starts, bases, rates = [*starts, at], [*bases, given], [*rates, rate]
            at += self._until_dry(rate, self.totals - given)
            given = given + self._dealt(rate, np.array([at - starts[-1]]))[0]
        self.starts, self.bases, self.rates = np.array(starts, np.int64), np.array(bases, np.int64).reshape(len(starts), len(share)), np.array(rates, np.int64).reshape(len(starts), len(share))
        whole = self.total // seq_len
        tail = [whole * seq_len]
        tail += [tail[0] + (self.total % seq_len >> bit << bit) for bit in reversed(range(seq_len.bit_length())) if self.total % seq_len >> bit & 1]
        self.tail = np.array(tail, np.int64)  # where the sequences of powers of two begin, and the end

    @staticmethod
    def _due(rate: np.ndarray, time: np.ndarray) -> np.ndarray:
        """Tokens of each queue that are due by each time; one queue's token y is due at floor((2y + 1) * 2^31 / 2 rate)."""
        return (2 * rate * (time[:, None] + 1) + (1 << _TICK) - 1) >> (_TICK + 1)

    def _until_dry(self, rate: np.ndarray, left: np.ndarray) -> int:
        """Tokens dealt in all when the first queue has given its last."""
        live = np.flatnonzero(rate)
        turns, y = (left[live] - 1) // rate[live], (left[live] - 1) % rate[live]
        time = ((2 * y + 1) << _TICK) // (2 * rate[live])
        i = np.lexsort((live, time, turns))[0]
        before, by = self._due(rate, np.array([time[i] - 1, time[i]]))
        return int(turns[i] * rate.sum() + before.sum() + (by - before)[: live[i] + 1].sum())

    def _dealt(self, rate: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Tokens of each queue among the first ``n`` of a phase; after every sum of the rates the order begins anew."""
        total, k = int(rate.sum()), len(rate)
        turns, rest = n // total, n % total
        lo = np.maximum(-1, ((np.maximum(rest - k, 0) << _TICK) // total) - 2)  # fewer than ``rest`` are due, or none
        hi = np.minimum((1 << _TICK) - 1, (((rest + k) << _TICK) // total) + 2)  # at least ``rest`` are due
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            enough = self._due(rate, mid).sum(axis=1) >= rest
            hi, lo = np.where(enough, mid, hi), np.where(enough, lo, mid)
        before = self._due(rate, hi - 1)
        more = self._due(rate, hi) - before
        more[np.cumsum(more, axis=1) > (rest - before.sum(axis=1))[:, None]] = 0
        return np.where((rest > 0)[:, None], before + more, 0) + turns[:, None] * rate

    def given(self, position: np.ndarray) -> np.ndarray:
        """Tokens of each queue before each of some ascending positions."""
        out = np.empty((len(position), len(self.queues)), np.int64)
        phase = np.searchsorted(self.starts, position, "right") - 1
        for p in np.unique(phase):
            some = np.flatnonzero(phase == p)
            for at in range(0, len(some), 4096):
                i = some[at : at + 4096]
                out[i] = self.bases[p] + self._dealt(self.rates[p], position[i] - self.starts[p])
        return out

    def _near(self, k: int, token: np.ndarray) -> np.ndarray:
        """About where a queue's tokens lie: within as many positions as there are queues."""
        p = np.searchsorted(self.bases[:, k], token, "right") - 1
        return self.starts[p] + ((token - self.bases[p, k] + 0.5) * (self.rates[p].sum(axis=1) / self.rates[p, k])).astype(np.int64)

    def cut(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first token in the queue, length, sequence, offset) of the pieces of stretches of queues, by row and token."""
        out, room = [], len(self.queues) + 2
        for q in np.unique(queue):
            k, rows = int(np.searchsorted(self.queues, q)), np.flatnonzero(queue == q)
            a, e = first[rows], first[rows] + n[rows]
            lo = np.maximum(0, self._near(k, a) - room) // self.seq_len
            size = np.minimum(self.total - 1, self._near(k, e - 1) + room) // self.seq_len + 2 - lo
            windows = np.unique(np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum()))
            given = self.given(np.minimum(windows * self.seq_len, self.total))
            own, before = given[:, k], np.append((given[1:, :k] - given[:-1, :k]).sum(axis=1), 0)
            f, last = np.searchsorted(own, a, "right") - 1, np.searchsorted(own, e - 1, "right") - 1
            count = last - f + 1
            row = np.repeat(np.arange(len(rows)), count)
            j = np.repeat(f - np.cumsum(count) + count, count) + np.arange(count.sum())
            s, t = np.maximum(a[row], own[j]), np.minimum(e[row], own[np.minimum(j + 1, len(own) - 1)])
            some = t > s
            out.append(np.stack([rows[row], s, t - s, windows[j] * self.seq_len + before[j] + s - own[j]])[:, some])
        row, start, length, at = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        row, start, length, at = self._cut_tail(row, start, length, at)
        order = np.lexsort((start, row))
        sequence, offset = at // self.seq_len, at % self.seq_len
        late = at >= self.tail[0]
        i = np.searchsorted(self.tail, at[late], "right") - 1
        sequence[late], offset[late] = self.tail[0] // self.seq_len + i, at[late] - self.tail[i]
        return row[order], start[order], length[order], sequence[order], offset[order]

    def _cut_tail(self, row: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut the pieces of the last, partly filled window where its smaller sequences begin."""
        late = np.flatnonzero(at >= self.tail[0])
        parts = []
        for r, s, n, x in zip(row[late], start[late], length[late], at[late], strict=True):
            bounds = [x, *self.tail[(self.tail > x) & (self.tail < x + n)].tolist(), x + n]
            parts += [(r, s + u - x, v - u, u) for u, v in zip(bounds, bounds[1:], strict=False)]
        new = np.array(parts, np.int64).reshape(-1, 4).T
        early = at < self.tail[0]
        return tuple(np.concatenate([old[early], fresh]) for old, fresh in zip((row, start, length, at), new, strict=True))


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str, rest: bool = False) -> DataFrame:
    """Token table: source, part, the document's first token in its part of the source, ids as little-endian 16 or 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = tree_bpe.load(tokenizer), TaskContext.get().partitionId()
        kind, seen = np.dtype("<u2" if len(bpe.ends) <= 1 << 16 else "<u4"), {}
        for b in batches:
            for at, to in slices(b.column(2), SLICE_BYTES // 2):
                part_rows = b.slice(at, to - at)
                ids, bounds, *_ = bpe.encode_all(part_rows.column(2), False)
                n = np.diff(bounds)
                flat = np.full(len(ids) + len(n), end_id, kind)  # the end id follows each document
                ends = bounds + np.arange(len(bounds))
                inside = np.ones(len(flat), bool)
                inside[ends[1:] - 1] = False
                flat[inside] = ids
                ends *= kind.itemsize
                tokens = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
                starts = []
                for s, size in zip(part_rows.column(1).to_pylist(), (n + 1).tolist(), strict=True):
                    starts.append(seen.get(s, 0))
                    seen[s] = starts[-1] + size
                yield pa.RecordBatch.from_arrays(
                    [part_rows.column(0), part_rows.column(1), pa.array(np.full(len(n), part, np.int32)), pa.array(starts, pa.int64()), pa.array(n + 1, pa.int64()), tokens],
                    ["doc_id", "source", "part", "local", "n", "tokens"],
                )
        if rest:
            bpe.rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.mapInArrow(tidy(run), "doc_id long, source string, part int, local long, n long, tokens binary"), "tokens")


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 1, targets: dict[str, float] | None = None, power: float = 0.5, queues: int = 128, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rest: bool = False) -> DataFrame:
    """Pieces of documents: which tokens of which document lie where; ``ids`` are little-endian 32-bit.

    ``rest``: tasks leave small caches behind in their workers, for sessions whose next stages need the memory; words are then encoded more often.
    """
    tokens = tokenised(docs, tokenizer, end_id, id_col, text_col, source_col, rest)
    sums = materialise(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    large = sums.where("source IS NOT NULL").groupBy("source").agg(F.sum("n").alias("n")).where(F.col("n") * queues >= total)
    named = sorted({*(targets or {}), *(r["source"] for r in large.collect())})  # at most ``queues`` rows

    # Queues: the named ones, then null sources, then all others.
    numbers = F.create_map(*[F.lit(x) for i, s in enumerate(named) for x in (s, i)]) if named else F.create_map().cast("map<string,int>")
    queue = F.when(F.col("source").isNull(), len(named)).otherwise(F.coalesce(F.element_at(numbers, F.col("source")), F.lit(len(named) + 1)))
    per_source = sums.withColumn("queue", queue)
    parts = per_source.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # one row per queue
    if targets:
        rest = {k: n for k, n in totals.items() if k >= len(named) or named[k] not in targets}
        left = max(0.0, 1.0 - sum(targets.values())) if sum(targets.values()) < 1 else 0.0
        weights = {k: targets[named[k]] if k not in rest else max(left, 1e-6) * n / max(1, sum(rest.values())) for k, n in totals.items()}
    else:
        weights = {k: n**power for k, n in totals.items()}
    plan = MixturePlan(totals, weights, seq_len)

    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("queue", "part", F.coalesce(F.sum("n").over(earlier("queue").orderBy("part")), F.lit(0)).alias("base"))
    inside = per_source.withColumn("inside", F.coalesce(F.sum("n").over(earlier("queue", "part").orderBy("source")), F.lit(0)))
    # A row per source and part; written, so that its size is known before the tokens would be dealt out to meet it.
    starts = materialise(inside.join(base, ["queue", "part"]).select("source", F.col("part").alias("at_part"), "queue", (F.col("base") + F.col("inside")).alias("base")), "starts")
    met = tokens.alias("t").join(starts.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")) & (F.col("t.part") == F.col("s.at_part")))
    placed = met.select("t.doc_id", "s.queue", (F.col("s.base") + F.col("t.local")).alias("at"), "t.n", "t.tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in slices(b.column(4)):
                part = b.slice(at, to - at)
                queue, first, n = (part.column(i).to_numpy() for i in (1, 2, 3))
                held = part.column(4)
                bounds = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
                raw = held.buffers()[2][int(bounds[0]) : int(bounds[-1])]
                ids = np.frombuffer(raw, f"<u{len(raw) // int(n.sum())}").astype("<u4")
                row, start, length, sequence, offset = plan.cut(queue.astype(np.int64), first, n)
                # By row and token the pieces follow one another as the ids do.
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                pieces = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                columns = [part.column(0).take(pa.array(row)), start - first[row], length, n[row], sequence, offset, queue[row].astype(np.int32), pieces]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

    return placed.mapInArrow(tidy(run), PIECES)
