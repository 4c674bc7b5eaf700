"""The proximity graph of a protein's fragments: which other fragments lie so near in m/z that they can be mistaken.

A fragment of a protein is linked with the later fragments of the same protein within ``reach``
(ends included), and with fragments of peptides of other proteins nearer than ``reach`` (ends left
out) whose precursor lies in the isolation window of its own precursor. ``graph`` lists the links
of one protein; ``link_counts`` counts those of all proteins without ever forming a pair, so
crowded stretches of m/z cost no more than others. It moves each fragment twice, to its protein and
to its stretch of m/z, and writes the peptides once; a fragment without a finite m/z has no links.

``peptides``: peptide_ref, proteins array<string>, mz, rt, fragments array<struct<cut_info, mz,
intensity, ...>>, in the order of peptide_ref; ``windows``: window_id, mz_start, mz_end, both ends
included. Of windows that overlap, a peptide's own one is that with the largest window_id; as a
neighbour it is in all of them. Peptides without proteins have no part in the graph, those without
a window have links within their protein only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionflow.operators import ordered, ranges
from ionflow.operators.settle import settle, written

#: Fragments that a task takes at once, and targets of one stretch and window.
TOGETHER, SHARE = 1 << 16, 1 << 18
#: Bits of a key for the parts of a window and stretch.
SUB = 16


def fragments_of(peptides: DataFrame) -> DataFrame:
    """peptide_ref, proteins, precursor, rt, at (place among the peptide's fragments), cut_info, mz, intensity."""
    rows = peptides.where(F.size("proteins") > 0).select("peptide_ref", F.array_distinct("proteins").alias("proteins"), F.col("mz").alias("precursor"), "rt", F.posexplode("fragments").alias("at", "f"))
    return rows.select("peptide_ref", "proteins", "precursor", "rt", "at", F.col("f.cut_info").alias("cut_info"), F.col("f.mz").cast("double").alias("mz"), F.col("f.intensity").cast("double").alias("intensity"))


def _in_windows(rows: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    return ranges.interval_join(rows, windows.select("window_id", "mz_start", "mz_end"), "precursor", "mz_start", "mz_end", width, closed="both").drop("mz_start", "mz_end")


def _with_windows(peptides: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """peptide_ref, proteins, windows (ids of those that hold the precursor), cut_info, mz: one row a peptide, its fragments as arrays."""
    one = F.struct("window_id", "mz_start", "mz_end")
    bins = F.explode(F.sequence(ranges._bin(F.col("mz_start"), width), ranges._bin(F.col("mz_end"), width)))
    by_bin = windows.where("mz_start <= mz_end AND window_id IS NOT NULL").withColumn("_bin", bins).groupBy("_bin").agg(F.collect_list(one).alias("_windows"))
    near = F.filter("_windows", lambda w: (w["mz_start"] <= F.col("mz")) & (F.col("mz") <= w["mz_end"]))
    rows = peptides.where((F.size("proteins") > 0) & (F.size("fragments") > 0)).withColumn("_bin", ranges._bin(F.col("mz"), width)).join(by_bin, "_bin", "left")
    ids = F.coalesce(F.transform(near, lambda w: w["window_id"].cast("long")), F.array().cast("array<long>"))
    field = lambda name, kind: F.transform("fragments", lambda f: f[name].cast(kind)).alias(name)
    return rows.select("peptide_ref", F.array_distinct("proteins").alias("proteins"), ids.alias("windows"), field("cut_info", "string"), field("mz", "double"))


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    """Lengths of a column's lists and what they hold, end to end."""
    lists = table[column].combine_chunks()
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _pairs(lengths: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists side by side each element of the first with each one of the second, as places in the two end to end."""
    times = np.repeat(other, lengths)
    first = np.repeat(np.arange(lengths.sum()), times)
    return first, np.repeat(np.repeat(np.cumsum(other) - other, lengths), times) + np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)


def _first(values: np.ndarray, start: np.ndarray, end: np.ndarray, bound: np.ndarray, past_equal: bool) -> np.ndarray:
    """First place from start to end (ordered there) whose value is at least ``bound``, or more than it."""
    low, high = start.copy(), end.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        at = values[np.minimum(mid, len(values) - 1)]
        below = open_ & (at <= bound if past_equal else at < bound)
        low, high = np.where(below, mid + 1, low), np.where(open_ & ~below, mid, high)
    return low


def _larger(values: np.ndarray, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
    """How many of ``values[low:high]`` are larger than ``than``: bit by bit from the highest, values of either bit side by side."""
    out = np.zeros(len(low), np.int64)
    for bit in reversed(range(max(1, int(len(values)).bit_length()))):
        ones = (values >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        low0, high0, one = zeros[low], zeros[high], (than >> bit) & 1 == 1
        out += np.where(one, 0, (high - low) - (high0 - low0))
        low, high = np.where(one, zeros[-1] + low - low0, low0), np.where(one, zeros[-1] + high - high0, high0)
        values = np.concatenate([values[~ones], values[ones]])
    return out


class _Stretches:
    """Stretches of m/z between ``edges``: every quantile, and what lies ``reach`` to either side of one.

    A fragment is near the targets from ``mz - reach`` on (left out) to ``mz + reach`` (left out), so
    it begins in one stretch and ends in another or in the same; no stretch has more of either than a
    quantile holds. ``table`` sets what begins and ends before each stretch of a window.
    """

    def __init__(self, cuts: list[float], reach: float):
        cuts = np.array(cuts, np.float64)
        self.reach, self.edges = reach, np.unique(np.concatenate([cuts - reach, cuts, cuts + reach]))
        self.count = len(self.edges) + 1

    def of(self, mz: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, mz, "right")

    def table(self, totals: list) -> None:
        """``totals``: window, stretch, begun, ended, targets; a window and stretch of many targets is dealt to several tasks."""
        self.windows = np.array(sorted({t["window"] for t in totals}), np.int64)
        change, targets = np.zeros((len(self.windows), self.count), np.int64), np.zeros((len(self.windows), self.count), np.int64)
        for t in totals:
            at = np.searchsorted(self.windows, t["window"]), t["stretch"]
            change[at], targets[at] = t["begun"] - t["ended"], t["targets"]
        self.before = (np.cumsum(change, 1) - change).ravel()
        self.parts = np.clip(-(-targets // SHARE), 1, (1 << SUB) - 1).ravel()

    def place(self, window: np.ndarray, mz: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.windows, window) * self.count + self.of(mz)


def _home(sizes: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Each peptide's own window, the largest of its list; the least number without one."""
    home = np.full(len(sizes), np.iinfo(np.int64).min)
    np.maximum.at(home, np.repeat(np.arange(len(sizes)), sizes), window)
    return home


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, m/z, targets) of each fragment in each of its peptide's windows; targets: proteins for which it looks there for neighbours."""
    lengths, mz = _lists(table, "mz")
    sizes, window = _lists(table, "windows")
    window, mz = _numbers(window), _numbers(mz)
    fragment, at = _pairs(lengths, sizes)
    proteins = _numbers(table["n_proteins"].combine_chunks())
    targets = np.where(window == np.repeat(_home(sizes, window), sizes), np.repeat(proteins, sizes), 0)
    known = np.isfinite(mz[fragment])
    return window[at][known], mz[fragment][known], targets[at][known]


def _totals(stretches: _Stretches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            window, mz, targets = _entries(pa.Table.from_batches([batch]))
            for kind, stretch, n in ((0, stretches.of(mz - stretches.reach), None), (1, stretches.of(mz + stretches.reach), None), (2, stretches.of(mz), targets)):
                ids, code = np.unique(window, return_inverse=True)
                keys, inverse = np.unique(code * stretches.count + stretch, return_inverse=True)
                for k, v in zip(keys.tolist(), np.bincount(inverse, n, len(keys)).astype(np.int64).tolist(), strict=True):
                    found.setdefault((int(ids[k // stretches.count]), k % stretches.count), np.zeros(3, np.int64))[kind] += v
        if found:
            columns = [*np.array(list(found), np.int64).T, *np.array(list(found.values())).T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["window", "stretch", "begun", "ended", "targets"])

    return run


def _sources(stretches: _Stretches):
    """(key, mz, n): fragments of equal window and m/z together, where they begin and where they end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, None):
            window, mz, _ = _entries(table)
            order = np.lexsort((mz, window))
            window, mz = window[order], mz[order]
            new = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]) | (mz[1:] != mz[:-1])])) if len(mz) else np.zeros(0, np.int64)
            window, mz, n = window[new], mz[new], np.diff(np.append(new, len(mz)))
            begin, end = stretches.place(window, mz - stretches.reach), stretches.place(window, mz + stretches.reach)
            more = np.flatnonzero(begin != end)
            place, row = np.concatenate([begin, end[more]]), np.concatenate([np.arange(len(mz)), more])
            parts = stretches.parts[place]
            key = np.repeat(place << SUB, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            row = np.repeat(row, parts)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(mz[row]), pa.array(n[row])], ["key", "mz", "n"])

    return run


def _together(batches: Iterator[pa.RecordBatch], whole: str | None) -> Iterator[pa.Table]:
    """Rows of some ``TOGETHER`` fragments at once; equal neighbours in column ``whole`` stay together."""
    held, size, wanted = [], 0, TOGETHER
    for batch in batches:
        held.append(batch)
        size += len(batch.column("mz").flatten())
        if size < wanted:
            continue
        table, held, size = pa.Table.from_batches(held), [], 0
        ready = pc.index(table[whole], table[whole][-1]).as_py() if whole else len(table)
        if ready:
            yield table.slice(0, ready)
        rest = table.slice(ready)
        if len(rest):
            held = rest.to_batches()
            size = sum(len(b.column("mz").flatten()) for b in held)
        wanted = max(TOGETHER, 2 * size)
    if held:
        yield pa.Table.from_batches(held)


def _own(stretches: _Stretches):
    """(key, protein, peptide_ref, cut_info, mz, own_links, mine) of whole proteins, in the order of peptide_ref; mine: what of the protein the window holds nearby."""
    reach = stretches.reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, "protein"):
            lengths, mz = _lists(table, "mz")
            sizes, window = _lists(table, "windows")
            mz, window = _numbers(mz), _numbers(window)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            protein = _numbers(table["protein"].combine_chunks().dictionary_encode().indices).astype(np.int64)
            known = np.flatnonzero(np.isfinite(mz))
            of, m = protein[owner[known]], mz[known]
            own, mine, key = np.zeros(len(mz), np.int64), np.zeros(len(mz), np.int64), -1 - np.arange(len(mz)) % stretches.count

            order = np.lexsort((m, of))
            by_protein, by_mz = of[order], m[order]
            start, end = np.searchsorted(by_protein, of, "left"), np.searchsorted(by_protein, of, "right")
            low, high = _first(by_mz, start, end, m - reach, False), _first(by_mz, start, end, m + reach, True)
            some = np.flatnonzero(high - low > 1)
            own[known[some]] = _larger(order, low[some], high[some], some)

            fragment, at = _pairs(lengths, sizes)
            held = np.isfinite(mz[fragment])
            fragment, at = fragment[held], at[held]
            ids = np.unique(window)
            group = protein[owner[fragment]] * len(ids) + np.searchsorted(ids, window[at])
            order = np.lexsort((mz[fragment], group))
            group, near = group[order], mz[fragment][order]
            home = _home(sizes, window)
            targets = known[sizes[owner[known]] > 0]
            wanted, m = protein[owner[targets]] * len(ids) + np.searchsorted(ids, home[owner[targets]]), mz[targets]
            start, end = np.searchsorted(group, wanted, "left"), np.searchsorted(group, wanted, "right")
            mine[targets] = _first(near - reach, start, end, m, False) - _first(near + reach, start, end, m, True)
            place = stretches.place(home[owner[targets]], m)
            key[targets] = (place << SUB) + np.arange(len(m)) % stretches.parts[place]

            rows = pa.array(owner)
            columns = [pa.array(key), table["protein"].combine_chunks().take(rows), table["peptide_ref"].combine_chunks().take(rows), _lists(table, "cut_info")[1], pa.array(mz), pa.array(own), pa.array(mine)]
            out = pa.RecordBatch.from_arrays(columns, ["key", "protein", "peptide_ref", "cut_info", "mz", "own_links", "mine"])
            yield from (out.slice(i, 1 << 14) for i in range(0, len(out), 1 << 14))

    return run


def _other(stretches: _Stretches):
    """Targets of a window and stretch with what has begun there and not ended, less what is their own."""

    def run(key, targets: pa.Table, sources: pa.Table) -> pa.Table:
        near = 0
        if (place := key[0].as_py() >> SUB) >= 0:
            t, mz, n = _numbers(targets["mz"].combine_chunks()), _numbers(sources["mz"].combine_chunks()), _numbers(sources["n"].combine_chunks())
            order = np.argsort(mz, kind="stable")
            mz, n, near = mz[order], n[order], stretches.before[place]
            for sign, at, side in ((1, mz - stretches.reach, "left"), (-1, mz + stretches.reach, "right")):
                here = stretches.of(at) == place % stretches.count
                near = near + sign * np.concatenate([[0], np.cumsum(n[here])])[np.searchsorted(at[here], t, side)]
        links = pa.array(near - _numbers(targets["mine"].combine_chunks()))
        return targets.select(["protein", "peptide_ref", "cut_info", "own_links"]).append_column("other_links", links)

    return run


def link_counts(peptides: DataFrame, windows: DataFrame, reach: float, width: float = 25.0) -> DataFrame:
    """(protein, peptide_ref, cut_info, own_links, other_links) of every fragment of every protein; of ``fragments`` cut_info and mz are read.

    Neighbours of other proteins are all that a window holds nearby, less those of the own protein.
    One task takes a protein: it has as many fragments as its length allows. Stretches of m/z are
    dealt by quantiles; what has begun and ended before each, a row a window and stretch, goes to the driver.
    """
    held = written(_with_windows(peptides, windows, width))
    parts = ordered.bucket_count(held)
    placed = held.where(F.size("windows") > 0).select("windows", "mz", F.size(F.array_compact("proteins")).cast("long").alias("n_proteins"))
    quantiles = F.percentile_approx("mz", F.lit([i / parts for i in range(1, parts)] or [0.5]), 10_000)
    cuts = placed.select(F.explode("mz").alias("mz")).where(F.abs("mz") < float("inf")).agg(quantiles.alias("c")).first()["c"]
    stretches = _Stretches(sorted(set(cuts or [])), reach)
    totals = placed.mapInArrow(_totals(stretches), "window long, stretch long, begun long, ended long, targets long")
    stretches.table(totals.groupBy("window", "stretch").agg(*[F.sum(c).alias(c) for c in ("begun", "ended", "targets")]).collect())
    own = held.select(F.explode("proteins").alias("protein"), "peptide_ref", "windows", "cut_info", "mz").where("protein IS NOT NULL")
    own = own.repartition("protein").sortWithinPartitions("protein", "peptide_ref", "mz", "cut_info", "windows")  # whole, so that a task done again deals out the same
    own = own.mapInArrow(_own(stretches), "key long, protein string, peptide_ref string, cut_info string, mz double, own_links long, mine long")
    sources = placed.mapInArrow(_sources(stretches), "key long, mz double, n long")
    return own.groupBy("key").cogroup(sources.groupBy("key")).applyInArrow(_other(stretches), "protein string, peptide_ref string, cut_info string, own_links long, other_links long")


def graph(peptides: DataFrame, windows: DataFrame, protein: str, reach: float, width: float = 25.0) -> DataFrame:
    """Links of one protein: source and target (peptide_ref and cut_info), kind (own, other), intensity (see below) and rt_gap.

    ``intensity``: of an own link the relative difference to the target, of another one the ratio to it.
    """
    frags = fragments_of(peptides)
    mine = settle(frags.where(F.array_contains("proteins", protein)))
    names = ["peptide_ref", "cut_info", "at", "mz", "intensity", "rt"]
    side = lambda df, mark, *more: df.select(*[F.col(c).alias(f"{mark}_{c}") for c in names], *more)
    bounds = [(F.col("mz") - reach).alias("low"), (F.col("mz") + reach).alias("high")]
    own = ranges.interval_join(side(mine, "s"), side(mine, "t", *bounds), "s_mz", "low", "high", max(reach, 1e-6), closed="both")
    own = own.where(F.struct("s_peptide_ref", "s_at") > F.struct("t_peptide_ref", "t_at"))
    home = _in_windows(mine, windows, width).groupBy("peptide_ref").agg(F.max("window_id").alias("window_id"))
    target = side(mine.join(home, "peptide_ref"), "t", "window_id", *bounds)
    rest = _in_windows(frags.where(~F.array_contains("proteins", protein)), windows, width)
    other = ranges.interval_join(side(rest, "s", "window_id"), target, "s_mz", "low", "high", max(reach, 1e-6), ["window_id"], closed="neither")
    link = lambda df, kind, value: df.select(*[F.col(f"{m}_{c}").alias(f"{n}_{c}") for m, n in (("s", "source"), ("t", "target")) for c in ("peptide_ref", "cut_info")], F.lit(kind).alias("kind"), value.alias("intensity"), F.abs(F.col("s_rt") - F.col("t_rt")).alias("rt_gap"))
    ratio = lambda x: F.when(F.col("t_intensity") != 0, x / F.col("t_intensity"))
    return link(own, "own", ratio(F.abs(F.col("t_intensity") - F.col("s_intensity")))).union(link(other, "other", ratio(F.col("s_intensity"))))
