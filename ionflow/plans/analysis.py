"""Analysis of a run: coordinates, chromatograms, peak groups, scores, weights, identification.

Spectra meet their peptides in tiles. A tile is a stretch of time of one isolation window of a run,
with a bounded number of coordinates whose middle lies in it; scans are copied to the tiles that
need them. One cogroup per tile does extraction, picking and scoring, all chromatograms of a tile
at once. MS1 scans go to each window as the slice of its m/z range.
"""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionflow.functions import kernels as K
from ionflow.operators import boosting, fdr, groups, learning, ranges, series
from ionflow.operators.settle import settle
from ionflow.plans import crossrun

SCORED = ["run_id", "window_id", "peptide_ref", "decoy", "idx", "apex_rt", "selected_rt", "left_rt", "right_rt", "intensity_sum", "fit_int_sum", "ms1_sum", "ions_low", "ions_high", "low_delta", "best_ion", *learning.SCORES]
SCORED_SCHEMA = "run_id string, window_id int, peptide_ref string, decoy boolean, idx int, apex_rt double, selected_rt double, left_rt double, right_rt double, intensity_sum double, fit_int_sum double, ms1_sum double, ions_low int, ions_high int, low_delta double, best_ion string, " + ", ".join(f"{s} double" for s in learning.SCORES)


def coordinates(peptides: DataFrame, windows: DataFrame, runs: DataFrame, rt_window: float = 300.0, fragments: int = 6, unique: bool = False) -> DataFrame:
    """Peptides of each run and isolation window with rt bounds; library time is slope * real time + intercept, -1 searches the whole run.

    ``runs``: run_id, irt_slope, irt_intercept; ``windows``: run_id, window_id, mz_start, mz_end.
    """
    p = peptides.where("NOT disable" + (" AND is_unique" if unique else "")).withColumn("fragments", F.slice("fragments", 1, fragments))
    hit = ranges.interval_join(p, windows, "mz", "mz_start", "mz_end", 25.0).join(runs.select("run_id", "irt_slope", "irt_intercept"), "run_id")
    real = F.when(F.col("irt_slope") == 0, F.col("rt")).otherwise((F.col("rt") - F.col("irt_intercept")) / F.col("irt_slope"))
    whole = F.lit(rt_window == -1)
    return hit.withColumn("rt_start", F.when(whole, -1.0).otherwise(real - rt_window)).withColumn("rt_end", F.when(whole, 99999.0).otherwise(real + rt_window))


def with_decoys(coords: DataFrame) -> DataFrame:
    """Targets and decoys as rows; decoys are those peptides that have decoy fragments."""
    target = coords.withColumn("decoy", F.lit(False))
    if "decoy_fragments" not in coords.columns:
        return target
    decoy = coords.where(F.size("decoy_fragments") > 0).withColumn("fragments", F.slice("decoy_fragments", 1, 6)).withColumn("sequence", F.coalesce("decoy_sequence", "sequence")).withColumn("decoy", F.lit(True))
    if "decoy_unimod_map" in coords.columns:
        decoy = decoy.withColumn("unimod_map", F.coalesce("decoy_unimod_map", "unimod_map"))
    return target.unionByName(decoy)


def with_masses(coords: DataFrame, unimod: DataFrame, most: int = 10_000) -> DataFrame:
    """``coords`` with ``mods``: position -> mass of each modification in ``unimod_map``; ``unimod`` is a term list of at most ``most`` rows (UniMod has some 1500)."""
    terms = unimod.select("id", "mono_mass").limit(most + 1).collect()
    if len(terms) > most:
        raise ValueError(f"more than {most} modifications")
    table = F.create_map(*[F.lit(x) for r in terms for x in (r["id"], r["mono_mass"])]) if terms else F.create_map().cast("map<string,double>")
    return coords.withColumn("mods", F.transform_values("unimod_map", lambda _, i: F.coalesce(F.element_at(table, i), F.lit(0.0))))


def spectra_by_window(spectra: DataFrame, windows: DataFrame, margin: float = 1.0) -> DataFrame:
    """Scans keyed by (run, window): MS2 as they are, MS1 as slices of each window's m/z range."""
    two = spectra.where("level = 2").select("run_id", "window_id", "level", "rt", "mz", "intensity")
    peaks = F.filter(F.arrays_zip("mz", "intensity"), lambda p: p["mz"].between(F.col("mz_start") - margin, F.col("mz_end") + margin))
    one = spectra.where("level = 1").drop("window_id").join(windows, "run_id").select("run_id", windows["window_id"], "level", "rt", peaks.alias("p"))
    return two.unionByName(one.select("run_id", "window_id", "level", "rt", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity")))


def _aligned(y: np.ndarray, rt1: np.ndarray, rt: np.ndarray, how: str, start: float, end: float) -> np.ndarray:
    """MS1 intensities at MS2 times: of the nearest scan, or scan by scan within the range, with zeros added or the last ones dropped (order)."""
    if how == "order":
        own = y[(rt1 >= start) & (rt1 <= end)][: len(rt)]
        return np.concatenate([own, np.zeros(len(rt) - len(own), own.dtype)])
    if len(rt1) < 2:
        return y[np.zeros(len(rt), int)]  # of one scan, that one
    at = np.clip(np.searchsorted(rt1, rt), 1, len(rt1) - 1)
    return y[np.where(rt - rt1[at - 1] < rt1[at] - rt, at - 1, at)]


@dataclass
class Tile:
    """Scans of one tile, in order of time, and the chromatograms of all its coordinates: fragments and precursor in MS2, precursor in MS1."""

    rt2: np.ndarray
    two: list[K.Spectrum]
    rt1: np.ndarray
    one: list[K.Spectrum]
    coords: list[SimpleNamespace]
    ppm: float

    def __post_init__(self):
        masses = [[*(f["mz"] for f in {f["cut_info"]: f for f in c.fragments}.values()), c.mz] for c in self.coords]
        self.starts = np.concatenate([[0], np.cumsum([len(m) for m in masses])]).astype(int)
        every = np.array([m for own in masses for m in own], float)
        self.curves = K.chromatograms(self.two, every, self.ppm)
        self.precursors = K.chromatograms(self.one, np.array([c.mz for c in self.coords], float), self.ppm)

    def fragments(self, i: int, part: slice) -> np.ndarray:
        return self.curves[self.starts[i] : self.starts[i + 1] - 1, part]

    def own(self, i: int, part: slice) -> np.ndarray:
        return self.curves[self.starts[i + 1] - 1, part]


def analyse_peptide(tile: Tile, i: int, low: float = 50, high: float = 300, widen: float = 200.0, retry_high: float = 100.0, picker: str = "counts", align: str = "nearest") -> list[dict]:
    """Scored peak groups of coordinate ``i`` of a tile; one retry in a wider range, with a lower count threshold and always by ion counts."""
    c = tile.coords[i]
    frags = {f["cut_info"]: f for f in c.fragments}
    for extra, limit in ((0.0, high), (widen, retry_high)):
        part = slice(*np.searchsorted(tile.rt2, [c.rt_start - extra, np.nextafter(c.rt_end + extra, np.inf)]))
        scans, rt = tile.two[part], tile.rt2[part]
        if len(rt) < 5 or not frags:
            return []
        eics = {k: y for k, y in zip(frags, tile.fragments(i, part), strict=True) if y.any()}
        if len(eics) <= len(frags) // 2:
            return []
        own = tile.own(i, part)
        ms1 = None
        if len(tile.rt1):
            ms1 = _aligned(tile.precursors[i], tile.rt1, rt, align, c.rt_start - extra, c.rt_end + extra)
        mods = {int(k): float(x) for k, x in dict(c.mods or {}).items()}
        most = np.max(list(eics.values()), axis=0)
        n_low, n_high = K.ion_counts(scans, K.series_masses(c.sequence, mods, int(c.charge)), most, low, limit)
        library = {k: f["intensity"] for k, f in frags.items() if k in eics}
        if picker == "shape" and not extra:
            found = K.groups_at(rt, eics, K.groups_by_shape(rt, eics), n_high, n_low, ms1)
        else:
            found = K.groups_by_counts(rt, eics, list(frags), n_high, n_low, ms1, own)
        if found:
            best, best_low = int(n_high.max()), int(n_low.max())
            whole = sum(f["intensity"] for f in frags.values())
            charges, mzs = {k: int(f["charge"] or 1) for k, f in frags.items()}, {k: f["mz"] for k, f in frags.items()}
            low_delta = lambda g: (best_low - g["ions_low"]) / best_low if best_low else 1.0  # noqa: B023, E731
            return [g | {"low_delta": low_delta(g)} | K.score_group(g, library, mzs, charges, scans[g["scan"]], best, c.rt, c.irt_slope, c.irt_intercept, ms1, own, whole) for g in found]
    return []


TILE = ["run_id", "window_id", "tile", "part"]
WIDEN = 200.0


def dealt(coords: DataFrame, spectra: DataFrame, width: float | None = 600.0, block: int = 2500, widen: float = WIDEN) -> tuple[DataFrame, DataFrame]:
    """Coordinates and scans with the tile and part that they are worked on in.

    A coordinate belongs to the tile of ``width`` seconds that holds the middle of its range; tiles
    of more than ``block`` coordinates are cut into parts by hash. A part gets the scans from the
    first start to the last end of its coordinates, each widened for the retry. MS1 scans are looked
    up by the nearest time, so a part's MS1 range reaches one gap further, and the two first and last
    MS1 scans of a run are everywhere. Without a ``width`` a window is one tile and one part.
    """
    keys = TILE[:2]
    if width is None:
        return (df.withColumns({"tile": F.lit(0), "part": F.lit(0)}) for df in (coords, spectra.join(coords.select(*keys).distinct(), keys, "left_semi")))
    middle = F.floor((F.col("rt_start") + F.col("rt_end")) / 2 / width).cast("int")
    coords = coords.withColumn("tile", middle)
    sizes = coords.groupBy(*TILE[:3]).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    coords = coords.join(sizes, TILE[:3]).withColumn("part", F.pmod(F.xxhash64("peptide_ref", "decoy"), F.col("parts")).cast("int")).drop("parts")
    reach = coords.groupBy(*TILE).agg((F.min("rt_start") - widen).alias("from_rt"), (F.max("rt_end") + widen).alias("to_rt"))

    # Times of a run's MS1 scans are some thousand; their largest gap, and the outermost ones.
    times = spectra.where("level = 1").select("run_id", "rt").distinct()
    order = Window.partitionBy("run_id").orderBy("rt")
    gaps = times.withColumns({"gap": F.col("rt") - F.lag("rt").over(order), "first": F.row_number().over(order), "last": F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("rt").desc()))})
    largest = gaps.groupBy("run_id").agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"))
    outer = gaps.where("first <= 2 OR last <= 2").select("run_id", "rt")

    two = ranges.interval_join(spectra.where("level = 2"), reach, "rt", "from_rt", "to_rt", width, keys, closed="both")
    reach1 = reach.join(largest, "run_id").select(*TILE, (F.col("from_rt") - F.col("gap")).alias("from_rt"), (F.col("to_rt") + F.col("gap")).alias("to_rt"))
    far = reach1.join(outer, "run_id").where(~F.col("rt").between(F.col("from_rt"), F.col("to_rt"))).select(*TILE, F.col("rt").alias("from_rt"), F.col("rt").alias("to_rt"))
    one = ranges.interval_join(spectra.where("level = 1"), reach1.union(far), "rt", "from_rt", "to_rt", width, keys, closed="both")
    columns = [*spectra.columns, "tile", "part"]
    return coords, two.select(columns).unionByName(one.select(columns))


def _scans(table: pa.Table, level: int) -> tuple[np.ndarray, list[K.Spectrum]]:
    """Times and spectra of a level in order of time; peaks are views into the table's flat lists."""
    table = table.combine_chunks()
    rt, at = table["rt"].to_numpy().astype(float), np.flatnonzero(table["level"].to_numpy() == level)
    at = at[np.argsort(rt[at], kind="stable")]

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        chunk = table[name].chunk(0) if table.num_rows else pa.array([], pa.list_(pa.float32()))
        return chunk.offsets.to_numpy(), chunk.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)

    (mo, m), (yo, y) = lists("mz"), lists("intensity")
    return rt[at], [K.Spectrum(m[mo[i] : mo[i + 1]], y[yo[i] : yo[i + 1]]) for i in at.tolist()]


def peak_groups(coords: DataFrame, spectra: DataFrame, ppm: float = 15, picker: str = "counts", align: str = "nearest", width: float | None = 600.0, block: int = 2500) -> DataFrame:
    """Scored peak groups of all coordinates, one task per tile (see ``dealt``).

    ``picker``: at maxima of the ion counts, or where fragments peak together ("shape"); ``align``:
    MS1 scans go to the nearest MS2 scan, or to that of the same number ("order").
    """
    numbers = {"window_id": pa.int32(), "decoy": pa.bool_(), "idx": pa.int32(), "ions_low": pa.int32(), "ions_high": pa.int32()}
    schema = pa.schema([(c, pa.string() if c in ("run_id", "peptide_ref", "best_ion") else numbers.get(c, pa.float64())) for c in SCORED])

    def run(key, left, right):
        coords = [SimpleNamespace(**row) for row in left.to_pylist()]
        tile = Tile(*_scans(right, 2), *_scans(right, 1), coords, ppm)
        rows = []
        for i, c in enumerate(coords):
            for k, g in enumerate(analyse_peptide(tile, i, picker=picker, align=align, widen=WIDEN)):
                rows.append({"run_id": c.run_id, "window_id": c.window_id, "peptide_ref": c.peptide_ref, "decoy": bool(c.decoy), "idx": k} | {n: g[n] for n in SCORED[5:]})
        return pa.Table.from_pylist(rows, schema)

    keep = [*TILE, "peptide_ref", "decoy", "sequence", "charge", "mz", "rt", "rt_start", "rt_end", "irt_slope", "irt_intercept", "fragments", "mods"]
    if "mods" not in coords.columns:
        coords = coords.withColumn("mods", F.lit(None).cast("map<int,double>"))
    left, right = dealt(coords, spectra, width, block)
    # New names for the keys: they come from the coordinates, and Spark would not tell the two sides apart.
    scans = right.select(*[F.col(c).alias(c) for c in TILE], "level", F.col("rt").cast("double").alias("rt"), F.col("mz").cast("array<float>").alias("mz"), F.col("intensity").cast("array<float>").alias("intensity"))
    return left.select(*keep).groupBy(*TILE).cogroup(scans.groupBy(*TILE)).applyInArrow(run, SCORED_SCHEMA)


def calibrate_run(peptides: DataFrame, spectra: DataFrame, windows: DataFrame, ppm: float = 15) -> DataFrame:
    """run_id, slope, intercept from the best group of each standard peptide over the whole run."""
    runs = windows.select("run_id").distinct().select("run_id", F.lit(0.0).alias("irt_slope"), F.lit(0.0).alias("irt_intercept"))
    coords = coordinates(peptides, windows, runs, -1).withColumn("decoy", F.lit(False))
    found = peak_groups(coords, spectra_by_window(spectra, windows), ppm)
    scored = found.withColumn("irt", F.col("CorrShapeW") + F.col("Dotprod") + F.col("Pearson") - F.col("low_delta")).where("irt >= 1")
    best = groups.best(scored, ["run_id", "peptide_ref"], "irt", [F.col("idx")], ["apex_rt"])
    return learning.calibrate_groups(best.join(peptides.select("peptide_ref", F.col("rt").alias("lib_rt")), "peptide_ref"), ["run_id"], "lib_rt", "apex_rt")


def identify(scored: DataFrame, cut: float = 0.01, iterations: int = 20, peptides: DataFrame | None = None, scans: DataFrame | None = None, learner: str = "linear", trees: boosting.Settings = boosting.Settings()) -> DataFrame:  # noqa: B008
    """Scores, best group per peptide and rates of each run as if it were alone: run_id, peptide_ref, q_value, fdr, status and the selected group.

    ``learner``: weights of a linear discriminant (``iterations`` rounds), or boosted trees of the
    shape ``trees`` ("boosted"; two rounds of choosing rows are enough).

    With ``peptides`` (peptide_ref, sequence, fingerprints) a second round follows: of two selected
    peptides that look alike and lie next to each other in one window, the weaker one's group is
    taken from it, so its next best is ranked. ``scans`` (run_id, window_id, rt): see ``similar_peaks``.
    """
    if learner == "boosted":
        total = boosting.rank(scored, ["run_id"], "peptide_ref", list(learning.SCORES), "decoy", iterations=min(iterations, 2), settings=trees)
    elif learner == "linear":
        weights = learning.train(scored, ["run_id"], "peptide_ref", list(learning.SCORES), "decoy", iterations=iterations)
        total = learning.with_total(scored, ["run_id"], weights, list(learning.SCORES), "total_score")
    else:
        raise ValueError(learner)
    keep = ["apex_rt", "selected_rt", "intensity_sum", "fit_int_sum", "ms1_sum", "best_ion", "total_score", *(["window_id"] if "window_id" in scored.columns else [])]

    def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        top = groups.best(rows, ["run_id", "peptide_ref", "decoy"], "total_score", [F.col("idx")], keep)
        return top, fdr.pipeline_by(top, ["run_id"], ["peptide_ref"], "total_score", "decoy", cut)

    top, rates = ranked(total)
    if peptides is not None:
        chosen = rates.where(F.col("fdr") <= cut).select("run_id", "peptide_ref").join(top.where("NOT decoy"), ["run_id", "peptide_ref"])
        chosen = chosen.join(peptides.select("peptide_ref", "fingerprints", F.length("sequence").alias("length")), "peptide_ref")
        wrong = settle(similar_peaks(chosen, scans)).withColumn("decoy", F.lit(False))
        top, rates = ranked(total.join(wrong, ["run_id", "peptide_ref", "selected_rt", "decoy"], "left_anti"))
    return rates.select("run_id", "peptide_ref", "q_value", "fdr", "status").join(top.where("NOT decoy"), ["run_id", "peptide_ref"])


def similar_peaks(found: DataFrame, scans: DataFrame | None = None, ranks: int = 2, gap: float = 0.1) -> DataFrame:
    """(run_id, peptide_ref, selected_rt) of selected groups that belong to a stronger peptide of the same run and window.

    Two groups meet within ``ranks`` of the window's distinct times (those of ``scans`` and of the
    groups). They look alike if they share 5 fragment masses, 6 for sequences over 8 letters; the
    one whose score is lower by ``gap`` and more is not its own. ``found``: run_id, window_id,
    peptide_ref, apex_rt, selected_rt, total_score, fingerprints, length.
    """
    keys = ["run_id", "window_id"]
    times = found.select(*keys, F.col("apex_rt").alias("time"))
    if scans is not None:
        times = times.union(scans.select(*keys, F.col("rt").alias("time")))
    # One window of a run has some thousand scans.
    ranked = times.distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("time")).cast("double"))
    rows = found.withColumnRenamed("apex_rt", "time").join(ranked, [*keys, "time"]).select(*keys, "peptide_ref", "selected_rt", "rank", "total_score", "fingerprints", "length")
    pairs = ranges.band_pairs(rows, "rank", float(ranks), "peptide_ref", keys)
    shared = F.size(F.array_intersect("fingerprints", "fingerprints_b"))
    alike = shared >= F.when(F.least("length", "length_b") <= 8, 5).otherwise(6)
    hit = pairs.where(alike & (F.abs(F.col("total_score") - F.col("total_score_b")) >= gap))
    first = F.col("total_score") < F.col("total_score_b")
    weaker = lambda c: F.when(first, F.col(c)).otherwise(F.col(f"{c}_b")).alias(c)
    return hit.select("run_id", weaker("peptide_ref"), weaker("selected_rt")).distinct()


# One peptide at a time ----------------------------------------------------------------------------


def predict(peptides: DataFrame, peptide_ref: str, windows: DataFrame, runs: DataFrame, spectra: DataFrame, charge: int | None = None, rt_window: float = 300.0, ppm: float = 15) -> DataFrame:
    """Scored peak groups of one peptide in all runs, at another charge if one is given (then named after it)."""
    one = peptides.where(F.col("peptide_ref") == peptide_ref)
    if charge is not None:
        name = F.concat(F.substring_index("peptide_ref", "_", 1), F.lit(f"_{charge}"))
        one = one.withColumns({"peptide_ref": name, "mz": F.col("mz") * F.col("charge") / charge, "charge": F.lit(charge)})
    return peak_groups(with_decoys(coordinates(one, windows, runs, rt_window)).where("NOT decoy"), spectra, ppm)


def reselect(coords: DataFrame, spectra: DataFrame, weights: DataFrame | dict[tuple, dict[str, float]], ppm: float = 15) -> DataFrame:
    """The group of each coordinate that most of its variants without one fragment agree on, from the variant that scores it highest.

    ``weights`` are those of ``learning.train`` by run. Of times chosen equally often the earliest counts.
    """
    mark = "\x1f"
    variants = crossrun.leave_one_out(coords).withColumn("peptide_ref", F.concat("peptide_ref", F.lit(mark), "without"))
    total = learning.with_total(peak_groups(variants, spectra, ppm), ["run_id"], weights, list(learning.SCORES), "total_score")
    keep = [c for c in SCORED if c not in ("run_id", "peptide_ref", "decoy")]
    best = settle(groups.best(total, ["run_id", "peptide_ref", "decoy"], "total_score", [F.col("idx")], [*keep, "total_score"]))
    parts = F.split("peptide_ref", mark)
    best = best.withColumns({"without": parts[1], "peptide_ref": parts[0]})
    keys = ["run_id", "peptide_ref", "decoy"]
    hits = best.groupBy(*keys, "selected_rt").agg(F.count(F.lit(1)).alias("hits"))
    chosen = hits.groupBy(*keys).agg(F.min(F.struct((-F.col("hits")).alias("o"), "selected_rt")).alias("m")).select(*keys, F.col("m.selected_rt").alias("selected_rt"), (-F.col("m.o")).alias("hits"))
    rows = best.join(chosen, [*keys, "selected_rt"])
    return groups.best(rows, keys, "total_score", [F.col("without")], [*keep, "total_score", "without", "hits"])


def looks_good() -> Column:
    """Whether the sub-scores of a peak group are those of a clear peak."""
    shape = (F.col("CorrShape") + F.col("CorrShapeW")) / 2
    return (shape > 0.85) & (F.col("Dotprod") > 0.9) & (F.col("IonsDelta") < 0.2) & (F.col("IsoCorr") > 0.8) & (F.col("IsoOverlap") < 0.05)


def chromatogram_view(coords: DataFrame, spectra: DataFrame, ppm: float = 15, smooth: bool = False, denoise: bool = False) -> DataFrame:
    """Curves of coordinates: run_id, peptide_ref, decoy, ion, rt, intensity, smoothed or weighed by signal to noise on demand.

    Ions are the fragments and, as ``MS1`` and ``SELF``, the precursor in MS1 and MS2 scans.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c in left.itertuples():
            for level in (1, 2):
                part = right[(right.level == level) & right.rt.between(c.rt_start, c.rt_end)].sort_values("rt")
                rt, scans = part.rt.to_numpy(float), [K.Spectrum(np.asarray(m, np.float32), np.asarray(y, np.float32)) for m, y in zip(part.mz, part.intensity, strict=True)]
                ions = {"MS1": c.mz} if level == 1 else {"SELF": c.mz} | {f["cut_info"]: f["mz"] for f in c.fragments}
                for ion, y in zip(ions, K.chromatograms(scans, np.array(list(ions.values())), ppm) if scans else [], strict=False):
                    y = y.astype(float)
                    y = series.gauss_filter(rt, y) if smooth else y
                    y = series.denoise(y, series.signal_to_noise(rt, y)) if denoise else y
                    out.append(pd.DataFrame({"run_id": key[0], "peptide_ref": c.peptide_ref, "decoy": bool(c.decoy), "ion": ion, "rt": rt, "intensity": y}))
        return pd.concat(out) if out else pd.DataFrame(columns=["run_id", "peptide_ref", "decoy", "ion", "rt", "intensity"])

    keep = ["run_id", "window_id", "peptide_ref", "decoy", "mz", "rt_start", "rt_end", "fragments"]
    schema = "run_id string, peptide_ref string, decoy boolean, ion string, rt double, intensity double"
    return coords.select(*keep).groupBy("run_id", "window_id").cogroup(spectra.groupBy("run_id", "window_id")).applyInPandas(run, schema)


def peptide_view(coords: DataFrame, spectra: DataFrame, weights: DataFrame | dict[tuple, dict[str, float]], least: DataFrame | None = None, ppm: float = 15, picker: str = "counts", smooth: bool = False, denoise: bool = False) -> tuple[DataFrame, DataFrame]:
    """Curves of coordinates as ``chromatogram_view`` gives them, and their peak groups scored anew under the runs' weights.

    The groups: those of ``peak_groups``, total_score, rank (1 is the best of a coordinate) and
    status: success where the best group's score reaches the run's ``least`` one (run_id,
    min_total_score), else failed, as all are of runs that have none.
    """
    curves = chromatogram_view(coords, spectra, ppm, smooth, denoise)
    total = learning.with_total(peak_groups(coords, spectra, ppm, picker), ["run_id"], weights, list(learning.SCORES), "total_score")
    order = Window.partitionBy("run_id", "peptide_ref", "decoy").orderBy(F.col("total_score").desc(), "idx")  # the groups of one coordinate
    ranked = total.withColumn("rank", F.row_number().over(order))
    if least is None:
        return curves, ranked.withColumn("status", F.lit(fdr.FAILED))
    joined = ranked.join(least.select("run_id", "min_total_score"), "run_id", "left")
    good = (F.col("rank") == 1) & (F.col("total_score") >= F.col("min_total_score"))
    return curves, joined.withColumn("status", F.when(good, fdr.SUCCESS).otherwise(fdr.FAILED)).drop("min_total_score")


def spectrum_view(spectra: DataFrame, low: float | None = None, high: float | None = None, smooth: bool = False) -> DataFrame:
    """Peaks of scans as rows: run_id, level, window_id, rt, mz, intensity, of an m/z range and smoothed (5 points) on demand."""
    rows = spectra.select("run_id", "level", "window_id", "rt", F.posexplode(F.arrays_zip("mz", "intensity")).alias("at", "p"))
    rows = rows.select("run_id", "level", "window_id", "rt", "at", F.col("p.mz").cast("double").alias("mz"), F.col("p.intensity").cast("double").alias("intensity"))
    if smooth:
        scan = ["run_id", "level", F.coalesce("window_id", F.lit(-1)), "rt"]
        w, near = series.weights("gauss", 5), Window.partitionBy(*scan).orderBy("at")
        at = lambda k: F.coalesce(F.lag("intensity", k).over(near) if k > 0 else F.lead("intensity", -k).over(near), F.lit(0.0))
        rows = rows.withColumn("intensity", w[0] * F.col("intensity") + sum(w[k] * (at(k) + at(-k)) for k in (1, 2)))
    if low is not None or high is not None:
        rows = rows.where(F.col("mz").between(-float("inf") if low is None else low, float("inf") if high is None else high))
    return rows.drop("at")
