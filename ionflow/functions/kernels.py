"""NumPy kernels of a run's analysis: chromatograms, ion counts, peak groups and their scores."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ionflow.functions.peptides import ENDS, H, RESIDUES
from ionflow.operators import series

C13 = 1.0033548
ISOTOPES = 5
WINDOW = 0.025
# Averagine composition and average element masses, and natural isotope shares by extra mass.
AVERAGINE = {"C": 4.9384, "N": 1.3577, "O": 1.4773, "S": 0.0417}
AVERAGINE_MASS = 111.1254
AVERAGE = {"C": 12.0107, "N": 14.0067, "O": 15.9994, "S": 32.065, "H": 1.00794}
SHARES = {"C": (0.9893, 0.0107), "H": (0.999885, 0.000115), "N": (0.99632, 0.00368), "O": (0.99757, 0.00038, 0.00205), "S": (0.9493, 0.0076, 0.0429, 0.0, 0.0002)}


@dataclass
class Spectrum:
    """Peaks of one scan with running sums, so any window is two lookups."""

    mz: np.ndarray
    intensity: np.ndarray
    sums: np.ndarray = field(init=False)
    moments: np.ndarray = field(init=False)

    def __post_init__(self):
        y = self.intensity.astype(float)
        self.sums = np.concatenate([[0.0], np.cumsum(y)])
        self.moments = np.concatenate([[0.0], np.cumsum(y * self.mz)])

    def total(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Summed intensity of closed windows."""
        return self.sums[np.searchsorted(self.mz, high, "right")] - self.sums[np.searchsorted(self.mz, low, "left")]

    def centroid(self, low: float, high: float) -> tuple[float, float] | None:
        """(intensity, weighted m/z) of a window; None if it is empty."""
        a, b = np.searchsorted(self.mz, low, "left"), np.searchsorted(self.mz, high, "right")
        y = self.sums[b] - self.sums[a]
        return (y, (self.moments[b] - self.moments[a]) / y) if y > 0 else None


def chromatograms(spectra: list[Spectrum], targets: np.ndarray, ppm: float) -> np.ndarray:
    """Intensities (target, scan) within ppm; windows in single precision."""
    t = np.asarray(targets, np.float32)
    w = t * np.float32(ppm) * np.float32(1e-6)
    low, high = t - w, t + w
    return np.array([s.total(low, high) for s in spectra], np.float32).T.reshape(len(t), len(spectra))


def series_masses(sequence: str, mods: dict[int, float], charges: int = 1) -> np.ndarray:
    """b and y masses of all cuts at four digits, for charges 0 up to one less, undivided; unknown letters weigh nothing."""
    r = np.array([RESIDUES.get(c, 0.0) + mods.get(i, 0.0) for i, c in enumerate(sequence)])
    b, y = np.cumsum(r)[:-1], np.cumsum(r[::-1])[:-1]
    return np.unique(np.round(np.concatenate([np.concatenate([b + ENDS["b"], y + ENDS["y"]]) + z * H for z in range(charges)]), 4)) if len(r) > 1 else np.zeros(0)


def ion_counts(spectra: list[Spectrum], masses: np.ndarray, most: np.ndarray, low: float = 50, high: float = 300, width: float = 0.015, ppm: float = 10) -> tuple[np.ndarray, np.ndarray]:
    """Per scan the theoretical masses seen above ``low`` and above ``high``, none above ``most``."""
    n_low, n_high = np.zeros(len(spectra), int), np.zeros(len(spectra), int)
    for i, s in enumerate(spectra):
        a, b = np.searchsorted(s.mz, masses - width, "left"), np.searchsorted(s.mz, masses + width, "right")
        y, m = s.sums[b] - s.sums[a], s.moments[b] - s.moments[a]
        with np.errstate(invalid="ignore", divide="ignore"):
            near = np.abs(masses - m / y) * 1e6 / masses < ppm
        ok = (y > low) & (y <= most[i]) & near
        n_low[i], n_high[i] = ok.sum(), (ok & (y > high)).sum()
    return n_low, n_high


def isotope_pattern(mass: float) -> np.ndarray:
    """First isotopes of a molecule of average composition."""
    count = {e: round(n * mass / AVERAGINE_MASS) for e, n in AVERAGINE.items()}
    count["H"] = max(0, round((mass - sum(AVERAGE[e] * n for e, n in count.items())) / AVERAGE["H"]))
    out = np.eye(1, ISOTOPES)[0]
    for e, n in count.items():
        power, base = np.eye(1, ISOTOPES)[0], np.array(SHARES[e])
        while n:
            if n & 1:
                power = np.convolve(power, base)[:ISOTOPES]
            base, n = np.convolve(base, base)[:ISOTOPES], n >> 1
        out = np.convolve(out, power)[:ISOTOPES]
    return out


def pearson(a: np.ndarray, b: np.ndarray, missing: float) -> float:
    if len(a) < 2 or a.std() == 0 or b.std() == 0:
        return missing
    return float(np.corrcoef(a, b)[0, 1])


def root_product(a: np.ndarray, b: np.ndarray) -> float:
    na, nb = a.sum(), b.sum()
    return float(np.sqrt(a * b).sum() / math.sqrt(na * nb)) if na > 0 and nb > 0 else 0.0


def flank(counts: np.ndarray, at: int, step: int, end: int, rises: int) -> int:
    """Widen by two scans, then go on while counts don't rise; ``rises`` single steps up are let through."""
    i = at + step * (2 if 0 <= at + 2 * step <= len(counts) - 1 else 1)
    while i != end and counts[i] > 0:
        up = counts[i + step] - counts[i]
        if up > 0:
            if up > 1 or not rises:
                break
            rises -= 1
        i += step
    return i


def groups_by_counts(rt: np.ndarray, eics: dict[str, np.ndarray], library: list[str], high: np.ndarray, low: np.ndarray, ms1: np.ndarray | None, own: np.ndarray | None) -> list[dict]:
    """Peak groups at the maxima of the smoothed ion counts."""
    out = []
    smooth = series.gauss_filter(rt, high.astype(float))
    noise = {c: series.signal_to_noise(rt, y.astype(float)) for c, y in eics.items()}
    last = len(rt) - 1
    for p in series.pick_peaks(rt, smooth):
        k = int(np.abs(rt - p["apex"]).argmin())
        top = eics.get(library[0])
        if k in (0, last) or top is None or top[k] == 0 or (ms1 is not None and (ms1[k] < top[k] or (own is not None and ms1[k] < own[k]))):
            continue
        rises = int(high[k] >= 6)
        a, b = flank(high, k, -1, 0, rises), flank(high, k, 1, last, rises)
        hull = {c: y[a : b + 1].astype(float) for c, y in eics.items()}
        total = sum(y.sum() for y in hull.values())
        if total:
            out.append({"apex_rt": p["apex"], "selected_rt": float(rt[k]), "left_rt": float(rt[a]), "right_rt": float(rt[b]), "scan": k, "hull": hull, "span": (a, b), "intensity_sum": total,
                        "ms1_sum": float(ms1[k]) if ms1 is not None else 0.0, "ions_low": int(low[k]), "ions_high": int(high[k]), "sn": sum(n[k] for n in noise.values()) / len(noise), "apex": {c: float(y[k]) for c, y in eics.items()}})
    return out


def groups_by_shape(rt: np.ndarray, eics: dict[str, np.ndarray], share: float = 0.4) -> list[tuple[int, int, int]]:
    """(apex, left, right) scans where enough fragments peak within a scan of each other; borders are those of the strongest."""
    density, marks = np.zeros(len(rt)), []
    for y in eics.values():
        for p in series.pick_peaks(rt, series.gauss_filter(rt, y.astype(float))):
            k = int(np.abs(rt - p["apex"]).argmin())
            density[k] += 1
            marks.append((k, float(y[k]), *(int(np.abs(rt - p[s]).argmin()) for s in ("left", "right"))))
    near = density + share * (np.concatenate([[0], density[:-1]]) + np.concatenate([density[1:], [0]]))
    need, out, last = round(share * len(eics) * 10) / 10, [], -2
    for k in np.flatnonzero(near >= need):
        members = [m for m in marks if abs(m[0] - k) <= 1]
        if members and k > last + 1:
            best = max(members, key=lambda m: m[1])
            out.append((best[0], best[2], best[3]))
        last = k
    return out


def groups_at(rt: np.ndarray, eics: dict[str, np.ndarray], spans: list[tuple[int, int, int]], high: np.ndarray, low: np.ndarray, ms1: np.ndarray | None) -> list[dict]:
    """Peak groups at given (apex, left, right) scans."""
    out = []
    noise = {c: series.signal_to_noise(rt, y.astype(float)) for c, y in eics.items()} if spans else {}
    for k, a, b in spans:
        hull = {c: y[a : b + 1].astype(float) for c, y in eics.items()}
        total = sum(y.sum() for y in hull.values())
        if total:
            out.append({"apex_rt": float(rt[k]), "selected_rt": float(rt[k]), "left_rt": float(rt[a]), "right_rt": float(rt[b]), "scan": k, "hull": hull, "span": (a, b), "intensity_sum": total,
                        "ms1_sum": float(ms1[k]) if ms1 is not None else 0.0, "ions_low": int(low[k]), "ions_high": int(high[k]), "sn": sum(n[k] for n in noise.values()) / len(noise), "apex": {c: float(y[k]) for c, y in eics.items()}})
    return out


def best_ion(hull: dict[str, np.ndarray], library: list[str], weights: dict[str, float]) -> str:
    """The first library ion that is there, unless it is the largest by over twice its library ratio to the next one."""
    there = [c for c in library if c in hull]
    total = {c: hull[c].sum() for c in there}
    first = there[0]
    if len(there) > 1 and first == max(there, key=lambda c: total[c]) and total[there[1]] > 0 and total[first] / total[there[1]] / (weights[first] / weights[there[1]]) > 2:
        return next((c for c in library[1:] if c in hull), first)
    return first


def score_group(g: dict, library: dict[str, float], mzs: dict[str, float], charges: dict[str, int], spectrum: Spectrum, most_high: int, lib_rt: float, slope: float, intercept: float, ms1: np.ndarray | None, own: np.ndarray | None, whole: float | None = None) -> dict[str, float]:
    """All sub-scores of one peak group and its best ion and fitted quantity; ``most_high`` counts over all scans, ``whole`` is the library intensity of all fragments, seen or not."""
    ions = [c for c in library if c in g["hull"]]
    lib = np.array([library[c] for c in ions])
    weight = {c: library[c] / sum(library.values()) for c in library}
    run = np.array([g["hull"][c].sum() for c in ions])
    apex = np.array([g["apex"][c] for c in ions])
    shape = series.shape_scores([g["hull"][c] for c in ions], lib)
    r, l = run / run.sum(), lib / lib.sum()  # noqa: E741
    sr, sl = np.sqrt(run), np.sqrt(lib)
    ratio = run / lib
    s = {"CorrShape": shape["shape"], "CorrShapeW": shape["shape_weighted"], "CorrCoe": shape["coelution"], "CorrCoeW": shape["coelution_weighted"]}
    s |= {"Pearson": max(pearson(run, lib, 0.0), pearson(apex, lib, 0.0)), "Dotprod": root_product(run, lib), "IntShift": float((ratio.max() - ratio.min()) / ratio.max()), "Rsmd": float(np.abs(l - r).mean())}
    s |= {"Manhattan": float(np.abs(sr / sr.sum() - sl / sl.sum()).sum()), "Sangle": float(np.arccos(min(1.0, (run * lib).sum() / math.sqrt((run**2).sum() * (lib**2).sum())))), "AvgSqr": float(np.sqrt(((l - r) ** 2).mean()))}
    s |= {"NormRt": abs(slope * g["apex_rt"] + intercept - lib_rt), "IonsDelta": (most_high - g["ions_high"]) / most_high if most_high else 1.0, "LogSn": math.log(g["sn"]) if g["sn"] >= 1 else 0.0}
    dev = dev_w = iso = overlap = 0.0
    for c, part in zip(ions, r, strict=True):
        mz, z = mzs[c], charges[c]
        at = spectrum.centroid(mz - WINDOW, mz + WINDOW)
        if at:
            ppm = abs(at[1] - mz) * 1e6 / mz
            dev, dev_w = dev + ppm, dev_w + ppm * weight[c]
        seen = np.array([(spectrum.centroid(mz + k * C13 / z - WINDOW, mz + k * C13 / z + WINDOW) or (0.0, 0.0))[0] for k in range(ISOTOPES)])
        iso += part * pearson(seen, isotope_pattern(mz * z), 0.0)
        for q in range(1, ISOTOPES):
            before = spectrum.centroid(mz - C13 / q - WINDOW, mz - C13 / q + WINDOW)
            if before and seen[0] and before[0] > seen[0] and abs(before[1] - mz + C13 / q) / (mz - C13 / q) < 2e-5:
                overlap += part
    s |= {"MassDev": dev, "MassDevW": dev_w, "IsoCorr": iso, "IsoOverlap": overlap}
    best = best_ion(g["hull"], list(library), weight)
    a, b = g["span"]
    y = g["hull"][best]
    w = series.weights("gauss", 5)
    padded = np.pad(y, 2)
    smooth = sum(w[abs(k)] * padded[2 + k : 2 + k + len(y)] for k in range(-2, 3))
    s["Elution"] = float(np.mean([pearson(smooth, g["hull"][c], -1.0) for c in ions]))
    one = ms1[a : b + 1].astype(float) if ms1 is not None else None
    self_ = own[a : b + 1].astype(float) if own is not None else np.zeros_like(y)
    s |= {"MS1": pearson(y, one, -1.0) if one is not None else -1.0, "SELF": pearson(y, self_, -1.0), "MS1_SELF": pearson(one, self_, -1.0) if one is not None else -1.0, "SELF_DP": root_product(y, self_)}
    return s | {"best_ion": best, "fit_int_sum": float(y.sum() * (sum(library.values()) if whole is None else whole) / library[best])}
