import numpy as np
import pytest

from ionflow.functions import kernels as K
from ionflow.plans import analysis as A


def synthetic(seed=42, peptides=30):
    """A run with planted Gaussian peaks; decoys of the same shape have no signal but noise."""
    rng = np.random.default_rng(seed)
    k, b = 0.05, -20.0
    windows = [("r", i, 400.0 + 100 * i, 500.0 + 100 * i) for i in range(3)]
    rts = 350 + 3.0 * np.arange(100)
    peps, peaks = [], {(level, w): [[] for _ in rts] for level in (1, 2) for w in range(3)}
    letters = "ACDEFGHILMNPQSTVWY"
    for p in range(peptides):
        w = p % 3
        mz, lib = float(rng.uniform(405, 495) + 100 * w), float(rng.uniform(0, 8))
        seq = "".join(rng.choice(list(letters), 9)) + "K"
        masses = K.series_masses(seq, {}, 1)
        own = rng.choice(masses[(masses > 150)], 6, replace=False)
        inten = np.sort(rng.uniform(200, 1000, 6))[::-1]
        frags = [{"cut_info": f"y{i + 1}", "mz": float(m), "intensity": float(y), "charge": 1} for i, (m, y) in enumerate(zip(own, inten, strict=True))]
        noise = [{"cut_info": f"y{i + 1}", "mz": float(m), "intensity": float(y), "charge": 1} for i, (m, y) in enumerate(zip(rng.uniform(200, 1200, 6), inten, strict=True))]
        peps.append((f"{seq}_{p}", seq, 2, mz, lib, frags, noise, "".join(rng.permutation(list(seq)))))
        apex = (lib - b) / k
        shape = np.exp(-((rts - apex) ** 2) / (2 * 10.0**2))
        for i, s in enumerate(shape):
            if s > 1e-3:
                peaks[2, w][i] += [(m, y * 4 * s) for m, y in zip(own, inten, strict=True)] + [(m, 500 * s) for m in masses]
                peaks[1, w][i].append((mz, 20000 * s))
                peaks[2, w][i].append((mz, 900 * s))
    rows = []
    for (level, w), scans in peaks.items():
        for rt, pk in zip(rts, scans, strict=True):
            n = 400 if level == 2 else 40
            pk = sorted(pk + list(zip(rng.uniform(150, 1300, n), rng.uniform(1, 60, n), strict=True)))
            rows.append(("r", level, w if level == 2 else None, float(rt), [float(m) for m, _ in pk], [float(y) for _, y in pk]))
    ms1: dict = {}
    for run, level, w, rt, m, y in rows:
        if level == 1:
            ms1.setdefault(rt, []).extend(zip(m, y, strict=True))
    rows = [r for r in rows if r[1] == 2] + [("r", 1, None, rt, [m for m, _ in sorted(v)], [y for _, y in sorted(v)]) for rt, v in ms1.items()]
    return windows, peps, rows, (k, b)


@pytest.fixture(scope="module")
def run(spark):
    windows, peps, rows, truth = synthetic()
    frag = "array<struct<cut_info:string,mz:double,intensity:double,charge:int>>"
    lib = spark.createDataFrame([(*p, False, True, {}) for p in peps], f"peptide_ref string, sequence string, charge int, mz double, rt double, fragments {frag}, decoy_fragments {frag}, decoy_sequence string, disable boolean, is_unique boolean, unimod_map map<int,string>")
    w = spark.createDataFrame(windows, "run_id string, window_id int, mz_start double, mz_end double")
    s = spark.createDataFrame(rows, "run_id string, level int, window_id int, rt double, mz array<double>, intensity array<double>")
    return lib, w, s, truth


def test_calibration_and_groups(spark, run):
    lib, w, s, (k, b) = run
    fit = A.calibrate_run(lib, s, w).first()
    assert fit.slope == pytest.approx(k, rel=0.01) and fit.intercept == pytest.approx(b, rel=0.01)
    runs = spark.createDataFrame([("r", fit.slope, fit.intercept)], "run_id string, irt_slope double, irt_intercept double")
    coords = A.with_decoys(A.coordinates(lib, w, runs, 100.0))
    assert coords.count() == 60
    found = A.peak_groups(coords, A.spectra_by_window(s, w)).toPandas()
    best = found[~found.decoy].sort_values("Dotprod").groupby("peptide_ref").tail(1)
    truth = {r.peptide_ref: (r.rt - b) / k for r in lib.collect()}
    hits = sum(abs(r.apex_rt - truth[r.peptide_ref]) <= 3.0 for r in best.itertuples())
    assert hits >= 27
    assert best.Dotprod.median() > 0.9 and (best.CorrShape <= 1 + 1e-9).all() and best.IsoOverlap.ge(0).all()


def test_window_sums():
    s = K.Spectrum(np.array([100, 200, 300], np.float32), np.array([1, 2, 3], np.float32))
    assert s.total(np.array([150, 50, 250, 300]), np.array([250, 100, 400, 310])).tolist() == [2, 1, 3, 3]
    rng = np.random.default_rng(1)
    mz = np.sort(rng.uniform(100, 200, 500)).astype(np.float32)
    a = K.chromatograms([K.Spectrum(mz, np.ones(500, np.float32))], np.array([150.0]), 20000)
    b = K.chromatograms([K.Spectrum(mz, np.full(500, 3, np.float32))], np.array([150.0]), 20000)
    assert b == pytest.approx(3 * a) and a[0, 0] == ((mz >= np.float32(147)) & (mz <= np.float32(153))).sum()


def test_isotopes_and_ions():
    p = K.isotope_pattern(1000.0)
    assert p[0] > p[1] > p[2] and p.sum() == pytest.approx(1, abs=0.01)
    assert K.flank(np.array([0, 1, 2, 5, 3, 2, 3, 0]), 3, 1, 7, 1) == 7 and K.flank(np.array([0, 1, 2, 5, 3, 2, 4, 0]), 3, 1, 7, 1) == 5
    hull = {"y1": np.array([1.0, 9.0]), "y2": np.array([1.0, 1.0]), "y3": np.array([2.0, 2.0])}
    assert K.best_ion(hull, ["y1", "y2", "y3"], {"y1": 0.5, "y2": 0.3, "y3": 0.2}) == "y2"
    assert K.groups_by_shape(np.arange(60.0), {c: np.exp(-((np.arange(60.0) - 30) ** 2) / 50) * 100 + 0.01 for c in ("a", "b", "c")})[0][0] == 30


def scored_run(spark, run="r", seed=5, shift=0.0, peptides=80):
    from ionflow.operators.learning import SCORES

    rng = np.random.default_rng(seed)
    rows = []
    for i in range(2 * peptides):
        decoy = i % 2 == 1
        for g in range(2):
            good = not decoy and g == 0 and i < 1.5 * peptides
            rows.append((run, 1, f"p{i // 2}", decoy, g, 1.0 + i // 2, 1.0 + i // 2 + 100 * g, 10.0, 10.0, 1.0, "y1", *[float(x) for x in rng.normal(1.0 if good else 0.0, 0.35, len(SCORES)) + shift]))
    return spark.createDataFrame(rows, "run_id string, window_id int, peptide_ref string, decoy boolean, idx int, apex_rt double, selected_rt double, intensity_sum double, fit_int_sum double, ms1_sum double, best_ion string, " + ", ".join(f"{s} double" for s in SCORES))


def test_identify(spark):
    got = A.identify(scored_run(spark), 0.01, iterations=3).toPandas()
    planted = got[got.peptide_ref.isin([f"p{i}" for i in range(60)])]
    assert len(got) == 80 and (planted.status == 1).mean() > 0.9 and (got[~got.index.isin(planted.index)].status == 1).mean() <= 0.25


def test_runs_are_ranked_alone(spark):
    a, b = scored_run(spark, "a"), scored_run(spark, "b", 6, 5.0, 120)
    rows = lambda d: {(r.run_id, r.peptide_ref): (round(r.total_score, 6), r.status, round(r.fdr, 9)) for r in A.identify(d, 0.05, iterations=2).collect()}
    together = rows(a.unionByName(b))
    assert together == {**rows(a), **rows(b)} and sum(x[1] == 1 for k, x in together.items() if k[0] == "a") > 40


def test_second_round_takes_groups_from_the_weaker(spark):
    df = scored_run(spark)
    masses = [float(i) for i in range(8)]
    peptides = spark.createDataFrame([(f"p{i}", "PEPTIDEAAK", masses if i in (3, 4) else [1000.0 + 20 * i + k for k in range(8)]) for i in range(80)], "peptide_ref string, sequence string, fingerprints array<double>")
    one = {r.peptide_ref: r for r in A.identify(df, 0.05, iterations=2).collect()}
    two = {r.peptide_ref: r for r in A.identify(df, 0.05, iterations=2, peptides=peptides).collect()}
    weak = min("p3", "p4", key=lambda p: one[p].total_score)
    assert one["p3"].fdr <= 0.05 >= one["p4"].fdr and one[weak].selected_rt < 100 < two[weak].selected_rt
    assert all(one[p].selected_rt == two[p].selected_rt for p in one if p != weak)


def test_similar_peaks(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1.0, 2.0, 3.0, 4.0, 5.0, 9.0]
    rows = [("r", 1, "a", 1.0, 1.0, 5.0, a, 8), ("r", 1, "b", 1.2, 1.2, 3.0, b, 8), ("r", 1, "c", 50.0, 50.0, 1.0, [7.0], 8), ("r", 1, "d", 60.0, 60.0, 1.0, [8.0], 8), ("r", 1, "e", 70.0, 70.0, 9.0, a, 8), ("r", 2, "f", 1.1, 1.1, 1.0, a, 8), ("s", 1, "g", 1.1, 1.1, 1.0, a, 8), ("r", 1, "h", 70.5, 70.5, 8.95, a, 8), ("r", 1, "i", 71.0, 71.0, 2.0, b, 9)]
    df = spark.createDataFrame(rows, "run_id string, window_id int, peptide_ref string, apex_rt double, selected_rt double, total_score double, fingerprints array<double>, length int")
    assert {(r.peptide_ref, r.selected_rt) for r in A.similar_peaks(df).collect()} == {("b", 1.2), ("i", 71.0)}  # i shares 5, and the shorter has 8 letters
    scans = spark.createDataFrame([("r", 1, 1.05 + k / 100) for k in range(5)], "run_id string, window_id int, rt double")
    assert {r.peptide_ref for r in A.similar_peaks(df, scans).collect()} == {"i"}


def test_small_runs_and_fixed_rates(spark):
    from ionflow.operators import fdr

    rows = [("a", i, float(i), i % 3 == 0) for i in range(60)] + [("b", i, float(i), False) for i in range(10)] + [("c", i, float(i + 100 * (i % 2)), i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "run_id string, k int, s double, decoy boolean")
    got = {(r.run_id, r.k): r for r in fdr.pipeline_by(df, ["run_id"], ["k"], "s", "decoy", 0.05).collect()}
    alone = {r.k: r for r in fdr.pipeline(df.where("run_id = 'a'"), ["k"], "s", "decoy", 0.05).collect()}
    assert all(got["a", k].fdr == pytest.approx(r.fdr) and got["a", k].q_value == pytest.approx(r.q_value) and got["a", k].pi0 == pytest.approx(r.pi0) for k, r in alone.items())
    assert all(got["b", k].fdr is None and got["b", k].status == fdr.FAILED for k in range(10))
    assert got["c", 1].pi0 == 1e-6
    assert {r.p for r in fdr.parametric(spark.createDataFrame([(1.0, True), (1.0, True), (2.0, False), (0.5, False)], "s double, decoy boolean"), "s", "decoy").collect()} == {0.0, 1.0}
    assert [r.p for r in fdr.parametric(df.where("run_id = 'b'"), "s", "decoy").collect()] == [None] * 10


def test_quantities_and_deltas():
    """The fitted sum counts fragments without signal too; counts are compared with the largest over all scans; modifications weigh."""
    rt = np.arange(40.0)
    bell = np.exp(-((rt - 20) ** 2) / 18) * 1000
    scans = [K.Spectrum(np.array([300.0, 400.0], np.float32), np.array([y, y / 2], np.float32)) for y in bell]
    g = {"apex_rt": 20.0, "hull": {"y1": bell[10:31], "y2": bell[10:31] / 2}, "span": (10, 30), "apex": {"y1": 1000.0, "y2": 500.0}, "sn": 5.0, "ions_high": 3}
    s = K.score_group(g, {"y1": 100.0, "y2": 50.0}, {"y1": 300.0, "y2": 400.0}, {"y1": 1, "y2": 1}, scans[20], 12, 0.0, 1.0, 0.0, None, None, whole=200.0)
    assert s["fit_int_sum"] == pytest.approx(bell[10:31].sum() * 2) and s["IonsDelta"] == pytest.approx(9 / 12)
    plain, heavy = K.series_masses("PEPTIDEK", {}, 2), K.series_masses("PEPTIDEK", {2: 79.966331}, 2)
    assert len(plain) == len(heavy) and np.isclose(heavy.sum() - plain.sum(), 79.966331 * 14, atol=1e-2)
    x = np.arange(12.0) ** 1.1
    y = np.sin(x)
    v, b, c, d = __import__("ionflow.operators.series", fromlist=["x"]).natural_spline(x, y)
    h = np.diff(x)
    assert np.allclose(v + b * h + c * h**2 + d * h**3, y[1:]) and np.allclose(b[1:], (b + 2 * c * h + 3 * d * h**2)[:-1]) and np.allclose(c[1:], (c + 3 * d * h)[:-1])


def test_library_to_results(spark, run):
    """Decoys from the library, both pickers, masses of modifications, rates."""
    from ionflow.plans import library

    lib, w, s, (k, b) = run
    with_decoys = library.with_decoys(lib.drop("decoy_fragments", "decoy_sequence"))
    runs = spark.createDataFrame([("r", k, b)], "run_id string, irt_slope double, irt_intercept double")
    coords = A.with_decoys(A.coordinates(with_decoys, w, runs, 100.0))
    unimod = spark.createDataFrame([("4", 57.02)], "id string, mono_mass double")
    assert coords.where("decoy").count() == 30
    for picker in ("counts", "shape"):
        found = A.peak_groups(A.with_masses(coords, unimod), A.spectra_by_window(s, w), picker=picker)
        targets = found.where("NOT decoy").groupBy("peptide_ref").count().count()
        assert targets >= 24 and found.where("low_delta < 0 OR IonsDelta < 0").count() == 0


def test_one_peptide_and_views(spark, run):
    lib, w, s, (k, b) = run
    runs = spark.createDataFrame([("r", k, b)], "run_id string, irt_slope double, irt_intercept double")
    spectra, ref = A.spectra_by_window(s, w), lib.first().peptide_ref
    truth = {r.peptide_ref: (r.rt - b) / k for r in lib.collect()}
    one = A.predict(lib, ref, w, runs, spectra).collect()
    assert {r.peptide_ref for r in one} == {ref} and min(abs(r.apex_rt - truth[ref]) for r in one) <= 3.0
    mz = lib.first().mz
    other = A.coordinates(lib.where(lib.peptide_ref == ref), w, runs).first()
    assert A.predict(lib, ref, w.withColumns({"mz_start": w.mz_start * 2, "mz_end": w.mz_end * 2}), runs, spectra, charge=1).schema["peptide_ref"] and other.mz == mz
    coords = A.with_decoys(A.coordinates(lib, w, runs, 100.0)).where("NOT decoy")
    weights = {("r",): {c: float(c in ("Dotprod", "CorrShape")) for c in A.learning.SCORES}}
    chosen = A.reselect(coords, spectra, weights).collect()
    assert len(chosen) >= 25 and sum(abs(r.apex_rt - truth[r.peptide_ref]) <= 3.0 for r in chosen) >= 0.9 * len(chosen) and all(1 <= r.hits <= 6 for r in chosen)
    good = A.peak_groups(coords, spectra).where(A.looks_good()).collect()
    assert all(abs(r.apex_rt - truth[r.peptide_ref]) <= 6.0 for r in good)
    view = A.chromatogram_view(coords.where(coords.peptide_ref == ref), spectra).toPandas()
    assert set(view.ion) == {"MS1", "SELF", *(f"y{i}" for i in range(1, 7))}
    top = view[view.ion == "y1"].sort_values("intensity").iloc[-1]
    assert abs(top.rt - truth[ref]) <= 3.0
    smooth = A.chromatogram_view(coords.where(coords.peptide_ref == ref), spectra, smooth=True, denoise=True).toPandas()
    assert len(smooth) == len(view) and smooth.intensity.max() < view.intensity.max()
    least = spark.createDataFrame([("r", 0.5)], "run_id string, min_total_score double")
    curves, scored = A.peptide_view(coords.where(coords.peptide_ref == ref), spectra, weights, least)
    scored = sorted(scored.collect(), key=lambda r: r["rank"])
    assert curves.count() == len(view) and [r["rank"] for r in scored] == list(range(1, len(scored) + 1))
    assert all(r.total_score == pytest.approx(r.Dotprod + r.CorrShape) for r in scored) and [r.total_score for r in scored] == sorted((r.total_score for r in scored), reverse=True)
    assert scored[0].status == A.fdr.SUCCESS and {r.status for r in scored[1:]} <= {A.fdr.FAILED}
    assert {r.status for r in A.peptide_view(coords.where(coords.peptide_ref == ref), spectra, weights)[1].collect()} == {A.fdr.FAILED}
    peaks = A.spectrum_view(s.where("rt = 350"), 400.0, 600.0)
    rows = s.where("rt = 350").collect()
    assert peaks.count() == sum(400 <= m <= 600 for r in rows for m in r.mz)
    assert A.spectrum_view(s.where("rt = 350"), smooth=True).count() == sum(len(r.mz) for r in rows)


def test_tiles_give_the_untiled_rows(spark, run):
    """Tiles and parts of any size, with sparse MS1 scans and times outside of them."""
    lib, w, s, (k, b) = run
    runs = spark.createDataFrame([("r", k, b)], "run_id string, irt_slope double, irt_intercept double")
    coords = A.with_decoys(A.coordinates(lib, w, runs, 60.0)).cache()
    every = A.spectra_by_window(s, w)
    sparse = every.where("level = 2 OR (rt > 440 AND CAST((rt - 350) / 3 AS INT) % 9 = 0)").cache()
    for spectra in (every, sparse):
        for picker, align in (("counts", "nearest"), ("shape", "order")):
            want = sorted(A.peak_groups(coords, spectra, width=None, picker=picker, align=align).collect())
            assert len(want) > 20
            for width, block in ((45.0, 2500), (300.0, 4)):
                left, right = A.dealt(coords, spectra, width, block)
                assert left.select(*A.TILE).distinct().count() > 9 and left.count() == coords.count()
                assert sorted(A.peak_groups(coords, spectra, picker=picker, align=align, width=width, block=block).collect()) == want
    parts = A.dealt(coords, sparse, 300.0, 4)[1]
    assert parts.groupBy(*A.TILE).agg({"rt": "count"}).count() > 9


def test_a_hot_window_spreads(spark):
    """20 000 coordinates of one window go to 8 parts and more, and give what one task gives."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rts = np.arange(200.0) * 5
    frag = "array<struct<cut_info:string,mz:double,intensity:double,charge:int>>"
    bell = lambda at: 5000 * np.exp(-((rts - at) ** 2) / 200)
    peps, scans = [], [([], []) for _ in rts]
    for i in range(40):
        own, at = np.sort(rng.uniform(200, 1200, 6)), float(rng.uniform(100, 900))
        for (m, y), v in zip(scans, bell(at), strict=True):
            if v > 1:
                m += own.tolist()
                y += [float(v)] * 6
        peps.append((f"p{i}", "PEPTIDEK", 2, float(rng.uniform(400, 500)), at, [(f"y{j + 1}", float(x), 100.0 - j, 1) for j, x in enumerate(own)]))
    rows = [("r", 2, 0, float(t), *(list(x) for x in zip(*sorted(zip(m, y, strict=True)), strict=True))) if m else ("r", 2, 0, float(t), [1.0], [1.0]) for t, (m, y) in zip(rts, scans, strict=True)]
    spectra = spark.createDataFrame(rows, "run_id string, level int, window_id int, rt double, mz array<double>, intensity array<double>")
    few = spark.createDataFrame(peps, f"peptide_ref string, sequence string, charge int, mz double, rt double, fragments {frag}")
    blank = spark.range(20_000 - 40).select(F.concat(F.lit("q"), "id").alias("peptide_ref"), F.lit("PEPTIDEK").alias("sequence"), F.lit(2).alias("charge"), F.lit(450.0).alias("mz"), F.lit(500.0).alias("rt"), F.array(*[F.struct(F.lit(f"y{j}").alias("cut_info"), (1300 + F.col("id") / 100 + j).alias("mz"), F.lit(1.0).alias("intensity"), F.lit(1).alias("charge")) for j in range(6)]).alias("fragments"))
    coords = few.unionByName(blank).select("*", F.lit("r").alias("run_id"), F.lit(0).alias("window_id"), F.lit(False).alias("decoy"), (F.col("rt") - 50).alias("rt_start"), (F.col("rt") + 50).alias("rt_end"), F.lit(1.0).alias("irt_slope"), F.lit(0.0).alias("irt_intercept"))
    left, _ = A.dealt(coords, spectra)
    sizes = [r["count"] for r in left.groupBy(*A.TILE).count().collect()]
    assert sum(sizes) == 20_000 and sum(n > 1000 for n in sizes) >= 8 and max(sizes) < 3500
    got = sorted(A.peak_groups(coords, spectra, picker="shape").collect())
    assert got == sorted(A.peak_groups(coords, spectra, width=None, picker="shape").collect()) and len({r.peptide_ref for r in got}) >= 5
