import os
import random

import pyarrow as pa
import pytest

from ionflow import catalog
from ionflow.plans import proximity as P

SCHEMA = "peptide_ref string, proteins array<string>, mz double, rt double, fragments array<struct<cut_info:string,mz:double,intensity:double>>"
WINDOWS = [(0, 400.0, 450.0), (1, 449.0, 500.0), (2, 500.0, 600.0)]


def library(n, seed=1, step=0.125):
    """Peptides whose masses are eighths, so that ends of ranges are met exactly."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        proteins = rng.choice([[f"P{rng.randrange(8)}"], [f"P{rng.randrange(8)}", f"P{rng.randrange(8)}"], [], None])
        frags = [(f"y{k}", 200 + step * rng.randrange(400), float(rng.randrange(0, 50))) for k in range(rng.randrange(0, 7))]
        out.append((f"p{i:03}", proteins, 390 + 0.5 * rng.randrange(440), float(rng.randrange(100)), frags))
    return out


def plain(peptides, reach):
    """Two nested loops over all fragments."""
    windows = lambda mz: [w for w, a, b in WINDOWS if a <= mz <= b]
    nodes = [(ref, k, set(proteins), mz, f) for ref, proteins, mz, _, frags in sorted(peptides) if proteins for k, f in enumerate(frags)]
    out, edges = {}, set()
    for protein in sorted({p for n in nodes for p in n[2]}):
        for ref, k, proteins, mz, f in nodes:
            if protein not in proteins:
                continue
            own = [n for n in nodes if protein in n[2] and (n[0], n[1]) > (ref, k) and abs(n[4][1] - f[1]) <= reach]
            home = max(windows(mz), default=None)
            other = [n for n in nodes if protein not in n[2] and home in windows(n[3]) and home is not None and abs(n[4][1] - f[1]) < reach]
            out[protein, ref, f[0]] = len(own), len(other)
            edges |= {(protein, "own", n[0], n[4][0], ref, f[0]) for n in own} | {(protein, "other", n[0], n[4][0], ref, f[0]) for n in other}
    return out, edges


def test_counts_and_links_equal_a_nested_loop(spark):
    peptides = library(300)
    df, windows = spark.createDataFrame(peptides, SCHEMA).repartition(3), spark.createDataFrame(WINDOWS, "window_id int, mz_start double, mz_end double")
    for reach in (0.25, 2.0):
        want, edges = plain(peptides, reach)
        got = P.link_counts(df, windows, reach).collect()
        assert len(got) == len(want) and {(r.protein, r.peptide_ref, r.cut_info): (r.own_links, r.other_links) for r in got} == want
        assert sum(a for a, _ in want.values()) > 50 and sum(b for _, b in want.values()) > 50
    links = P.graph(df, windows, "P3", 2.0).collect()
    assert sorted(("P3", r.kind, r.source_peptide_ref, r.source_cut_info, r.target_peptide_ref, r.target_cut_info) for r in links) == sorted(e for e in edges if e[0] == "P3")
    by = {(ref, f[0]): (f[2], rt) for ref, _, _, rt, frags in peptides for f in frags}
    for r in links:
        (s, srt), (t, trt) = by[r.source_peptide_ref, r.source_cut_info], by[r.target_peptide_ref, r.target_cut_info]
        assert r.rt_gap == abs(srt - trt) and r.intensity == (None if not t else pytest.approx(abs(t - s) / t if r.kind == "own" else s / t))


def test_a_dense_stretch_forms_no_pairs(spark):
    """4 000 fragments at one mass: 16 million pairs are counted, none is formed."""
    peptides = [(f"p{i:05}", [f"P{i % 50}"], 420.0, 0.0, [("y1", 300.0, 1.0)]) for i in range(4000)]
    df, windows = spark.createDataFrame(peptides, SCHEMA), spark.createDataFrame(WINDOWS, "window_id int, mz_start double, mz_end double")
    counts = P.link_counts(df, windows, 0.5).cache()
    rows = counts.collect()
    assert {r.other_links for r in rows} == {3920} and sorted(r.own_links for r in rows if r.protein == "P7") == list(range(80))
    assert P.link_counts(df.where("false"), windows, 0.5).count() == 0


def counted(df, reach, windows):
    rows = P.link_counts(df, windows, reach).collect()
    return len(rows), {(r.protein, r.peptide_ref, r.cut_info): (r.own_links, r.other_links) for r in rows}


def test_crowded_stretches_are_dealt_out(spark, monkeypatch):
    """Targets of a window and stretch in several tasks; half of all fragments have one of two masses."""
    monkeypatch.setattr(P, "SHARE", 8)
    rng = random.Random(9)
    peptides = [(ref, proteins, mz, rt, [(c, rng.choice([m, 210.0, 212.0]), i) for c, m, i in frags]) for ref, proteins, mz, rt, frags in library(250, 5)]
    df, windows = spark.createDataFrame(peptides, SCHEMA).repartition(5), spark.createDataFrame(WINDOWS, "window_id int, mz_start double, mz_end double")
    for reach in (0.25, 2.0, 100.0):
        want, _ = plain(peptides, reach)
        assert counted(df, reach, windows) == (len(want), want)


def test_fragments_without_a_mass_have_no_links(spark):
    odd = [float("nan"), float("inf"), float("-inf"), None, 300.0]
    peptides = [(f"p{i}", [f"P{i % 3}"], 420.0 + 100 * (i % 4), 0.0, [(f"y{k}", m, 1.0) for k, m in enumerate(odd)]) for i in range(12)]
    windows = spark.createDataFrame(WINDOWS, "window_id int, mz_start double, mz_end double")
    known = [(*p[:4], [(c, float("nan") if m is None else m, i) for c, m, i in p[4]]) for p in peptides]
    want, _ = plain(known, 2.0)
    assert counted(spark.createDataFrame(peptides, SCHEMA), 2.0, windows) == (60, want) and max(b for _, b in want.values()) > 1


def test_whole_proteins_are_taken_together(monkeypatch):
    monkeypatch.setattr(P, "TOGETHER", 5)
    proteins = [f"P{p}" for p in range(9) for _ in range(1 + p * p % 7)]
    batches = pa.table({"protein": proteins, "mz": [[1.0] * (i % 4) for i in range(len(proteins))]}).to_batches(2)
    for whole in ("protein", None):
        found = [t["protein"].to_pylist() for t in P._together(iter(batches), whole)]
        assert sum(found, []) == proteins and len(found) > 4
    found = [t["protein"].to_pylist() for t in P._together(iter(batches), "protein")]
    assert all(a[-1] != b[0] for a, b in zip(found, found[1:]))


def test_little_is_written(spark):
    """Checkpoints and exchanges of a fragment take less than 200 bytes; running sums joined back took over 500."""

    def size():
        folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
        folders.append(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
        return sum(os.path.getsize(os.path.join(d, f)) for folder in folders for d, _, files in os.walk(folder) for f in files)

    spark._jvm.System.gc()
    peptides = [(f"{i:012}", [f"P{i % 900}"], 390 + 0.02 * (i * 7 % 11000), 0.0, [(f"y{k}", 200 + 0.01 * ((i * 31 + k * 7919) % 90_000), 1.0) for k in range(6)]) for i in range(5000)]
    df = spark.createDataFrame(peptides, SCHEMA).repartition(3).persist()
    windows = spark.createDataFrame(WINDOWS, "window_id int, mz_start double, mz_end double")
    df.count()
    before = size()
    links = P.link_counts(df, windows, 0.5)
    assert links.count() == 30_000
    assert size() - before < 200 * 30_000
    df.unpersist()


def test_lines_of_an_order_follow_their_numbers(spark, tmp_path):
    """Line 10 is later than line 9."""
    spark.createDataFrame([(1, 7, 1000.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, n, 500.0 + n, 1.0) for n in range(8, 12)], "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalog.QUERIES["proximity_links"](spark, str(tmp_path)).collect()
    assert {r.l_linenumber: r.own_links for r in rows} == {8: 3, 9: 2, 10: 1, 11: 0}
