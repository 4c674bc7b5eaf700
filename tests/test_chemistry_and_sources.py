import numpy as np
import pytest
from pyspark.sql import functions as F

from ionflow.plans import library
from ionflow.functions import peptides as P
from ionflow.sources import libraries as L
from ionflow.sources.tables import Table, cascade


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_peptide_functions(spark):
    assert one(spark, P.mz(F.lit("GTFIIDPGGVIR"), "full", 2)) == pytest.approx(622.854062, abs=1e-5)
    name = F.lit("SLMLSYN(UniMod:7)AITHLPAGIFR")
    assert one(spark, P.modifications(name)) == {6: "7"} and one(spark, P.strip_modifications(name)) == "SLMLSYNAITHLPAGIFR"
    assert one(spark, P.modifications(F.lit("A(UniMod:4)CD(UniMod:21)E"))) == {0: "4", 2: "21"}
    assert one(spark, P.modifications(F.lit("(UniMod:1)ACD(UniMod:4)"))) == {} and one(spark, P.modifications(F.lit("ACD"))) == {}
    a = one(spark, P.annotation(F.lit("y7-18^2i/0.02,b3")))
    assert (a.type, a.location, a.adjust, a.charge, a.isotope, a.deviation) == ("y", 7, -18, 2, True, 0.02)
    assert one(spark, P.annotation(F.lit("[b3]"))).charge == 1
    assert set(one(spark, P.proteins(F.lit("2/sp|A|A_HUMAN/sp|B|B_YEAS8")))) == {"sp|A|A_HUMAN", "sp|B|B_YEAS8"}
    assert one(spark, P.proteins(F.lit("1/iRT_standard"))) == ["iRT"]
    assert sorted(one(spark, P.digest(F.lit("MKAARGGKPEP"), 2, 10))) == ["AAR", "GGK", "MK", "PEP"]
    assert one(spark, P.cut_charge(F.lit("y3^2"))) == 2 and one(spark, P.cut_charge(F.lit("b5"))) == 1
    assert one(spark, P.identity(F.lit("ABCD"), F.lit("ABDC"))) == 0.5 and one(spark, P.identity(F.lit("A"), F.lit("AB"))) == 0.0
    assert one(spark, P.decoy_by_ends(F.lit("GTFR"))) == "LTFL"


def test_decoys(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["PEPTIDEK", "AAAAR", "K", "", "GTFIIDPGGVIR"])], "k long, s string")
    for method in ("shuffle", "derange"):
        a, b = (P.decoys(df, "k", "s", method).orderBy("k").collect() for _ in "ab")
        assert a == b
        for r in a:
            assert sorted(r.s) == sorted(r.decoy_sequence) and (not r.s or r.s[-1] not in "KPR" or r.s[-1] == r.decoy_sequence[-1])
    rows = P.fragments(df.where("k = 0"), "s", charges=(1, 2)).collect()
    assert len(rows) == 2 * 2 * 7 and {r.cut_info for r in rows} >= {"y3", "y3^2", "b7"}
    assert len(one(spark, P.fingerprint(F.lit("PEPTIDEK")))) == 14


def plain_mz(sequence, mods, note):
    kind, n, z = note[0], int(note[1:].split("^")[0]), int(note.partition("^")[2] or 1)
    at = range(n) if kind in "abc" else range(len(sequence) - n, len(sequence))
    return (sum(P.RESIDUES.get(sequence[i], 0.0) + {"4": 57.02, "35": 15.99}.get(mods.get(i), 0.0) for i in at) + P.ENDS[kind] + z * P.H) / z


@pytest.mark.parametrize("method", ["shuffle", "derange", "ends"])
def test_decoy_fragments(spark, method):
    rows = [("a", "PEPTMDECK", {7: "4", 4: "35"}), ("b", "ACDEFGHIR", {}), ("c", "AC", {0: "35"})]
    frags = F.array(*[F.struct(F.lit(c).alias("cut_info"), F.lit(1.0).alias("mz"), F.lit(5.0).alias("intensity")) for c in ("y3", "b4^2", "y9", "b1")])
    df = spark.createDataFrame(rows, "peptide_ref string, sequence string, unimod_map map<int,string>").withColumn("fragments", frags)
    for r in library.with_decoys(df, method, {"4": 57.02, "35": 15.99}).collect():
        mods = dict(r.unimod_map)
        assert sorted(r.decoy_unimod_map.values()) == sorted(mods.values())
        if method != "ends":
            assert sorted(zip(r.sequence, (mods.get(i, "") for i in range(len(r.sequence))), strict=True)) == sorted(zip(r.decoy_sequence, (r.decoy_unimod_map.get(i, "") for i in range(len(r.sequence))), strict=True))
        want = {c: plain_mz(r.decoy_sequence, r.decoy_unimod_map, c) for c in ("y3", "b4^2", "y9", "b1") if int(c[1]) <= len(r.sequence)}
        assert {f.cut_info: f.mz for f in r.decoy_fragments} == pytest.approx(want) and all(f.intensity == 5.0 for f in r.decoy_fragments)


def test_library_tables(spark):
    proteins = spark.createDataFrame([("P1", "AAAAAAKCCCCCCR"), ("P2", "CCCCCCRDDDDDDDK"), ("P3", None)], "identifier string, sequence string")
    lib = library.of_proteins(proteins, charges=(2, 3))
    rows = {r.peptide_ref: r for r in lib.collect()}
    assert set(rows) == {f"{s}_{z}" for s in ("AAAAAAK", "CCCCCCR", "DDDDDDDK") for z in (2, 3)}
    r = rows["CCCCCCR_2"]
    assert r.proteins == ["P1", "P2"] and not r.is_unique and rows["AAAAAAK_3"].is_unique
    assert [f.cut_info for f in r.fragments] == ["y6", "b6", "y5", "b5", "y4", "b4"] and r.fragments[0].mz == pytest.approx(plain_mz("CCCCCCR", {}, "y6"))
    assert r.mz == pytest.approx(one(spark, P.mz(F.lit("CCCCCCR"), "full", 2)))
    assert {x.peptide_ref for x in library.peptides_of(lib, "P1").collect()} == {"AAAAAAK_2", "AAAAAAK_3", "CCCCCCR_2", "CCCCCCR_3"}
    with_ = library.with_decoys(lib)
    assert "decoy_fragments" in library.clone(with_, "x").columns and "decoy_fragments" not in library.clone(with_, "x", decoys=False).columns
    more = library.with_fragments(lib.where("charge = 2"), F.array(F.struct(F.lit("y6").alias("cut_info"), F.lit(1.0).alias("mz"), F.lit(2.0).alias("intensity"), F.lit(1).alias("charge")), F.struct(F.lit("b1").alias("cut_info"), F.lit(1.0).alias("mz"), F.lit(2.0).alias("intensity"), F.lit(1).alias("charge")))).first()
    assert [f.cut_info for f in more.fragments].count("y6") == 1 and more.fragments[-1].cut_info == "b1"
    rest, report = library.removed(lib, spark.createDataFrame([("CCCCCCR_2",), ("nope",), ("nope",)], "peptide_ref string"), "peptide_ref")
    assert rest.count() == 5 and {r.peptide_ref: r.rows for r in report.collect()} == {"CCCCCCR_2": 1, "nope": 0}
    found = spark.createDataFrame([("r", "p", 1.0, 2.0, 1.4, 1.5, 7.0), ("r", "q", 1.0, 2.0, 1.4, 1.5, 7.0)], "run_id string, peptide_ref string, left_rt double, right_rt double, apex_rt double, selected_rt double, total_score double")
    hand = {r.peptide_ref: r for r in library.override(found, spark.createDataFrame([("r", "p", 3.0, 5.0)], "run_id string, peptide_ref string, left_rt double, right_rt double")).collect()}
    assert hand["p"].apex_rt == 4.0 and hand["p"].by_hand and hand["p"].total_score is None and hand["q"].total_score == 7.0


def test_names_and_masses(spark):
    mods = F.create_map(F.lit(0), F.lit("1"), F.lit(2), F.lit("4"))
    assert one(spark, P.full_name(F.lit("ACDE"), mods)) == "A(UniMod:1)CD(UniMod:4)E"
    assert [(b.peptide_ref, b.charge, b.mz) for b in one(spark, P.brothers(F.lit("ACDE"), F.lit(600.0), F.lit(2)))] == [("ACDE_1", 1, 1200.0), ("ACDE_3", 3, 400.0)]
    assert one(spark, P.formula(F.lit("H:2, O:1"))) == {"H": 2, "O": 1} and one(spark, P.formula(F.lit(""))) == {}
    assert one(spark, P.mz(F.lit("PEPTIDE"), "full", 1, average=True)) == pytest.approx(799.83 + 1.00794, abs=0.02)
    assert one(spark, P.mz(F.lit("PEPTIDE"), "full", 1)) == pytest.approx(799.36 + P.H, abs=0.01)


HEAD = "PrecursorMz\tProductMz\tTr_recalibrated\ttransition_name\ttransition_group_id\tdecoy\tLibraryIntensity\tPeptideSequence\tProteinName\tAnnotation\tFullUniModPeptideName\tPrecursorCharge"
ROWS = ["500.1\t300.1\t10\tn\tg\t0\t50\tACD\t1/P1\ty3\tAC(UniMod:4)D\t2", "500.1\t301.1\t10\tn\tg\t0\t80\tACD\t1/P1\tb2^2/0.1\tAC(UniMod:4)D\t2", "500.1\t999.9\t10\tn\tg\t0\t99\tACD\t1/P1\ty3/0.3\tAC(UniMod:4)D\t2", "600.1\t1\t1\tn\tg\t1\t5\tDDD\t1/P1\ty1\tDDD\t1", "700.5\t400\t12\tn\tg\t0\t7\tEEK\t2/P1/P2\ty2\tEEK\t3"]


@pytest.mark.parametrize("sep,name", [("\t", "lib.tsv"), (",", "lib.csv")])
def test_library(spark, tmp_path, sep, name):
    (tmp_path / name).write_text("\n".join([HEAD, *ROWS]).replace("\t", sep) + "\n")
    rows = {r.peptide_ref: r for r in L.read_library(spark, str(tmp_path / name)).collect()}
    assert set(rows) == {"AC(UniMod:4)D_2", "EEK_3"}
    r = rows["AC(UniMod:4)D_2"]
    assert [(f.cut_info, f.intensity, f.charge) for f in r.fragments] == [("b2^2", 80.0, 2), ("y3", 50.0, 1)]
    assert r.sequence == "ACD" and r.unimod_map == {1: "4"} and r.is_unique and not rows["EEK_3"].is_unique
    assert rows["EEK_3"].proteins == ["P1", "P2"]
    only = L.read_library(spark, str(tmp_path / name), spark.createDataFrame([("EEK",)], "sequence string"))
    assert [x.peptide_ref for x in only.collect()] == ["EEK_3"]


def test_library_with_fragment_columns(spark, tmp_path):
    head = "PrecursorMz\tProductMz\tTr_recalibrated\ttransition_group_id\tLibraryIntensity\tProteinName\tPrecursorCharge\tFragmentType\tFragmentCharge\tFragmentSeriesNumber\tFragmentLossType"
    (tmp_path / "f.tsv").write_text(head + "\n500\t300\t1\t1_x_PEK\t5\tP\t2\ty\t1\t2\tH2O\n")
    r = L.read_library(spark, str(tmp_path / "f.tsv")).first()
    assert r.peptide_ref == "PEK_2" and r.fragments[0].cut_info == "y2-18"


def test_traml(spark, tmp_path):
    (tmp_path / "l.TraML").write_text("""<?xml version="1.0"?><TraML><CompoundList>
<Peptide id="p1" sequence="PEK"><ProteinRef ref="A"/><cvParam name="charge state" value="2"/><userParam name="full_peptide_name" value="PEK"/><RetentionTimeList><RetentionTime><cvParam name="normalized retention time" value="7.5"/></RetentionTime></RetentionTimeList></Peptide>
<Peptide id="p2" sequence="DDR"><ProteinRef ref="A"/><ProteinRef ref="B"/><cvParam name="charge state" value="3"/><userParam name="full_peptide_name" value="DDR"/><RetentionTimeList><RetentionTime><cvParam name="normalized retention time" value="9"/></RetentionTime></RetentionTimeList></Peptide>
</CompoundList><TransitionList>""" + "".join(f"""<Transition id="t{i}" peptideRef="{p}"><Precursor><cvParam name="isolation window target m/z" value="500.5"/></Precursor><Product><cvParam name="isolation window target m/z" value="{300 + i}"/></Product><cvParam name="product ion intensity" value="{i}"/><cvParam name="{kind}"/><userParam name="annotation" value="y{i}/0.1"/></Transition>""" for i, p, kind in [(1, "p1", "target SRM transition"), (2, "p1", "target SRM transition"), (3, "p2", "target SRM transition"), (4, "p2", "decoy SRM transition")]) + "</TransitionList></TraML>")
    rows = {r.peptide_ref: r for r in L.read_traml(spark, str(tmp_path / "l.TraML")).collect()}
    assert {k: [f.cut_info for f in r.fragments] for k, r in rows.items()} == {"PEK_2": ["y2", "y1"], "DDR_3": ["y3"]}
    assert rows["DDR_3"].proteins == ["A", "B"] and rows["PEK_2"].rt == 7.5 and rows["PEK_2"].mz == 500.5


def test_msms(spark, tmp_path):
    head = "Sequence\tModified sequence\tCharge\tPEP\tMatches\tMasses\tIntensities\tm/z\tMass\tRetention time\tProteins"
    rows = ["PEK\t_PEK_\t2\t0.1\ty1;b2;y2-H2O\t1;2;3\t10;20;30\t400\t800\t5\tA", "PEK\t_PEK_\t2\t0.5\ty1;b2\t1;2\t11;21\t400\t800\t6\tA", "DDM\t_DDM(ox)_\t3\t0.2\tb1;b1(2+)\t9;8\t1;2\t300\t900\t7\tB"]
    (tmp_path / "msms.txt").write_text("\n".join([head, *rows]) + "\n")
    got = {r.peptide_ref: r for r in L.read_msms(spark, str(tmp_path / "msms.txt")).collect()}
    assert got["PEK_2"].rt == 6 and [f.cut_info for f in got["PEK_2"].fragments] == ["b2", "y1"]
    assert got["DDM(UniMod:35)_3"].unimod_map == {2: "35"} and len(got["DDM(UniMod:35)_3"].fragments) == 2


def test_fasta_and_chemistry(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(">sp|P1|A_HUMAN Protein one OS=Homo sapiens OX=9606 GN=ONE PE=1\nMKAA\nRGG\n>CON__x trash\nAAA\n>q2 other\nKPEP\n")
    rows = {r.identifier: r for r in L.protein_links(L.read_fasta(spark, str(tmp_path / "p.fasta"))).collect()}
    assert set(rows) == {"sp|P1|A_HUMAN", "q2"} and rows["sp|P1|A_HUMAN"].sequence == "MKAARGG"
    assert (rows["sp|P1|A_HUMAN"].organism, rows["sp|P1|A_HUMAN"].gene, rows["sp|P1|A_HUMAN"].names) == ("Homo sapiens", "ONE", ["Protein one"])
    assert rows["sp|P1|A_HUMAN"].uniprot_link.endswith("/P1") and rows["q2"].uniprot_link is None
    (tmp_path / "u.obo").write_text('format\n\n[Term]\nid: UNIMOD:4\nname: Carbamidomethyl\nxref: delta_mono_mass "57.021464"\nxref: delta_avge_mass "57.0513"\n\n[Term]\nid: UNIMOD:35\nname: Oxidation\nxref: delta_mono_mass "15.994915"\n')
    assert {r.id: r.mono_mass for r in L.read_unimod(spark, str(tmp_path / "u.obo")).collect()} == {"4": 57.021464, "35": 15.994915}
    (tmp_path / "aa.json").write_text('[{"name":"Alanine","oneLetterCode":"A","monoIsotopicMass":71.037114,"averageMass":71.0779}]')
    assert L.read_amino_acids(spark, str(tmp_path / "aa.json")).first().mono_mass == 71.037114
    known = spark.createDataFrame([("p.fasta",)], "name string")
    assert {r.name for r in L.unseen_files(spark, str(tmp_path), known).collect()} == {"u.obo", "aa.json"}
    assert one(spark, L.format_pairs(L.parse_pairs(F.lit("a:1;b:2.5;")))) == "a:1.0;b:2.5"


def test_fragments_and_theory_masses(spark):
    table = {"4": 57.021464, "35": 15.994915}
    mods = F.create_map(F.lit(1), F.lit("4"), F.lit(5), F.lit("35"))
    full = one(spark, P.theory_mass(F.lit("ACDEFM")))
    assert full == pytest.approx(sum(P.RESIDUES[c] for c in "ACDEFM") + 18.010565, abs=1e-4)
    assert one(spark, P.theory_mass(F.lit("ACDEFM"), mods, table)) == pytest.approx(full + sum(table.values()))
    assert one(spark, P.theory_mass(F.lit("ACDEFM"), F.create_map(F.lit(0), F.lit("999")), table)) == pytest.approx(full)
    look = lambda note: one(spark, P.fragment(F.lit("ACDEFM"), P.annotation(F.lit(note)), mods, table))
    b, y = look("b3"), look("y2^2")
    assert (b.sequence, b.start, b.end, b.mods) == ("ACD", 0, 2, {1: "4"}) and (y.sequence, y.start, y.end, y.mods) == ("FM", 4, 5, {5: "35"})
    assert b.mono_mz == pytest.approx(plain_mz("ACD", {}, "b3") + table["4"]) and y.mono_mz == pytest.approx((P.RESIDUES["F"] + P.RESIDUES["M"] + table["35"] + P.ENDS["y"] + 2 * P.H) / 2)
    assert abs(b.average_mz - b.mono_mz) < 0.5 and b.average_mz > b.mono_mz
    assert look("y7") is None and look("q2") is None and look("b6").sequence == "ACDEFM"


def test_elements(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"symbol":"H","name":"Hydrogen","atomicNumber":1,"monoWeight":0,"isotopes":["0.0115:2.01410178","99.9885:1.0078250319"]},{"symbol":"O","name":"Oxygen","atomicNumber":8,"isotopes":["99.757:15.9949146","0.038:16.9991312","0.205:17.9991603"]},{"symbol":"Xx","name":"None"}]')
    e = L.read_elements(spark, str(tmp_path / "e.json"))
    rows = {r.symbol: r for r in e.collect()}
    assert rows["H"].mono_mass == 1.0078250319 and rows["H"].average_mass == pytest.approx(1.00794, abs=1e-5) and [i.mass for i in rows["H"].isotopes] == [1.0078250319, 2.01410178]
    assert rows["O"].average_mass == pytest.approx(15.9994, abs=1e-4) and rows["Xx"].mono_mass is None
    assert one(spark, L.formula_mass(P.formula(F.lit("H:2,O:1")), e)) == pytest.approx(18.0105647) and one(spark, L.formula_mass(P.formula(F.lit("C:1")), e)) is None
    assert one(spark, L.formula_mass(P.formula(F.lit("H:2,O:1")), e, average=True)) == pytest.approx(18.0153, abs=1e-3)


def test_learned_intensities(spark):
    """Shares of a measured library, by an average over its own rows, told to a library of proteins."""
    proteins = spark.createDataFrame([("P1", "AAPAAAKCCCDCCRGGEGGGGK")], "identifier string, sequence string")
    lib = library.of_proteins(proteins, charges=(2, 3), most=6)
    level = lambda f: {"y": 100.0, "b": 40.0}[f[0]] + int(f[1:])
    rows = [(r.peptide_ref, r.sequence, r.charge, [(f.cut_info, f.mz, level(f.cut_info), 1) for f in r.fragments]) for r in lib.collect()]
    measured = spark.createDataFrame(rows, "peptide_ref string, sequence string, charge int, fragments array<struct<cut_info:string,mz:double,intensity:double,charge:int>>")
    learned = library.learned_intensities(measured, least=2).cache()
    got = {r["type"]: (r.share, r.n) for r in learned.where(f"level = {len(library.LEVELS) - 1}").collect()}
    top = {ref: max(f[2] for f in frags) for ref, _, _, frags in rows}
    for kind in "by":
        own = [f[2] / top[ref] for ref, _, _, frags in rows for f in frags if f[0][0] == kind]
        assert got[kind] == (pytest.approx(sum(own) / len(own)), len(own))
    assert learned.where("level = 0 AND n < 2").count() == 0 and learned.where("level = 1").count() > 0
    told = {r.peptide_ref: r for r in library.with_intensities(lib, learned).collect()}
    assert set(told) == {r[0] for r in rows} and library.with_intensities(lib, learned).columns == lib.columns
    for r in told.values():
        y = [f.intensity for f in r.fragments]
        assert y[0] == 10_000.0 and y == sorted(y, reverse=True) and len(set(y)) > 1 and r.fragments[0].cut_info[0] == "y"
    blank = library.with_intensities(lib, learned.where("false")).first()
    assert {f.intensity for f in blank.fragments} == {10_000.0}
    hand = spark.createDataFrame([("r", "p", 3.0, 5.0), ("r", "p", 3.0, 4.0), ("r", "p", 2.0, 1.0)], "run_id string, peptide_ref string, left_rt double, right_rt double")
    found = spark.createDataFrame([("r", "p", 1.0, 2.0, 1.4, 1.5)], "run_id string, peptide_ref string, left_rt double, right_rt double, apex_rt double, selected_rt double")
    assert [(r.left_rt, r.apex_rt) for r in library.override(found, hand).collect()] == [(3.0, 3.5)]


def test_tables(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), ["k"])
    t.insert(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k long, s string, v double"))
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(3, "x", 0.0)], "k long, s string, v double"))
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(7, "x", 0.0), (7, "y", 0.0)], "k long, s string, v double"))
    t.update(F.col("k") == 2, {"s": F.lit("z")})
    t.upsert(spark.createDataFrame([(3, "new", 9.0), (4, "d", 4.0)], "k long, s string, v double"))
    t.patch(spark.createDataFrame([(1, None, 11.0), (99, "q", 0.0)], "k long, s string, v double"))
    t.delete(F.col("k") == 4)
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", 11.0), (2, "z", 2.0), (3, "new", 9.0)]
    child = Table(spark, str(tmp_path / "c"), ["id"])
    child.insert(spark.createDataFrame([(1, 1), (2, 3)], "id long, k long"))
    cascade([(child, ["k"]), (t, ["k"])], spark.createDataFrame([(3,)], "k long"))
    assert t.count() == 2 and [r.id for r in child.read().collect()] == [1]
