"""Readers of spectral libraries, proteins, search results, spectra and chemistry tables into typed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionflow.functions import peptides as P


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)


def peptide_table(transitions: DataFrame) -> DataFrame:
    """Peptides of transitions (full_name, charge, mz, rt, protein, annotation, product_mz, intensity, order).

    Of fragments with the same cut the first in file order stays; fragments go by falling intensity.
    """
    t = transitions.withColumn("a", P.annotation(F.col("annotation"))).withColumn("peptide_ref", F.concat_ws("_", "full_name", F.col("charge").cast("string")))
    cut = F.concat(F.col("a.type"), F.col("a.location"), F.when(F.col("a.adjust") != 0, F.col("a.adjust").cast("string")).otherwise(""), F.when(F.col("a.charge") > 1, F.concat(F.lit("^"), F.col("a.charge"))).otherwise(""), F.when(F.col("a.isotope"), "i").otherwise(""))
    t = t.withColumn("cut_info", cut)
    firsts = t.groupBy("peptide_ref", "cut_info").agg(F.min(F.struct("order", "product_mz", "intensity", "a", "annotation", "full_name", "charge", "mz", "rt", "protein")).alias("f"))
    fragment = F.struct((-F.col("f.intensity")).alias("o"), F.col("f.order").alias("k"), F.struct("cut_info", F.col("f.product_mz").alias("mz"), F.col("f.intensity").alias("intensity"), F.col("f.a.charge").alias("charge"), F.col("f.annotation").alias("annotations")).alias("v"))
    g = firsts.groupBy("peptide_ref").agg(F.min(F.struct("f.order", "f.full_name", "f.charge", "f.mz", "f.rt", "f.protein")).alias("p"), F.transform(F.array_sort(F.collect_list(fragment)), lambda x: x["v"]).alias("fragments"))
    sequence = P.strip_modifications(F.col("p.full_name"))
    rows = g.select(
        "peptide_ref", F.col("p.full_name").alias("full_name"), sequence.alias("sequence"), F.col("p.charge").alias("charge"), F.col("p.mz").alias("mz"), F.col("p.rt").alias("rt"),
        P.proteins(F.col("p.protein")).alias("proteins"), P.modifications(F.col("p.full_name")).alias("unimod_map"), "fragments", P.fingerprint(sequence).alias("fingerprints"),
    )
    return rows.withColumn("is_unique", F.size("proteins") == 1).withColumn("disable", F.lit(False))


def read_library(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """CSV or TSV library (by the file's ending; TSV has no quotes). Decoy rows are left out; ``only``: a column ``sequence`` to keep."""
    tsv = path.rstrip("/").lower().endswith("tsv")
    reader = spark.read.option("header", True).option("sep", "\t" if tsv else ",").option("quote", "" if tsv else '"')
    raw = reader.csv(path)
    raw = raw.toDF(*[P.header(c) for c in raw.columns])
    rows = raw.withColumn("order", F.monotonically_increasing_id()).where(F.coalesce(_column(raw, "decoy", "int"), F.lit(0)) != 1)
    loss = _column(raw, "fragmentlosstype")
    shift = F.coalesce(*[F.when(F.lower(loss) == k.lower(), f"{v}" if v else "") for k, v in P.LOSSES.items()], F.lit(""))
    built = F.concat(_column(raw, "fragmenttype"), _column(raw, "fragmentseriesnumber"), shift, F.lit("^"), _column(raw, "fragmentcharge"))
    group = F.split(_column(raw, "transition_group_id"), "_")
    t = rows.select(
        F.coalesce(_column(raw, "fullunimodpeptidename"), F.get(group, F.lit(2))).alias("full_name"), _column(raw, "precursorcharge", "int").alias("charge"), _column(raw, "precursormz", "double").alias("mz"), _column(raw, "tr_recalibrated", "double").alias("rt"),
        _column(raw, "proteinname").alias("protein"), F.regexp_replace(F.coalesce(_column(raw, "annotation"), built), '"', "").alias("annotation"), _column(raw, "productmz", "double").alias("product_mz"), _column(raw, "libraryintensity", "double").alias("intensity"), "order",
    ).where("full_name IS NOT NULL AND charge IS NOT NULL")
    if only is not None:
        t = t.withColumn("sequence", P.strip_modifications(F.col("full_name"))).join(only.select("sequence").distinct(), "sequence", "left_semi").drop("sequence")
    return peptide_table(t)


_CV = "array<struct<_name:string,_value:string>>"


def _cv(params: Column, name: str) -> Column:
    return F.element_at(F.filter(params, lambda x: x["_name"] == name), 1)["_value"]


def read_traml(spark: SparkSession, path: str) -> DataFrame:
    """TraML: transitions joined to their peptides by reference; decoy transitions are left out."""
    peptide = f"_id string, _sequence string, ProteinRef array<struct<_ref:string>>, RetentionTimeList struct<RetentionTime:array<struct<cvParam:{_CV}>>>, cvParam {_CV}, userParam {_CV}"
    transition = f"_id string, _peptideRef string, Precursor struct<cvParam:{_CV}>, Product struct<cvParam:{_CV}>, cvParam {_CV}, userParam {_CV}"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    p, t = read("Peptide", peptide), read("Transition", transition).withColumn("order", F.monotonically_increasing_id())
    decoy = F.exists(F.coalesce(F.col("cvParam"), F.array().cast(_CV)), lambda x: x["_name"] == "decoy SRM transition")
    p = p.select(
        F.col("_id").alias("_peptideRef"), F.coalesce(_cv(F.col("userParam"), "full_peptide_name"), F.col("_sequence")).alias("full_name"), _cv(F.col("cvParam"), "charge state").try_cast("int").alias("charge"),
        F.get(F.col("RetentionTimeList.RetentionTime"), F.lit(0)).alias("r"), F.concat(F.size("ProteinRef").cast("string"), F.lit("/"), F.array_join(F.transform("ProteinRef", lambda x: x["_ref"]), "/")).alias("protein"),
    )
    t = t.where(~F.coalesce(decoy, F.lit(False))).select("_peptideRef", "order", _cv(F.col("Precursor.cvParam"), "isolation window target m/z").try_cast("double").alias("mz"), _cv(F.col("Product.cvParam"), "isolation window target m/z").try_cast("double").alias("product_mz"), _cv(F.col("cvParam"), "product ion intensity").try_cast("double").alias("intensity"), _cv(F.col("userParam"), "annotation").alias("annotation"))
    joined = t.join(p, "_peptideRef").withColumn("rt", F.get(F.col("r.cvParam"), F.lit(0))["_value"].try_cast("double"))
    return peptide_table(joined.select("full_name", "charge", "mz", "rt", "protein", "annotation", "product_mz", "intensity", "order"))


def read_msms(spark: SparkSession, path: str, largest: bool = True) -> DataFrame:
    """MaxQuant msms.txt: per peptide and charge the row with the largest (or least) pep; b and y ions without losses."""
    raw = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    raw = raw.toDF(*[P.header(c) for c in raw.columns]).withColumn("order", F.monotonically_increasing_id())
    modified = F.regexp_replace(F.regexp_replace(F.regexp_replace("modifiedsequence", "_", ""), r"\((?i:ox|oxidation( \(M\))?)\)", "(UniMod:35)"), r"\((?i:ac|acetyl( \(.*?\))?)\)", "(UniMod:1)")
    rows = raw.withColumn("ref", F.concat_ws("_", modified, "charge")).withColumn("pep", F.col("pep").try_cast("double"))
    # A minimum over a struct aggregates before rows move; missing values come last either way.
    first = F.struct(F.col("pep").isNull().alias("missing"), (-F.col("pep") if largest else F.col("pep")).alias("o"), "order", F.struct(*[f"`{c}`" for c in rows.columns]).alias("row"))
    best = rows.groupBy("ref").agg(F.min(first).alias("m")).select("m.row.*")
    ions = F.arrays_zip(F.split("matches", ";").alias("ion"), F.split("masses", ";").alias("mass"), F.split("intensities", ";").alias("intensity"))
    f = best.select("*", modified.alias("full_name"), F.posexplode(ions).alias("at", "i")).where(F.col("i.ion").rlike("^[by]") & ~F.col("i.ion").contains("-"))
    return peptide_table(f.select(
        "full_name", F.col("charge").cast("int").alias("charge"), F.col("`m/z`").cast("double").alias("mz"), F.col("retentiontime").cast("double").alias("rt"), F.col("proteins").alias("protein"),
        F.col("i.ion").alias("annotation"), F.col("i.mass").cast("double").alias("product_mz"), F.col("i.intensity").cast("double").alias("intensity"), (F.col("order") * 10000 + F.col("at")).alias("order"),
    ))


def read_fasta(spark: SparkSession, path: str, contaminants: bool = False) -> DataFrame:
    """Proteins of a FASTA file: identifier, names, organism, gene, sequence; contaminants (CON) are left out."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    head = F.element_at(lines, 1)
    rows = raw.select(head.alias("head"), F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "").alias("sequence"))
    if not contaminants:
        rows = rows.where(~F.col("head").startswith("CON"))
    return rows.select(
        F.substring_index("head", " ", 1).alias("identifier"), F.array(F.trim(F.regexp_replace(F.substring_index("head", "OS=", 1), r"^\S+", ""))).alias("names"),
        F.trim(P.between(F.col("head"), "OS=", "OX=")).alias("organism"), F.trim(P.between(F.col("head"), "GN=", "PE=")).alias("gene"), "sequence",
    )


def protein_links(df: DataFrame) -> DataFrame:
    """Links of three-part identifiers such as sp|P1|NAME."""
    parts = F.split("identifier", r"\|")
    known = F.size(parts) == 3
    return df.withColumn("uniprot_link", F.when(known, F.concat(F.lit("https://www.uniprot.org/uniprot/"), F.element_at(parts, 2)))).withColumn("alphafold_link", F.when(known, F.concat(F.lit("https://alphafold.ebi.ac.uk/entry/"), F.element_at(parts, 2))))


def read_unimod(spark: SparkSession, path: str) -> DataFrame:
    """id, name and masses of an OBO file's terms."""
    raw = spark.read.option("lineSep", "[Term]").text(path)
    pick = lambda p: F.regexp_extract("value", p, 1)
    rows = raw.select(pick(r"(?m)^id: UNIMOD:(\d+)").alias("id"), pick(r"(?m)^name: (.*)$").alias("name"), pick(r'delta_mono_mass "([-\d.]+)"').try_cast("double").alias("mono_mass"), pick(r'delta_avge_mass "([-\d.]+)"').try_cast("double").alias("average_mass"))
    return rows.where("id <> ''")


def read_amino_acids(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.col("oneLetterCode").alias("code"), "name", F.col("monoIsotopicMass").cast("double").alias("mono_mass"), F.col("averageMass").cast("double").alias("average_mass"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a JSON file: symbol, name, number, isotopes (mass and natural share, by falling share), mono_mass (of the most frequent isotope) and average_mass.

    Isotopes are ``percent:mass``; the masses come from them, whatever the file says, and are null
    for an element without any.
    """
    raw = spark.read.schema("symbol string, name string, atomicNumber int, isotopes array<string>").option("multiLine", True).json(path)
    part = lambda x, i: F.get(F.split(x, ":"), F.lit(i)).try_cast("double")
    isotopes = F.transform(F.coalesce("isotopes", F.array().cast("array<string>")), lambda x: F.struct((-part(x, 0)).alias("o"), part(x, 1).alias("mass"), (part(x, 0) / 100).alias("share")))
    sorted_ = F.array_sort(F.filter(isotopes, lambda x: x["mass"].isNotNull() & x["share"].isNotNull()))
    rows = raw.select("symbol", "name", F.col("atomicNumber").alias("number"), F.transform(sorted_, lambda x: F.struct(x["mass"].alias("mass"), x["share"].alias("share"))).alias("isotopes"))
    total = lambda f: F.aggregate("isotopes", F.lit(0.0), lambda acc, x: acc + f(x))
    shares = total(lambda x: x["share"])
    return rows.withColumns({"mono_mass": F.get("isotopes", F.lit(0))["mass"], "average_mass": F.when(shares > 0, total(lambda x: x["share"] * x["mass"]) / shares)})


def formula_mass(formula: Column, elements: DataFrame, average: bool = False) -> Column:
    """Mass of a formula (``peptides.formula``: element -> count) by the elements of ``read_elements``; null if one of them is not listed."""
    rows = elements.select("symbol", F.col("average_mass" if average else "mono_mass").alias("m")).where("m IS NOT NULL").limit(1000).collect()  # a periodic table
    table = F.create_map(*[F.lit(x) for r in rows for x in (r["symbol"], r["m"])])
    return F.aggregate(F.map_entries(formula), F.lit(0.0), lambda acc, e: acc + e["value"] * F.element_at(table, e["key"]))


def unseen_files(spark: SparkSession, folder: str, known: DataFrame, pattern: str = "*") -> DataFrame:
    """Files under a folder whose name is not in ``known`` (name)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(known.select("name"), "name", "left_anti")


def parse_pairs(c: Column) -> Column:
    """``k:v;k:v`` to a map of doubles."""
    return F.transform_values(F.map_filter(F.str_to_map(c, F.lit(";"), F.lit(":")), lambda k, v: k != ""), lambda k, v: v.try_cast("double"))


def format_pairs(c: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")
