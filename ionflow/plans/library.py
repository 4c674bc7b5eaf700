"""Libraries as tables: decoys, clones, libraries of proteins, lookups, overrides and removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionflow.functions import peptides as P


def with_decoys(library: DataFrame, method: str = "shuffle", masses: dict[str, float] | None = None) -> DataFrame:
    """The library with decoys of all its peptides, in place of those it had."""
    return P.decoys(without_decoys(library), "peptide_ref", "sequence", method, "unimod_map", "fragments", masses)


def without_decoys(library: DataFrame) -> DataFrame:
    return library.drop("decoy_sequence", "decoy_unimod_map", "decoy_fragments")


def clone(library: DataFrame, library_id: str, decoys: bool = True) -> DataFrame:
    """A copy under another id, with or without decoys."""
    return (library if decoys else without_decoys(library)).withColumn("library_id", F.lit(library_id))


def of_proteins(proteins: DataFrame, identifier: str = "identifier", sequence: str = "sequence", shortest: int = 6, longest: int = 30, charges: tuple[int, ...] = (1, 2, 3), most: int = 6) -> DataFrame:
    """A library of the tryptic peptides of proteins at some charges: peptide_ref, sequence, charge, mz, proteins, is_unique, unimod_map, fragments.

    Fragments are the longest ``most`` y and b ions of charge one; their intensities are equal until
    they are learned from a measured library (``learned_intensities``, ``with_intensities``).
    """
    found = proteins.select(F.col(identifier).alias("protein"), F.explode(P.digest(F.upper(F.col(sequence)), shortest, longest)).alias("sequence"))
    merged = found.groupBy("sequence").agg(F.array_sort(F.collect_set("protein")).alias("proteins"))
    rows = merged.withColumn("charge", F.explode(F.lit(list(charges)))).withColumn("masses", P.residue_masses(F.col("sequence")))
    longest_first = F.slice(F.sequence(F.length("sequence") - 1, F.lit(1)), 1, most // 2)
    names = F.flatten(F.transform(longest_first, lambda n: F.array(F.concat(F.lit("y"), n), F.concat(F.lit("b"), n))))
    fragments = F.transform(names, lambda c: F.struct(c.alias("cut_info"), P.fragment_mz(F.col("masses"), P.annotation(c)).alias("mz"), F.lit(1.0).alias("intensity"), F.lit(1).alias("charge")))
    total = F.aggregate("masses", F.lit(0.0), lambda acc, m: acc + m)
    return rows.select(
        F.concat("sequence", F.lit("_"), "charge").alias("peptide_ref"), "sequence", "charge", ((total + P.ENDS["full"] + F.col("charge") * P.H) / F.col("charge")).alias("mz"),
        "proteins", (F.size("proteins") == 1).alias("is_unique"), F.create_map().cast("map<int,string>").alias("unimod_map"), fragments.alias("fragments"), P.fingerprint(F.col("sequence")).alias("fingerprints"),
    )


def _places(library: DataFrame) -> DataFrame:
    """Fragments as rows with what their intensity is told by: type, place among the cuts in tenths, charge, the residues at both sides of the cut in groups."""
    rows = library.select("peptide_ref", "sequence", F.col("charge").alias("precursor"), F.posexplode("fragments").alias("at", "f"))
    rows = rows.withColumn("a", P.annotation(F.col("f.cut_info")))
    n, k = F.length("sequence"), F.col("a.location")
    cut = F.when(F.col("a.type").isin("a", "b", "c"), k).otherwise(n - k)  # residues before the cut
    group = lambda c: F.when(c == "P", "P").when(c.isin("K", "R", "H"), "basic").when(c.isin("D", "E"), "acid").otherwise("other")
    return rows.select("peptide_ref", "at", "f", F.col("a.type").alias("type"), F.floor(cut * 10 / n).cast("int").alias("tenth"), F.col("a.charge").alias("charge"), "precursor", group(F.substring("sequence", cut, F.lit(1))).alias("before"), group(F.substring("sequence", cut + 1, F.lit(1))).alias("after"))


#: What tells an intensity, from the finest to the coarsest level.
LEVELS = (("type", "charge", "precursor", "tenth", "before", "after"), ("type", "charge", "precursor", "tenth"), ("type", "charge", "tenth"), ("type",))


def learned_intensities(measured: DataFrame, least: int = 5) -> DataFrame:
    """(level, type, charge, precursor, tenth, before, after, share, n): mean share of the strongest fragment's intensity, for fragments alike.

    One table for all levels of ``LEVELS``; columns that a level does not tell are null. Groups of
    under ``least`` fragments are left to the coarser level.
    """
    rows = _places(measured).withColumn("y", F.col("f.intensity").cast("double")).where("y > 0")
    top = rows.groupBy("peptide_ref").agg(F.max("y").alias("top"))
    shares = rows.join(top, "peptide_ref").withColumn("share", F.col("y") / F.col("top"))
    names = LEVELS[0]
    sets = shares.groupingSets([[F.col(c) for c in level] for level in LEVELS], *[F.col(c) for c in names]).agg(F.avg("share").alias("share"), F.count(F.lit(1)).alias("n"), F.grouping_id(*names).alias("_g"))
    marks = {sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in level): k for k, level in enumerate(LEVELS)}
    level = F.element_at(F.create_map(*[F.lit(x) for kv in marks.items() for x in kv]), F.col("_g").cast("int"))
    return sets.select(level.alias("level"), *names, "share", "n").where(F.col("n") >= F.when(level == len(LEVELS) - 1, 1).otherwise(least))


def with_intensities(library: DataFrame, learned: DataFrame, strongest: float = 10_000.0, unknown: float = 0.01) -> DataFrame:
    """The library with the intensities that ``learned`` expects of its fragments, the strongest of each peptide at ``strongest``, by falling intensity.

    A fragment takes the finest level that is known; where none is, it has the share ``unknown``.
    """
    rows = _places(library)
    for k, level in enumerate(LEVELS):
        one = learned.where(F.col("level") == k).select(*level, F.col("share").alias(f"s{k}"))
        rows = rows.join(one, list(level), "left")
    rows = rows.withColumn("share", F.coalesce(*[f"s{k}" for k in range(len(LEVELS))], F.lit(unknown)))
    told = rows.groupBy("peptide_ref").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("o"), "at", "f"))).alias("fs"))
    scaled = F.transform("fs", lambda x: x["f"].withField("intensity", x["o"] / F.get("fs", F.lit(0))["o"] * strongest))
    return library.join(told.select("peptide_ref", scaled.alias("_fs")), "peptide_ref", "left").withColumn("fragments", F.coalesce("_fs", "fragments")).select(library.columns)


def peptides_of(library: DataFrame, protein: str) -> DataFrame:
    """The references of a protein's peptides."""
    return library.where(F.array_contains("proteins", protein)).select("peptide_ref")


def with_fragments(library: DataFrame, more: Column) -> DataFrame:
    """The library with further fragments; of those with one name the first stays."""
    every = F.concat("fragments", more)
    names = F.transform(every, lambda f: f["cut_info"])
    return library.withColumn("fragments", F.filter(every, lambda f, i: F.array_position(names, f["cut_info"]) == i + 1))


def override(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Peak groups with hand-set ones in their place: ``ranges`` has run_id, peptide_ref, left_rt, right_rt; the apex is the middle.

    Of several ranges for one peptide of a run the one that begins first counts, of these the
    shortest; ranges without an end, or that end before they begin, are refused by being left out.
    """
    keys = ["run_id", "peptide_ref"]
    first = ranges.where("left_rt <= right_rt").groupBy(*keys).agg(F.min(F.struct("left_rt", "right_rt")).alias("r"))
    ranges = first.select(*keys, "r.left_rt", "r.right_rt")
    middle = (F.col("left_rt") + F.col("right_rt")) / 2
    new = ranges.select(*keys, "left_rt", "right_rt", middle.alias("apex_rt"), middle.alias("selected_rt"), F.lit(True).alias("by_hand"))
    return found.join(ranges.select(*keys), keys, "left_anti").withColumn("by_hand", F.lit(False)).unionByName(new, allowMissingColumns=True)


def removed(table: DataFrame, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table without the rows asked for, and a report: each key asked for once, with how many rows went (0: not there)."""
    wanted = asked.select(key).distinct()
    gone = table.join(wanted, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return table.join(wanted, key, "left_anti"), wanted.join(gone, key, "left").select(key, F.coalesce("rows", F.lit(0)).alias("rows"))
