"""Peptide text: modifications, protein labels, cut positions, annotations, masses, digests, decoys."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Monoisotopic residue masses and element masses in dalton.
RESIDUES = {
    "A": 71.037114, "R": 156.101111, "N": 114.042927, "D": 115.026943, "C": 103.009185, "E": 129.042593, "Q": 128.058578, "G": 57.021464, "H": 137.058912, "I": 113.084064,
    "L": 113.084064, "K": 128.094963, "M": 131.040485, "F": 147.068414, "P": 97.052764, "S": 87.032028, "T": 101.047679, "U": 150.95363, "W": 186.079313, "Y": 163.06332, "V": 99.068414,
}
# Average residue masses.
AVERAGE_RESIDUES = {
    "A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "E": 129.1155, "Q": 128.1307, "G": 57.0519, "H": 137.1411, "I": 113.1594,
    "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "U": 150.0388, "W": 186.2132, "Y": 163.176, "V": 99.1326,
}
ELEMENTS = {"H": 1.007825032, "C": 12.0, "N": 14.003074005, "O": 15.994914622}
H, C, N, O = (ELEMENTS[e] for e in "HCNO")  # noqa: E741
#: What an ion type adds to its residues, as the engine's definitions have it.
ENDS = {"full": 2 * H + O, "a": H - (C + H + O), "b": 0.0, "c": H - (N + 2 * H), "x": O + H + C + O - H, "y": O + 2 * H, "z": O + H + N + 2 * H}
AVERAGE_ELEMENTS = {"H": 1.00794, "C": 12.0107, "N": 14.0067, "O": 15.9994}


def ends_of(e: dict[str, float]) -> dict[str, float]:
    """``ENDS`` for other element masses."""
    return {"full": 2 * e["H"] + e["O"], "a": e["H"] - (e["C"] + e["H"] + e["O"]), "b": 0.0, "c": e["H"] - (e["N"] + 2 * e["H"]), "x": e["O"] + e["H"] + e["C"] + e["O"] - e["H"], "y": e["O"] + 2 * e["H"], "z": e["O"] + e["H"] + e["N"] + 2 * e["H"]}


# Residues and what replaces them at both ends of a decoy.
SWAP_FROM, SWAP_TO = "GAVLIFMPWSCTYHKRQEND", "LLLVVLLLLTSSSSLLNDQE"
#: Losses of annotated fragments in whole daltons.
LOSSES = {"noloss": 0, "NH3": -17, "H2O": -18, "CO": -28}


def strip_modifications(s: Column) -> Column:
    return F.regexp_replace(s, r"\([^)]*\)", "")


def modifications(s: Column) -> Column:
    """Map of position (from 0, in the stripped sequence) to UniMod id; empty if the sequence begins with one.

    The text before each modification, stripped, tells its position.
    """
    low = F.lower(s)
    parts = F.split(low, r"\(unimod:")
    upto = lambda i: F.length(strip_modifications(F.array_join(F.slice(parts, 1, i + 1), "(unimod:")))
    entries = F.transform(F.slice(parts, 2, F.size(parts)), lambda p, i: F.struct((upto(i) - 1).cast("int").alias("key"), F.substring_index(p, ")", 1).alias("value")))
    begins = F.length(F.element_at(parts, 1)) == 0
    return F.map_from_entries(F.when(begins | (F.size(parts) < 2), F.array().cast("array<struct<key:int,value:string>>")).otherwise(entries))


def proteins(label: Column) -> Column:
    """``n/a/b``: a and b; a label that mentions irt: iRT; anything else: itself."""
    parts = F.split(label, "/")
    return F.when(F.lower(label).contains("irt"), F.array(F.lit("iRT"))).when(F.size(parts) > 1, F.array_distinct(F.slice(parts, 2, F.size(parts)))).otherwise(F.array(label))


def cut_charge(cut: Column) -> Column:
    """Charge of a cut such as y3^2; 1 if it has none."""
    found = F.regexp_extract(F.regexp_replace(cut, r"[\[\]i]", ""), r"\^(\d+)", 1)
    return F.when(found == "", 1).otherwise(found.cast("int"))


def annotation(s: Column) -> Column:
    """type, location, adjust, charge, isotope and deviation of the first item of an annotation such as y7-18^2i/0.02."""
    first = F.regexp_replace(F.substring_index(s, ",", 1), r"[\[\]]", "")
    ion, number = F.substring_index(first, "/", 1), lambda x, d: F.when(x == "", d).otherwise(x)
    charge = F.greatest(F.regexp_extract(ion, r"\^(\d+)", 1), F.regexp_extract(ion, r"\((\d+)\+?\)", 1))
    return F.struct(
        F.regexp_extract(ion, r"^([abcxyz])", 1).alias("type"),
        number(F.regexp_extract(ion, r"^[abcxyz](\d+)", 1), F.lit("0")).cast("int").alias("location"),
        number(F.regexp_extract(ion, r"^[abcxyz]\d+([+-]\d+)", 1), F.lit("0")).cast("int").alias("adjust"),
        number(charge, F.lit("1")).cast("int").alias("charge"),
        ion.endswith("i").alias("isotope"),
        number(F.regexp_extract(first, r"/(-?[\d.]+)", 1), F.lit("0")).cast("double").alias("deviation"),
    )


def header(name: str | Column) -> str | Column:
    """A column name of a library file, or a column of such names, in normal form: lower case without quotes and blanks."""
    if isinstance(name, Column):
        return F.lower(F.regexp_replace(name, r'[\s"]', ""))
    return "".join(name.lower().replace('"', "").split())


def between(s: Column, start: str, end: str) -> Column:
    return F.when(s.contains(start), F.substring_index(F.substring_index(s, start, -1), end, 1))


def identity(a: Column, b: Column) -> Column:
    """Share of equal positions; 0 for unequal lengths."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x)
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), same / F.length(a)).otherwise(0.0)


def full_name(sequence: Column, mods: Column) -> Column:
    """The sequence with ``(UniMod:id)`` after each modified residue; ``mods``: position from 0 -> id."""
    mark = lambda i: F.coalesce(F.concat(F.lit("(UniMod:"), F.element_at(mods, i), F.lit(")")), F.lit(""))
    return F.array_join(F.transform(F.split(sequence, ""), lambda c, i: F.concat(c, mark(i))), "")


def brothers(full: Column, mz_: Column, charge: Column, charges: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The same peptide at other charges: array of (peptide_ref, charge, mz), mz by mz * charge / other charge."""
    options = F.filter(F.lit(list(charges)), lambda z: z != charge)
    return F.transform(options, lambda z: F.struct(F.concat(full, F.lit("_"), z).alias("peptide_ref"), z.alias("charge"), (mz_ * charge / z).alias("mz")))


def formula(s: Column) -> Column:
    """``H:2,O:1`` to a map of element -> count."""
    return F.transform_values(F.map_filter(F.str_to_map(F.regexp_replace(s, r"\s", ""), F.lit(","), F.lit(":")), lambda k, _: k != ""), lambda _, v: v.try_cast("int"))


def residue_mass(s: Column, residues: dict[str, float] = RESIDUES) -> Column:
    """Summed residue masses of the letters; unknown ones weigh nothing."""
    table = F.create_map(*[F.lit(x) for kv in residues.items() for x in kv])
    return F.aggregate(F.split(s, ""), F.lit(0.0), lambda acc, c: acc + F.coalesce(F.element_at(table, c), F.lit(0.0)))


def mz(sequence: Column, kind: str = "full", charge: int = 1, adjust: float = 0.0, modification: Column | float = 0.0, isotope: bool = False, deviation: float = 0.0, average: bool = False) -> Column:
    """(residues + end + charge hydrogens + adjust + modifications + isotope) / charge + deviation, monoisotopic or average."""
    end, h = (ends_of(AVERAGE_ELEMENTS)[kind], AVERAGE_ELEMENTS["H"]) if average else (ENDS[kind], H)
    return (residue_mass(sequence, AVERAGE_RESIDUES if average else RESIDUES) + end + charge * h + adjust + modification + float(isotope)) / charge + deviation


def fragment_mz(masses: Column, note: Column) -> Column:
    """m/z of the fragment that an ``annotation`` names, of residues (with modifications) of these ``masses``; null if it is longer than they are."""
    n, at = F.size(masses), note["location"]
    piece = F.when(note["type"].isin("a", "b", "c"), F.slice(masses, F.lit(1), at)).otherwise(F.slice(masses, n - at + 1, at))
    end = F.element_at(F.create_map(*[F.lit(x) for k in "abcxyz" for x in (k, ENDS[k])]), note["type"])
    total = F.aggregate(piece, F.lit(0.0), lambda acc, m: acc + m)
    mz_ = (total + end + note["charge"] * H + note["adjust"] + F.when(note["isotope"], 1.0).otherwise(0.0)) / note["charge"] + note["deviation"]
    return F.when(at.between(1, n), mz_)


def residue_masses(sequence: Column, mods: Column | None = None, table: dict[str, float] | None = None) -> Column:
    """Mass of each residue with its modification; ``mods``: position from 0 -> id, ``table``: id -> mass."""
    residues = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    own = lambda c: F.coalesce(F.element_at(residues, c), F.lit(0.0))
    if mods is None or not table:
        return F.transform(F.split(sequence, ""), own)
    added = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(F.split(sequence, ""), lambda c, i: own(c) + F.coalesce(F.element_at(added, F.element_at(mods, i)), F.lit(0.0)))

def fragment_span(length: Column, note: Column) -> tuple[Column, Column]:
    """(start, end) of the residues that an ``annotation`` names in a sequence, from 0 and with the end; null if it is longer or of no known type."""
    at, kind = note["location"], note["type"]
    head, tail = kind.isin("a", "b", "c"), kind.isin("x", "y", "z")
    good = (head | tail) & at.between(1, length)
    return F.when(good, F.when(head, 0).otherwise(length - at)), F.when(good, F.when(head, at - 1).otherwise(length - 1))


def fragment(sequence: Column, note: Column, mods: Column | None = None, table: dict[str, float] | None = None) -> Column:
    """What an ``annotation`` names in a sequence: struct of its residues, start, end, the modifications in it (by place in the whole) and m/z, monoisotopic and average.

    ``mods``: position from 0 -> id, ``table``: id -> mass. Null where the annotation names nothing.
    """
    start, end = fragment_span(F.length(sequence), note)
    inside = F.map_filter(mods, lambda k, _: k.between(start, end)) if mods is not None else F.create_map().cast("map<int,string>")
    mono = fragment_mz(residue_masses(sequence, mods, table), note)
    letters = F.substring(sequence, start + 1, end - start + 1)
    ends = ends_of(AVERAGE_ELEMENTS)
    side = F.element_at(F.create_map(*[F.lit(x) for k in "abcxyz" for x in (k, ends[k])]), note["type"])
    added = F.aggregate(F.map_values(inside), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), i), F.lit(0.0))) if table else F.lit(0.0)
    average = (residue_mass(letters, AVERAGE_RESIDUES) + side + note["charge"] * AVERAGE_ELEMENTS["H"] + note["adjust"] + added + F.when(note["isotope"], 1.0).otherwise(0.0)) / note["charge"] + note["deviation"]
    return F.when(start.isNotNull(), F.struct(letters.alias("sequence"), start.alias("start"), end.alias("end"), inside.alias("mods"), mono.alias("mono_mz"), average.alias("average_mz")))


#: What the theory mass adds at both ends, and the proton that it takes off again.
B_SIDE, Y_SIDE, PROTON = 1.007276466771, 19.01784153, 1.007276466771


def theory_mass(sequence: Column, mods: Column | None = None, table: dict[str, float] | None = None) -> Column:
    """Mass of the whole neutral peptide: residues, modifications of known mass and both ends. Unknown letters and modifications weigh nothing."""
    total = F.aggregate(residue_masses(sequence), F.lit(B_SIDE + Y_SIDE - 2 * PROTON), lambda acc, m: acc + m)
    if mods is None or not table:
        return total
    added = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return total + F.coalesce(F.aggregate(F.map_values(mods), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.element_at(added, i), F.lit(0.0))), F.lit(0.0))


def ion_series(sequence: Column) -> Column:
    """b and y masses of every cut, undivided, at four digits, in one array."""
    n = F.length(sequence)
    at = F.sequence(F.lit(1), n - 1)
    b = F.transform(at, lambda i: F.round(residue_mass(F.substring(sequence, F.lit(1), i)) + ENDS["b"] + H, 4))
    y = F.transform(at, lambda i: F.round(residue_mass(F.substring(sequence, n - i + 1, i)) + ENDS["y"] + H, 4))
    return F.when(n > 1, F.concat(b, y)).otherwise(F.array().cast("array<double>"))


def fingerprint(sequence: Column) -> Column:
    return F.array_sort(F.array_distinct(ion_series(sequence).cast("array<float>")))


def fragments(df: DataFrame, sequence: str, kinds: tuple[str, ...] = ("b", "y"), charges: tuple[int, ...] = (1, 2), shortest: int = 1) -> DataFrame:
    """One row per ion type, charge and length: cut_info such as y3^2 and its m/z."""
    options = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(z).alias("charge")) for k in kinds for z in charges])
    rows = df.where(F.length(sequence) > shortest).withColumn("option", F.explode(options)).withColumn("length", F.explode(F.sequence(F.lit(shortest), F.length(sequence) - 1)))
    head = F.substring(F.col(sequence), F.lit(1), F.col("length"))
    tail = F.substring(F.col(sequence), F.length(sequence) - F.col("length") + 1, F.col("length"))
    piece = F.when(F.col("option.kind").isin("a", "b", "c"), head).otherwise(tail)
    end = F.element_at(F.create_map(*[F.lit(x) for k in kinds for x in (k, ENDS[k])]), F.col("option.kind"))
    name = F.concat(F.col("option.kind"), F.col("length"), F.when(F.col("option.charge") > 1, F.concat(F.lit("^"), F.col("option.charge"))).otherwise(""))
    return rows.select(*df.columns, name.alias("cut_info"), ((residue_mass(piece) + end + F.col("option.charge") * H) / F.col("option.charge")).alias("mz"))


def digest(s: Column, shortest: int, longest: int) -> Column:
    """Distinct peptides of a tryptic digest (after each K and R) within the lengths."""
    cut = F.split(F.regexp_replace(s, r"([KR])", "$1|"), r"\|")
    return F.array_distinct(F.filter(cut, lambda p: F.length(p).between(shortest, longest)))


def decoy_by_ends(s: Column) -> Column:
    """First and last residue replaced by the table."""
    swap = lambda c: F.translate(c, SWAP_FROM, SWAP_TO)
    return F.when(F.length(s) < 2, swap(s)).otherwise(F.concat(swap(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s) - 2), swap(F.right(s, F.lit(1)))))


def shuffled(sequence: str, seed: str, tries: int = 10) -> list[int]:
    """A shuffle that keeps a last K, P or R, as the old position of each new one; the least alike of ``tries``, the same for the same seed."""
    n = len(sequence) - (sequence[-1:].upper() in tuple("KPR"))
    rng, best, least = random.Random(seed), list(range(n)), 2.0
    for _ in range(tries):
        new = list(range(n))
        rng.shuffle(new)
        same = sum(sequence[i] == sequence[j] for i, j in enumerate(new)) / max(n, 1)
        if same < least:
            best, least = new, same
        if not same:
            break
    return [*best, *range(n, len(sequence))]


def deranged(sequence: str, seed: str) -> list[int]:
    """A rearrangement, as old positions, that places the most crowded letters first, each on positions that held another letter where any is free."""
    n = len(sequence) - (sequence[-1:].upper() in tuple("KPR"))
    rng, body = random.Random(seed), sequence[:n]
    out: list[int | None] = [None] * n
    for letter in sorted(set(body), key=lambda c: (-body.count(c), c)):
        for old in (i for i, c in enumerate(body) if c == letter):
            free = [i for i, x in enumerate(out) if x is None]
            out[rng.choice([i for i in free if body[i] != letter] or free)] = old
    return [*(x for x in out if x is not None), *range(n, len(sequence))]


def decoys(df: DataFrame, key: str, sequence: str, method: str = "shuffle", unimod: str | None = None, fragments: str | None = None, masses: dict[str, float] | None = None) -> DataFrame:
    """``df`` with ``decoy_sequence`` and, if these columns are named, ``decoy_unimod_map`` and ``decoy_fragments``.

    Methods: ends (an expression), shuffle or derange (new positions in Arrow batches, seeded by the
    key). Modifications go along with their residues. A decoy fragment has the name, charge and
    intensity of its target and the m/z that its name has in the decoy; ``masses``: those of the
    modifications by id. Fragments longer than the sequence have no decoy.
    """
    if method == "ends":
        order = F.sequence(F.lit(0), F.length(sequence) - 1)
        df = df.withColumn("decoy_sequence", decoy_by_ends(F.col(sequence)))
    else:
        make = {"shuffle": shuffled, "derange": deranged}[method]

        @F.pandas_udf("array<int>")
        def run(keys, sequences):
            import pandas as pd

            return pd.Series([None if s is None else make(s, str(k)) for k, s in zip(keys, sequences, strict=True)])

        df = df.withColumn("_order", run(F.col(key).cast("string"), F.col(sequence)))
        order = F.col("_order")
        df = df.withColumn("decoy_sequence", F.array_join(F.transform(order, lambda i: F.substring(F.col(sequence), i + 1, F.lit(1))), ""))
    moved = None
    if unimod:
        at = F.transform(order, lambda old, i: F.struct(i.alias("key"), F.element_at(F.col(unimod), old).alias("value")))
        moved = F.map_from_entries(F.filter(at, lambda x: x["value"].isNotNull()))
        df = df.withColumn("decoy_unimod_map", moved)
        moved = F.col("decoy_unimod_map")
    if fragments:
        df = df.withColumn("_masses", residue_masses(F.col("decoy_sequence"), moved, masses))
        name = "annotations" if "annotations" in df.schema[fragments].dataType.elementType.names else "cut_info"
        new = F.transform(F.col(fragments), lambda f: f.withField("mz", fragment_mz(F.col("_masses"), annotation(f[name]))))
        df = df.withColumn("decoy_fragments", F.filter(new, lambda f: f["mz"].isNotNull())).drop("_masses")
    return df.drop("_order")
