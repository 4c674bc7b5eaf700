"""Products over several runs and the views of single ones.

``data_sum``: overview_id, run_id, peptide_ref, decoy, proteins, is_unique, status, fdr, q_value,
total_score, apex_rt, selected_rt, intensity_sum, fit_int_sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionflow.operators import groups, learning
from ionflow.operators.fdr import SUCCESS

def quantity() -> Column:
    """Fitted intensity, or the summed one where there is no fit."""
    return F.coalesce("fit_int_sum", "intensity_sum")


def identified(data_sum: DataFrame, unique: bool = False) -> DataFrame:
    found = data_sum.where((F.col("status") == SUCCESS) & ~F.col("decoy"))
    return found.where("is_unique") if unique else found


def merge_group(data_sum: DataFrame, runs: list[str]) -> DataFrame:
    """Per peptide of a group of runs: first protein, mean intensity over its runs and their number; reversed proteins are left out."""
    rows = identified(data_sum, unique=True).where(F.col("run_id").isin(runs)).withColumn("protein", F.get("proteins", F.lit(0)))
    rows = rows.where(~F.coalesce(F.col("protein").startswith("reverse"), F.lit(False))).withColumn("item", F.concat_ws("-->", "protein", "peptide_ref"))
    return groups.merge_runs(rows, "run_id", "item", quantity())


def fold_changes(data_sum: DataFrame, a: list[str], b: list[str]) -> DataFrame:
    """log2 ratios of two groups by species of the protein."""
    species = groups.species_of(F.substring_index("item", "-->", 1), {"HUMAN": "HUMAN", "YEAS8": "YEAST"}, "ECOLI")
    return groups.fold_change(merge_group(data_sum, a), merge_group(data_sum, b), "item", "intensity", species)


def fold_summary(folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean, deviation and variation per species, and the percentiles 1 to 99."""
    good = folds.where(~F.isnan("y") & (F.abs("y") < float("inf")))
    stats = good.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd")).withColumn("cv", F.col("sd") / F.col("mean"))
    return stats, groups.percentiles(good, "species", "y")


def report(peptides: DataFrame, data_sum: DataFrame, runs: list[str]) -> DataFrame:
    """Every library peptide with its first protein and one quantity per run; runs without it hold 0."""
    wide = groups.report(identified(data_sum).withColumn("q", quantity()), "peptide_ref", "run_id", runs, "q")
    out = peptides.select("peptide_ref", F.get("proteins", F.lit(0)).alias("protein"), "is_unique").join(wide, "peptide_ref", "left")
    return out.select("protein", "peptide_ref", "is_unique", *[F.coalesce(F.col(f"`{r}`"), F.lit(0.0)).alias(r) for r in runs])


def rt_pairs(data_sum: DataFrame, peptides: DataFrame, runs: DataFrame) -> DataFrame:
    """x: apex time, y: its distance from the library's time in that run; targets that were identified."""
    rows = identified(data_sum).join(peptides.select("peptide_ref", F.col("rt").alias("lib_rt")), "peptide_ref").join(runs.select("run_id", "irt_slope", "irt_intercept"), "run_id")
    real = F.when(F.col("irt_slope") == 0, F.col("lib_rt")).otherwise((F.col("lib_rt") - F.col("irt_intercept")) / F.col("irt_slope"))
    return rows.select("run_id", "peptide_ref", F.col("apex_rt").alias("x"), (F.col("apex_rt") - real).alias("y"))


def statistics(data_sum: DataFrame, hit: int = 2) -> DataFrame:
    """Per overview: identified peptides, those of unique ones, proteins, and proteins with at least ``hit`` peptides."""
    found = identified(data_sum)
    peptides = found.groupBy("overview_id").agg(F.count(F.lit(1)).alias("peptides"), F.sum(F.col("is_unique").cast("long")).alias("unique_peptides"))
    per = found.select("overview_id", "peptide_ref", F.explode("proteins").alias("protein")).groupBy("overview_id", "protein").agg(F.count(F.lit(1)).alias("n"))
    proteins = per.groupBy("overview_id").agg(F.count(F.lit(1)).alias("proteins"), F.sum((F.col("n") >= hit).cast("long")).alias("hit_proteins"))
    return peptides.join(proteins, "overview_id", "left")


def with_sums(data: DataFrame, data_sum: DataFrame) -> DataFrame:
    """Data rows with their results; waiting rows without one have no peak group (status 4)."""
    s = data_sum.select("overview_id", "peptide_ref", "decoy", F.col("status").alias("sum_status"), "fdr", "q_value", "total_score", "selected_rt")
    joined = data.join(s, ["overview_id", "peptide_ref", "decoy"], "left")
    status = F.when(F.col("sum_status").isNull() & (F.col("status") == 0), 4).otherwise(F.coalesce("sum_status", "status"))
    return joined.withColumn("status", status).drop("sum_status").withColumn("select_index", F.array_position("selected_rts", F.col("selected_rt")) - 1)


def ambiguous(scored: DataFrame, least: Column | float, gap: float = 0.1) -> DataFrame:
    """Peptides whose two best groups over the least score lie within ``gap``."""
    over = scored.where(F.col("total_score") > least)
    best = groups.best(over, ["peptide_ref"], "total_score", [F.col("idx")], ["idx", "total_score"])
    rest = over.join(best.select("peptide_ref", "idx"), ["peptide_ref", "idx"], "left_anti").groupBy("peptide_ref").agg(F.max("total_score").alias("next"))
    return best.join(rest, "peptide_ref").where(F.col("total_score") - F.col("next") < gap).select("peptide_ref")


def difference(old: DataFrame, new: DataFrame, key: str = "peptide_ref") -> DataFrame:
    """Keys of only one side, tagged."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("old")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("new")))


def default_overviews(overviews: DataFrame) -> DataFrame:
    """One default per run: the marked one, else the first; of several marked ones the latest."""
    w = Window.partitionBy("run_id").orderBy(F.col("default_one").desc(), F.when(F.col("default_one"), -F.unix_micros("create_date")).otherwise(F.unix_micros("create_date")))
    return overviews.withColumn("default_one", F.row_number().over(w) == 1)


def ordinal_aliases(runs: DataFrame, prefix: str) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy("name")
    return runs.withColumn("alias", F.concat(F.lit(f"{prefix}-"), F.row_number().over(w)))


def clinic(runs: DataFrame, overviews: DataFrame) -> DataFrame:
    """Runs with their overviews, sorted within the project by alias if all have one, else by name."""
    lists = overviews.groupBy("run_id").agg(F.array_sort(F.collect_list("overview_id")).alias("overviews"))
    all_named = F.count("alias").over(Window.partitionBy("project_id")) == F.count(F.lit(1)).over(Window.partitionBy("project_id"))
    order = F.row_number().over(Window.partitionBy("project_id").orderBy("_label", "run_id"))
    return runs.withColumn("_label", F.when(all_named, F.col("alias")).otherwise(F.col("name"))).withColumn("position", order).drop("_label").join(lists, "run_id", "left")


def set_item(items: Column, key: str, value: str | None) -> Column:
    """Dictionary items (array of key, value) with ``key`` set, or removed for None."""
    rest = F.filter(items, lambda x: x["key"] != key)
    return rest if value is None else F.concat(rest, F.array(F.struct(F.lit(key).alias("key"), F.lit(value).alias("value"))))


def leave_one_out(coords: DataFrame) -> DataFrame:
    """Each coordinate once without each of its fragments."""
    at = coords.withColumn("without", F.explode(F.transform("fragments", lambda f: f["cut_info"])))
    return at.withColumn("fragments", F.filter("fragments", lambda f: f["cut_info"] != F.col("without")))
