"""The engine's operators bound to the star tables."""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionflow.functions import peptides
from ionflow.operators import fdr, filters, groups, learning, ordered, ranges, series, similarity
from ionflow.operators.groups import fixed
from ionflow.plans import crossrun, proximity
from ionflow.sources import libraries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cents(c: Column | str) -> Column:
    """An exact whole number of hundredths, so that sums don't depend on their order."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("long")


def capitals(c: str) -> Column:
    """ASCII letters in upper case; engines disagree on letters such as sharp s."""
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# Target/decoy statistics -------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected groups: score n_chars, decoys are the documents of quality 0."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.select("doc_id", "n_chars").join(labels.select("doc_id", (F.col("quality") == 0).alias("decoy")), "doc_id")


@query
def fdr_pipeline(spark, sf_dir):
    d = fdr.pipeline(labelled(spark, sf_dir), ["doc_id"], "n_chars", "decoy", 0.05)
    return d.select("doc_id", "score", *[fixed(F.col(c)).alias(c) for c in ("p", "pi0", "q_value", "fdr")], F.when(fixed(F.col("fdr")) <= 0.05, fdr.SUCCESS).otherwise(fdr.FAILED).cast("int").alias("status"))


@query
def fdr_per_run(spark, sf_dir):
    """The same for each language on its own."""
    runs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("run_id"))
    d = fdr.pipeline_by(labelled(spark, sf_dir).join(runs, "doc_id"), ["run_id"], ["doc_id"], "n_chars", "decoy", 0.05)
    return d.select("run_id", "doc_id", "score", *[fixed(F.col(c)).alias(c) for c in ("p", "pi0", "q_value", "fdr")], F.when(fixed(F.col("fdr")) <= 0.05, fdr.SUCCESS).otherwise(fdr.FAILED).cast("int").alias("status"))


@query
def pvalue_empirical(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    p = fdr.empirical(rows, "n_chars", "decoy")
    return rows.where("NOT decoy").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(p, "score").select("doc_id", fixed(F.col("p")).alias("p"))


@query
def pvalue_parametric(spark, sf_dir):
    return fdr.parametric(labelled(spark, sf_dir), "n_chars", "decoy").select("doc_id", fixed(F.col("p")).alias("p"))


@query
def pi0_bootstrap(spark, sf_dir):
    table = fdr.pi0_table(fdr.empirical(labelled(spark, sf_dir), "n_chars", "decoy"))
    return spark.createDataFrame([(r["lambda"], r["w"], r["pi0"], r["mse"]) for r in table], "lambda double, w long, pi0 double, mse double").select("lambda", "w", fixed(F.col("pi0")).alias("pi0"), fixed(F.col("mse"), 8).alias("mse"))


def _metrics(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    p = fdr.empirical(rows, "n_chars", "decoy")
    return p.select("score", "p").join(fdr.metrics(p, fdr.pi0(p)), "p")


@query
def qvalue(spark, sf_dir):
    return _metrics(spark, sf_dir).select(F.col("score").cast("long").alias("score"), fixed(F.col("q_value")).alias("q_value"))


@query
def fdr_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select(F.col("score").cast("long").alias("score"), "n_positive", *[fixed(F.col(c)).alias(c) for c in ("fdr", "fnr", "sensitivity", "s_value")])


@query
def decoy_fdr(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("score", F.col("n_chars").cast("double"))
    scored = rows.join(_metrics(spark, sf_dir).select("score", "fdr"), "score", "left")
    return fdr.decoy_rates(scored, "score", "decoy", "fdr").select(F.col("score").cast("long").alias("score"), fixed(F.col("fdr")).alias("fdr"))


@query
def threshold_at_fdr(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("fdr", fixed(F.col("fdr"), 9)).withColumn("q_value", fixed(F.col("q_value"), 9))
    a = fdr.threshold(m, "score", "fdr", 0.8).select(F.lit("fdr").alias("rule"), F.col("score").cast("long").alias("score"))
    return a.union(fdr.nearest_cutoff(m, "score", "q_value", 0.3).select(F.lit("q_value"), F.col("score").cast("long")))


# Filters and pages -----------------------------------------------------------------------------


@query
def page_filter(spark, sf_dir):
    rows = filters.where(read(spark, sf_dir, "lineitem"), filters.half_open("l_quantity", 10, 20), filters.equal("l_returnflag", "R"), filters.equal("l_linestatus", None))
    keep = [*LINE, "l_quantity", "l_extendedprice"]
    return filters.page(rows.select(*keep), [F.col("l_extendedprice").desc(), *[F.col(c) for c in LINE]], current=2, size=20)


@query
def regex_filter(spark, sf_dir):
    return filters.where(read(spark, sf_dir, "part"), filters.matches("p_name", "RING")).select("p_partkey", "p_name")


@query
def array_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"), F.split("p_type", " ").alias("kinds"))
    a = filters.where(rows, filters.contains("words", "small")).select("p_partkey", F.lit("contains").alias("rule"))
    return a.union(filters.where(rows, filters.fewer_than("kinds", 2)).select("p_partkey", F.lit("fewer")))


@query
def in_status_between(spark, sf_dir):
    rows = filters.where(read(spark, sf_dir, "orders"), filters.one_of("o_orderstatus", ["F", "O"]), filters.closed("o_totalprice", 1000, 50000))
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query
def stab_window(spark, sf_dir):
    windows = spark.createDataFrame([(i, 900.0 + 12.5 * i, 900.0 + 12.5 * i + 20.0) for i in range(8)], "window_id long, start double, end double")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    hits = ranges.interval_join(parts, windows, "p_retailprice", "start", "end", 20.0, closed="both")
    return hits.groupBy("p_partkey").agg(F.min_by("window_id", "start").alias("window_id"), F.count(F.lit(1)).alias("windows"))


@query
def enabled_default(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("disable", F.col("c_acctbal") < 0)
    return filters.where(rows, filters.enabled()).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


# Joins -------------------------------------------------------------------------------------------


@query
def range_join_windows(spark, sf_dir):
    windows = spark.createDataFrame([(i, 900.0 + 10 * i, 910.0 + 10 * i) for i in range(10)], "window_id long, lo double, hi double")
    hits = ranges.interval_join(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), windows, "p_retailprice", "lo", "hi", 10.0)
    return hits.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("p_retailprice")).alias("price_cents"))


@query
def eic_sum(spark, sf_dir):
    """Chromatogram: target mass p_retailprice, peak mass price per unit within 50 000 ppm, summed quantity per month."""
    ppm = 0.05
    month = F.coalesce(F.month("l_shipdate").cast("long"), F.lit(0).cast("long"))
    peaks = read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("mz"), month.alias("rt"), F.lit(1).cast("long").alias("n"), F.col("l_quantity").cast("long").alias("intensity"))
    months = spark.range(13).select(F.col("id").alias("rt"))  # 0: no date
    targets = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * (1 - ppm)).alias("lo"), (F.col("p_retailprice") * (1 + ppm)).alias("hi")).crossJoin(F.broadcast(months))
    sums = ranges.window_sums(peaks, targets, "mz", "lo", "hi", ["n", "intensity"], ["rt"]).where("n > 0")
    return sums.groupBy("p_partkey", F.nullif("rt", F.lit(0)).alias("rt")).agg(F.sum("intensity").alias("intensity"))


@query
def inner_left_fill(spark, sf_dir):
    sums = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("s"), F.count(F.lit(1)).alias("k"))
    c = read(spark, sf_dir, "customer").select("c_custkey")
    return c.join(sums, c.c_custkey == sums.o_custkey, "left").select("c_custkey", F.coalesce("s", F.lit(0)).alias("total_cents"), F.when(F.col("k").isNull(), 5).otherwise(1).cast("int").alias("status"))


@query
def semi_anti(spark, sf_dir):
    big = read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    c = read(spark, sf_dir, "customer").select("c_custkey")
    return c.join(big, "c_custkey", "left_semi").withColumn("rule", F.lit("with")).union(c.join(big, "c_custkey", "left_anti").withColumn("rule", F.lit("without")))


@query
def report_pivot(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("cents", cents("o_totalprice"))
    return groups.report(rows, "o_custkey", "o_orderstatus", ["F", "O", "P"], "cents")


@query
def nearest_asof(spark, sf_dir):
    """Event of each type nearest to every full hour from the first to the last event, however far."""
    events = read(spark, sf_dir, "events").select("event_type", "event_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("at"))
    span = events.agg(F.floor(F.min("at") / 3600).alias("a"), F.floor(F.max("at") / 3600).alias("b")).first()
    hours = spark.range(span["a"], span["b"] + 1) if span["a"] is not None else spark.range(0)
    marks = hours.select((F.col("id") * 3600).alias("mark"))
    return ranges.nearest_of_all(marks, events, "mark", "at", 3600, ["event_type"], ["at", "event_id"]).select("mark", "event_type", "event_id")


@query
def proximity_pairs(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal"))
    pairs = ranges.band_pairs(c, "c_acctbal", 50.0, "c_custkey", ["c_nationkey"])
    return pairs.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("links"))


@query
def proximity_links(spark, sf_dir):
    """Line prices near those of later lines of the same customer, and of other customers' orders in the same price window.

    Orders stand for peptides, their customers for proteins, lines for fragments; prices are in cents.
    """
    whole = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("double")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").repartition("l_orderkey")  # one exchange for all three
    one = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("l_extendedprice"))  # numbers repeat
    fragment = F.struct("l_linenumber", F.col("l_linenumber").cast("string").alias("cut_info"), whole("l_extendedprice").alias("mz"))
    lines = one.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(fragment)).alias("fragments"))
    orders = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    peptides = orders.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("peptide_ref"), F.array(F.col("o_custkey").cast("string")).alias("proteins"), whole("o_totalprice").alias("mz"), F.lit(0.0).alias("rt"), "fragments")
    windows = spark.range(12).select(F.col("id").cast("int").alias("window_id"), (F.col("id") * 5_000_000.0).alias("mz_start"), ((F.col("id") + 1) * 5_000_000.0 + 100_000.0).alias("mz_end"))
    links = proximity.link_counts(peptides, windows, 2000.0, 5_000_000.0)
    return links.select(F.col("protein").cast("long").alias("o_custkey"), F.col("peptide_ref").cast("long").alias("o_orderkey"), F.col("cut_info").cast("int").alias("l_linenumber"), "own_links", "other_links")


@query
def similar_pairs(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * 10)).alias("parts"))
    pairs = ranges.band_pairs(e, "vec_id", 2, "vec_id", ["label"])
    return pairs.select("vec_id", "vec_id_b", F.size(F.array_intersect("parts", "parts_b")).cast("long").alias("overlap"))


@query
def collision_band(spark, sf_dir):
    """Later parts of the same size within 5 and within 10 price units."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return ranges.band_counts(p, "p_retailprice", {"within_5": 5.0, "within_10": 10.0}, "p_partkey", ["p_size"]).where("within_10 > 0")


@query
def data_with_sums(spark, sf_dir):
    """Orders with their line sums; an order without lines that waits becomes status 4."""
    status = F.when(F.col("o_orderstatus") == "O", 0).otherwise(1)
    o = read(spark, sf_dir, "orders").select(F.lit("all").alias("overview_id"), F.col("o_orderkey").alias("peptide_ref"), F.lit(False).alias("decoy"), status.alias("status"), F.array().cast("array<double>").alias("selected_rts"))
    lines = read(spark, sf_dir, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_orderkey").alias("peptide_ref")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q_value"))
    sums = o.drop("selected_rts").join(lines, "peptide_ref").select("*", *[F.lit(None).cast("double").alias(c) for c in ("fdr", "total_score", "selected_rt")])
    return crossrun.with_sums(o, sums).select(F.col("peptide_ref").alias("o_orderkey"), F.col("q_value").alias("quantity"), F.col("status").cast("int").alias("status"))


@query
def dims_and_counts(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("s"))
    joined = n.join(r, n.n_regionkey == r.r_regionkey, "left").join(c, n.n_nationkey == c.c_nationkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left")
    return joined.select("n_name", "r_name", F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


# Aggregations -------------------------------------------------------------------------------------


@query
def group_first_page(spark, sf_dir):
    g = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first_key"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return filters.page(g, [F.col("p_brand")], 2, 5)


@query
def distinct_counts(spark, sf_dir):
    r = read(spark, sf_dir, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey", "l_suppkey").alias("pairs"), F.count(F.lit(1)).alias("n"))
    return r


@query
def hit_counts(spark, sf_dir):
    """Suppliers with at least 500 distinct parts, all suppliers, all parts they sell."""
    per = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.sum(F.when(F.col("k") >= 500, 1).otherwise(0)).alias("hit"), F.count(F.lit(1)).alias("suppliers"), F.sum("k").alias("pairs"))


@query
def hist_equal(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_retailprice")
    low, high = groups.snapped_bounds(parts, "p_retailprice")
    h = groups.histogram(parts, "p_retailprice", low, high, 20)
    return h.select("bin", fixed(F.col("lo")).alias("lo"), fixed(F.col("hi")).alias("hi"), "n")


@query
def hist_uneven(spark, sf_dir):
    return groups.uneven_histogram(read(spark, sf_dir, "lineitem").select("l_discount"), "l_discount").select("bin", "lo", "n")


@query
def argmax_group(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return groups.best(rows.where("l_quantity >= 5"), ["l_orderkey"], "l_extendedprice", [F.col(c) for c in LINE[1:]], ["l_linenumber", "l_partkey", "l_extendedprice"])


@query
def mode_then_max(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    return groups.mode_then_max(rows, "l_partkey", "l_suppkey", "l_extendedprice")


@query
def cross_run_merge(spark, sf_dir):
    m = groups.merge_runs(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey", F.col("l_quantity"))
    return m.select("l_partkey", fixed(F.col("intensity")).alias("intensity"), "effect_num")


@query
def merge_summary(spark, sf_dir):
    m = groups.merge_runs(read(spark, sf_dir, "lineitem").where("l_quantity >= 30"), "l_returnflag", "l_partkey", F.col("l_quantity"))
    s = groups.merge_summary(m, 3)
    return s.select("hit1", "hit2", "hit3", "items", fixed(F.col("missing_ratio")).alias("missing_ratio"))


def _folds(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", cents("l_extendedprice").alias("v"))
    a = rows.where("l_linestatus = 'F'").groupBy("l_partkey").agg(F.sum("v").alias("v"))
    b = rows.where("l_linestatus = 'O'").groupBy("l_partkey").agg(F.sum("v").alias("v"))
    brand = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = groups.fold_change(a.join(brand, "l_partkey"), b, "l_partkey", "v", F.lit(""))
    return joined.join(brand, "l_partkey").withColumn("species", groups.species_of(F.col("p_brand"), {"1": "HUMAN", "2": "YEAST"}, "ECOLI"))


@query
def fold_change(spark, sf_dir):
    return _folds(spark, sf_dir).select("l_partkey", "species", fixed(F.col("x")).alias("x"), fixed(F.col("y")).alias("y"))


@query
def fold_stats(spark, sf_dir):
    g = _folds(spark, sf_dir).groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"))
    return g.select("species", "n", fixed(F.col("mean")).alias("mean"), fixed(F.col("sd")).alias("sd"))


@query
def legacy_percentile(spark, sf_dir):
    p = groups.percentiles(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice", settled=True)
    return p.select("l_returnflag", F.col("pct").cast("int").alias("pct"), fixed(F.col("value")).alias("value"))


@query
def ion_cv(spark, sf_dir):
    g = groups.spread(read(spark, sf_dir, "part"), ["p_brand"], "p_retailprice").withColumn("cv", fixed(F.col("cv"), 6))
    return filters.page(g.select("p_brand", "cv", "n"), [F.col("cv").desc(), F.col("p_brand")], 1, 6)


@query
def unique_keys(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("l_partkey", "l_suppkey")


@query
def min_decoy_score(spark, sf_dir):
    ok = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.coalesce(F.min(F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 10), F.col("l_extendedprice"))), F.lit(-9999.0)).alias("least"))
    return ok


@query
def group_lists(spark, sf_dir):
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat_ws(",", F.array_sort(F.collect_list("n_name"))).alias("names"), F.count(F.lit(1)).alias("n"))


# Series ------------------------------------------------------------------------------------------


def hourly(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("hour"), cents("value").alias("c"))
    return e.groupBy("event_type", "hour").agg((F.sum("c") / 100.0).alias("v"))


def _smooth(kind):
    def run(spark, sf_dir):
        s = series.smooth(hourly(spark, sf_dir), ["event_type"], "hour", "v", kind, 5)
        return s.select("event_type", "hour", fixed(F.col("smooth")).alias("smooth"))

    return run


QUERIES |= {"smooth_gauss5": _smooth("gauss"), "smooth_sg5": _smooth("savitzky_golay"), "smooth_linear": _smooth("linear")}


@query
def local_maxima(spark, sf_dir):
    return series.local_maxima(hourly(spark, sf_dir), ["event_type"], "hour", "v").select("event_type", "hour", fixed(F.col("v")).alias("v"))


@query
def noise_sn(spark, sf_dir):
    def kernel(x, y):
        sn = series.signal_to_noise(x, y, 200.0)
        return {"hour": x, "sn": sn, "denoised": series.denoise(y, sn)}

    out = series.per_series(hourly(spark, sf_dir), ["event_type"], "hour", "v", kernel, "event_type string, hour double, sn double, denoised double")
    return out.select("event_type", F.col("hour").cast("long").alias("hour"), fixed(F.col("sn")).alias("sn"), fixed(F.col("denoised")).alias("denoised"))


@query
def gauss_kernel(spark, sf_dir):
    out = series.per_series(hourly(spark, sf_dir), ["event_type"], "hour", "v", lambda x, y: {"hour": x, "smooth": series.gauss_filter(x, y)}, "event_type string, hour double, smooth double")
    return out.select("event_type", F.col("hour").cast("long").alias("hour"), fixed(F.col("smooth")).alias("smooth"))


@query
def peak_pick(spark, sf_dir):
    def kernel(x, y):
        rows = []
        for p in series.pick_peaks(x, series.gauss_filter(x, y)):
            left, right, total = series.integrate(x, y, p["index"])
            rows.append((p["apex"], p["height"], x[left], x[right], total))
        return dict(zip(("apex", "height", "start", "stop", "total"), np.array(rows).T if rows else [[]] * 5, strict=True))

    return series.per_series(hourly(spark, sf_dir), ["event_type"], "hour", "v", kernel, "event_type string, apex double, height double, start double, stop double, total double")


@query
def xcorr_shape(spark, sf_dir):
    """Cross-correlation of the hourly series of all pairs of event types on the hours of any of them; an hour without events counts 0."""
    v = hourly(spark, sf_dir)
    s = series.shape_of_pairs(v.withColumn("run", F.lit(1)), ["run"], "event_type", "hour", "v")
    return s.select(*[fixed(F.col(c)).alias(c) for c in ("shape", "shape_weighted", "coelution", "coelution_weighted")])


# Scores and learning ---------------------------------------------------------------------------


@query
def lib_similarity(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("i", "run"))
    lib = e.groupBy("label", "i").agg(F.avg("run").alias("lib"))
    s = similarity.scores(e.join(lib, ["label", "i"]).select("vec_id", "run", "lib"), ["vec_id"], "run", "lib")
    return s.select("vec_id", *[fixed(F.col(c)).alias(c) for c in ("dotprod", "sangle", "rsmd", "avg_sqr", "manhattan", "int_shift", "pearson")])


@query
def rt_fit(spark, sf_dir):
    r = learning.line(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return r.select("l_returnflag", *[fixed(F.col(c)).alias(c) for c in ("slope", "intercept", "r2")], "n")


@query
def rt_residuals(spark, sf_dir):
    """Distance of each line's price from its group's fit: mean absolute and largest."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    fit = learning.line(rows, ["l_returnflag"], "l_quantity", "l_extendedprice")
    d = rows.join(fit, "l_returnflag").withColumn("d", F.abs(F.col("l_extendedprice") - F.col("slope") * F.col("l_quantity") - F.col("intercept")))
    return d.groupBy("l_returnflag").agg(fixed(F.avg("d"), 2).alias("mean_abs"), fixed(F.max("d"), 2).alias("largest"))


@query
def robust_fit(spark, sf_dir):
    monthly = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("q")).agg((F.avg("l_extendedprice") / 1000).alias("p"))
    return learning.calibrate_groups(monthly, ["l_returnflag"], "p", "q").drop("points", "left_out")


@query
def weighted_score(spark, sf_dir):
    w = {"l_quantity": 0.5, "l_discount": -2.0, "l_tax": 4.0, "l_extendedprice": 0.001}
    return read(spark, sf_dir, "lineitem").select(*LINE, fixed(learning.weighted(w)).alias("score"))


@query
def linear_discriminant(spark, sf_dir):
    columns = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    rows = read(spark, sf_dir, "lineitem").select(*columns, F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    w = learning.least_squares(rows, columns, "y", muted=())
    return spark.createDataFrame(sorted(w.items()), "name string, weight double").select("name", fixed(F.col("weight"), 6).alias("weight"))


# Scalars -------------------------------------------------------------------------------------------


@query
def string_ops(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "(UniMod:4)"), F.lit("(x)")).alias("full"), F.concat(F.lit("2/"), F.regexp_replace("p_type", " ", "/")).alias("label"), F.concat(F.lit("y3^"), F.col("p_size"), F.lit("i")).alias("cut"), "p_name", "p_type")
    return p.select(
        "p_partkey",
        peptides.strip_modifications(F.col("full")).alias("stripped"),
        F.array_join(peptides.proteins(F.col("label")), ",").alias("proteins"),
        peptides.cut_charge(F.col("cut")).cast("long").alias("charge"),
        peptides.header(F.col("p_type")).alias("header"),
        F.coalesce(peptides.between(F.concat(F.lit("OS="), F.col("p_type"), F.lit(" GN=")), "OS=", " GN="), F.lit("")).alias("organism"),
        fixed(peptides.identity(F.col("p_name"), F.reverse("p_name"))).alias("identity"),
    )


@query
def digest(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(peptides.digest(capitals("text"), 5, 30)).alias("peptide"))
    return d.groupBy("peptide").agg(F.countDistinct("doc_id").alias("docs")).where("docs = 1").select("peptide")


@query
def mass_of_text(spark, sf_dir):
    """Summed residue masses of all letters of a text, from letter counts."""
    up = capitals("text")
    counts = {c: F.length(up) - F.length(F.replace(up, F.lit(c), F.lit(""))) for c in peptides.RESIDUES}
    total = F.lit(0.0)
    for c, m in peptides.RESIDUES.items():
        total = total + counts[c] * m
    return read(spark, sf_dir, "documents").select("doc_id", fixed(total, 2).alias("mass"))


@query
def peptide_mass(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("s"))
    return p.select("p_partkey", fixed(peptides.mz(F.col("s"), "full", 2)).alias("mz2"), fixed(peptides.mz(F.col("s"), "y", 1)).alias("y1"), peptides.decoy_by_ends(F.col("s")).alias("decoy"))


@query
def decoy_fragments(spark, sf_dir):
    """Decoys by ends of the part names' letters, with a modification of 57.021464 on the second to last letter, and their fragments."""
    letters = F.upper(F.regexp_replace("p_name", "[^A-Za-z]", ""))
    names = F.array(*[F.struct(F.lit(c).alias("cut_info"), F.lit(0.0).alias("mz"), F.lit(1.0).alias("intensity")) for c in ("y3", "b4^2")])
    p = read(spark, sf_dir, "part").select("p_partkey", letters.alias("s"), F.create_map(F.length(letters) - 2, F.lit("4")).alias("mods"), names.alias("fragments"))
    d = peptides.decoys(p, "p_partkey", "s", "ends", "mods", "fragments", {"4": 57.021464})
    mz = lambda c: fixed(F.element_at(F.filter("decoy_fragments", lambda f: f["cut_info"] == c), 1)["mz"])
    return d.select("p_partkey", "decoy_sequence", F.map_keys("decoy_unimod_map")[0].cast("long").alias("modified"), mz("y3").alias("y3"), mz("b4^2").alias("b4"))


@query
def kv_json(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), libraries.parse_pairs(F.regexp_replace("props", r'[{}" ]', "")).alias("m"))
    return e.select("event_id", "k", F.col("m")["k"].alias("kv"))


@query
def set_ops(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda d, name: d.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit(name))
    few = c.where("k < 12")
    return tag(c.unionAll(s), "union_all").union(tag(few.union(s).distinct(), "union")).union(tag(few.intersect(s), "intersect")).union(tag(s.exceptAll(few), "except_all")).union(tag(s.subtract(few), "except"))


@query
def sort_rank(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    w = Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    r = s.select("s_suppkey", F.row_number().over(w).cast("long").alias("rn"), F.dense_rank().over(Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc())).cast("long").alias("dr"), F.ntile(2).over(w).cast("long").alias("half"), F.max("s_acctbal").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, 0)).alias("top"))
    return r


@query
def running_total(spark, sf_dir):
    """Running order total by key over the whole table, without a single-task sort."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("c"))
    per_key = o.groupBy("o_orderkey").agg(F.sum("c").alias("c"))
    return ordered.running(per_key, "o_orderkey", {"total_cents": ("sum", "c")}).select("o_orderkey", "total_cents")


@query
def alias_ordinals(spark, sf_dir):
    """Ordinal alias per list and one default per group (the first)."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("name"))
    return crossrun.ordinal_aliases(s, "run").select("s_suppkey", "alias", (F.col("alias") == "run-1").alias("is_default"))


# Products over runs and other query shapes --------------------------------------------------------


def as_results(spark, sf_dir):
    """Lines as identification rows: run = return flag, peptide = part, decoys are discounted lines."""
    rows = read(spark, sf_dir, "lineitem").withColumn("peptide_ref", F.col("l_partkey").cast("string"))
    per = rows.groupBy(F.col("l_returnflag").alias("run_id"), "peptide_ref").agg(F.sum(cents("l_extendedprice")).alias("c"), F.max(cents("l_discount")).alias("d"), F.min("l_quantity").alias("q"))
    return per.select(
        "run_id", F.col("run_id").alias("overview_id"), "peptide_ref", (F.col("d") <= 5).alias("decoy"), F.array(F.concat(F.lit("P"), F.pmod(F.col("peptide_ref").cast("long"), F.lit(50)))).alias("proteins"), (F.pmod(F.col("peptide_ref").cast("long"), F.lit(3)) > 0).alias("is_unique"),
        F.when(F.col("q") > 1, 1).otherwise(2).alias("status"), (F.col("c") / 100.0).alias("intensity_sum"), F.lit(None).cast("double").alias("fit_int_sum"), F.col("q").alias("apex_rt"), (F.col("c") / 1e6).alias("total_score"),
    )


@query
def overview_statistics(spark, sf_dir):
    return crossrun.statistics(as_results(spark, sf_dir), 20)


@query
def run_report(spark, sf_dir):
    peptides = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("peptide_ref"), F.array(F.col("p_brand")).alias("proteins"), F.lit(True).alias("is_unique"))
    r = crossrun.report(peptides, as_results(spark, sf_dir), ["A", "N", "R"])
    return r.select("protein", "peptide_ref", *[fixed(F.col(c), 2).alias(c) for c in "ANR"])


@query
def group_merge(spark, sf_dir):
    m = crossrun.merge_group(as_results(spark, sf_dir), ["A", "R"])
    return m.select("item", fixed(F.col("intensity"), 2).alias("intensity"), "effect_num")


@query
def rt_pairs(spark, sf_dir):
    runs = spark.createDataFrame([("A", 2.0, 1.0), ("N", 4.0, 0.0), ("R", 0.0, 0.0)], "run_id string, irt_slope double, irt_intercept double")
    peptides = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("peptide_ref"), F.col("p_size").cast("double").alias("rt"))
    p = crossrun.rt_pairs(as_results(spark, sf_dir), peptides, runs)
    return p.select("run_id", "peptide_ref", F.col("x"), fixed(F.col("y")).alias("y"))


@query
def ambiguous_top2(spark, sf_dir):
    rows = as_results(spark, sf_dir).select("peptide_ref", F.col("run_id").alias("idx"), "total_score")
    return crossrun.ambiguous(rows, 0.05, 0.5)


@query
def old_new_diff(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_quantity = 7").select("l_partkey", "l_linestatus")
    return crossrun.difference(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'"), "l_partkey")


@query
def prefix_filter(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return p.where(filters.not_prefixed("words", "s")).select("p_partkey")


@query
def neighbour_windows(spark, sf_dir):
    """Windows of width 10 that hold a part's price or that lie one to the left or right."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.col("p_retailprice") + k * 10.0)).alias("v"))
    w = spark.createDataFrame([(i, 900.0 + 10 * i, 910.0 + 10 * i) for i in range(10)], "window_id long, lo double, hi double")
    return ranges.interval_join(p, w, "v", "lo", "hi", 10.0).groupBy("window_id").agg(F.countDistinct("p_partkey").alias("n"))


@query
def identifier_links(spark, sf_dir):
    from ionflow.sources.libraries import protein_links

    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("sp|"), F.col("s_suppkey"), F.lit("|"), F.col("s_name"))).otherwise(F.col("s_name")).alias("identifier"))
    return protein_links(s).select("s_suppkey", "uniprot_link")


@query
def fragments_of_text(spark, sf_dir):
    """b and y fragments of the first part names' letters at charges one and two."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("s"))
    return peptides.fragments(p, "s").groupBy("cut_info").agg(F.count(F.lit(1)).alias("n"), fixed(F.sum(F.round("mz", 6).cast("decimal(20,6)")).cast("double"), 2).alias("mz"))
