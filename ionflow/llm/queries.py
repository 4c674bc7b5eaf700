"""The queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionflow.llm import covering_simhash, host_quality, mixture_packing, ngram_join, piecewise_hash, resharding, secret_scan, string_kernel, surrogates, tree_bpe, vector_codes, warc, whitening
from ionflow.llm.common import materialise, scratch_path, table


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.judge(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op3_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piecewise_hash.with_next(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


TOKENIZER = "word_bpe_49k.json"
LEAF = 16  # characters; the longest words of prose and whatever else is unsplit are encoded as trees


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixture_packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), spans=True)
    return found.select("doc_id", "text", F.when(F.col("replaced") == "", 0).otherwise(F.size(F.split("replaced", ","))).cast("long").alias("n_entities"), F.col("replaced").alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    # Two reads, each with its predicate pushed down: responses with their payloads, revisits by their headers alone.
    kept = warc.read_archives(spark, folder, "verify").where("record_type = 'response'")
    again = warc.read_archives(spark, folder, "skip").where("record_type = 'revisit'")
    return kept.union(again).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"), "payload_read")


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = string_kernel.predict(docs, string_kernel.fit(docs))
    return found.select("doc_id", string_kernel.in_fold("doc_id").alias("held_out"), "lang_pred", "score")


def op8_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    slices = materialise(resharding.plan(spark, path, 16), "slices")
    out = scratch_path(spark, "shards")
    affected = resharding.rewrite(spark, path, slices, out)
    found = resharding.read_back(spark, path, slices, out, affected, ["doc_id", "text"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), resharding.size_of(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, LEAF)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "trees",
    )


def op10_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", covering_simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return found.withColumn("code", vector_codes.hex_code("code"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_quality": op1_host_quality,
    "op2_secret_scan": op2_secret_scan,
    "op3_piecewise_hash": op3_piecewise_hash,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_surrogates": op5_surrogates,
    "op6_warc": op6_warc,
    "op7_string_kernel": op7_string_kernel,
    "op8_flow_resharding": op8_flow_resharding,
    "op9_tree_bpe": op9_tree_bpe,
    "op10_covering_simhash": op10_covering_simhash,
    "op11_ngram_join": op11_ngram_join,
    "op12_lanczos_whitening": op12_lanczos_whitening,
    "op13_elkan_codes": op13_elkan_codes,
}

def _lloyd(rounds: int) -> str:
    """DuckDB text of plain Lloyd's algorithm: each round compares every part with every entry."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT r, part, min({{'d': list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m FROM p JOIN b{k} USING (part) GROUP BY r, part)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT part, m.e AS e, i, sum(y[i + 1]) AS s, count(*) AS n FROM a{k} JOIN (SELECT r, part, y, unnest(range(len(y))) AS i FROM p) USING (r, part) GROUP BY part, m.e, i)")
            steps.append(f"b{k + 1} AS (SELECT part, e, coalesce(f, c) AS c FROM b{k} LEFT JOIN (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS f FROM s{k} GROUP BY part, e) USING (part, e))")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
o AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, * FROM v),
p AS (SELECT r, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS y FROM o, (SELECT unnest(range(4)) AS part)),
b0 AS (SELECT part, r - 1 AS e, y AS c FROM p WHERE r <= 256),
{",\n".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds}),
f AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN o USING (r), h
"""


SQL: dict[str, str] = {
    "op1_host_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
i AS (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS p FROM w),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2]) AS n FROM i),
c AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT w.doc_id, CASE WHEN source IS NULL THEN 'null'
                 WHEN regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> '' THEN '=' || lower(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))
                 ELSE '=' || source END AS host,
        len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, 10 * n_symbols > n_words AS symbols_failed, 10 * n_dup_lines > 9 * n_lines AS lines_failed FROM m),
h AS (SELECT host, count(*)::BIGINT AS n, sum(base_failed::INT)::BIGINT AS fb, sum(symbols_failed::INT)::BIGINT AS fs, sum(lines_failed::INT)::BIGINT AS fl FROM f GROUP BY host),
a AS (SELECT sum(n)::DOUBLE AS nn, count(*)::DOUBLE AS k, sum(fb) / sum(n) AS mb, sum(fs) / sum(n) AS ms, sum(fl) / sum(n) AS ml,
        sum(fb * fb / n) / sum(n) AS qb, sum(fs * fs / n) / sum(n) AS qs, sum(fl * fl / n) / sum(n) AS ql FROM h),
z AS (SELECT mb, ms, ml,
        greatest(mb * (1 - mb) / greatest(qb - mb * mb - mb * (1 - mb) * (k - 1) / nn, 1e-9) - 1, 1) AS sb,
        greatest(ms * (1 - ms) / greatest(qs - ms * ms - ms * (1 - ms) * (k - 1) / nn, 1e-9) - 1, 1) AS ss,
        greatest(ml * (1 - ml) / greatest(ql - ml * ml - ml * (1 - ml) * (k - 1) / nn, 1e-9) - 1, 1) AS sl FROM a),
v AS (SELECT host, n AS host_docs, fb AS base_failures, (fb + mb * sb) / (n + sb) > 0.5 AS host_blocked,
        (fs + ms * ss) / (n + ss) >= 0.01 AS symbols_on, (fl + ml * sl) / (n + sl) >= 0.01 AS lines_on FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT host_blocked AND NOT (symbols_failed AND symbols_on) AND NOT (lines_failed AND lines_on) AS kept,
  host_docs, base_failures, host_blocked
FROM f JOIN v USING (host)
""",
    "op11_ngram_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT r, ws, unnest(range(1, len(ws) - 2)) AS p FROM d WHERE len(ws) >= 4),
g AS (SELECT DISTINCT r, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] || ' ' || ws[p + 3] AS s FROM i
      UNION ALL SELECT r, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
b AS (SELECT x.r AS r, y.r AS q, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.r <> y.r GROUP BY x.r, y.r),
l AS (SELECT b.r, b.q FROM b JOIN n x ON x.r = b.r JOIN n y ON y.r = b.q WHERE 100 * c >= 85 * (x.n + y.n - c)),
z AS (SELECT r, r AS q FROM d UNION SELECT z.r, l.q FROM z JOIN l ON l.r = z.q)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN z ON z.r = d.r JOIN d o ON o.r = z.q GROUP BY d.r, d.doc_id
""",
    "op13_elkan_codes": _lloyd(4),
}
