"""DuckDB texts of the star queries."""

from __future__ import annotations

from ionflow.functions.peptides import H, RESIDUES, ENDS, SWAP_FROM, SWAP_TO
from ionflow.operators.groups import FDR_BINS
from ionflow.operators.series import weights


def f4(x: str, n: int = 4) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


_ROWS = "r AS (SELECT doc_id, n_chars::DOUBLE AS s, quality = 0 AS decoy FROM documents JOIN labels USING (doc_id))"
_P = _ROWS + """,
t AS (SELECT count(*) FILTER (decoy) AS nd, count(*) FILTER (NOT decoy) AS n FROM r),
l AS (SELECT s, count(*) FILTER (NOT decoy) AS k, count(*) FILTER (decoy) AS d FROM r GROUP BY s),
a AS (SELECT s, k, coalesce(sum(d) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM l),
p AS (SELECT s, k, greatest(above / nd::DOUBLE, 1.0::DOUBLE / nd) AS p FROM a, t WHERE k > 0)"""
_LAMBDA = _P + """,
la AS (SELECT i / 20.0::DOUBLE AS x FROM range(10) q(i)),
w AS (SELECT x, coalesce(sum(k) FILTER (p >= x), 0)::BIGINT AS w FROM la, p GROUP BY x),
e AS (SELECT x, w, w::DOUBLE / n / (1 - x) AS pi0 FROM w, t),
ms AS (SELECT x, w, pi0, w / (n::DOUBLE ** 2 * (1 - x) ** 2) * (1 - w::DOUBLE / n) + (pi0 - (SELECT min(pi0) FROM e)) ** 2 AS mse FROM e, t)"""
_M = _LAMBDA + """,
z AS (SELECT least(pi0, 1.0) AS z FROM ms WHERE pi0 > 0 ORDER BY mse, x LIMIT 1),
g AS (SELECT p, sum(k) AS k FROM p GROUP BY p),
c AS (SELECT p, sum(k) OVER (ORDER BY p) AS np FROM g),
b AS (SELECT p, np::BIGINT AS n_positive, p * (z * n) / np AS raw, greatest(least(p * (z * n) / np, 1.0), 0.0) AS fdr,
   CASE WHEN n = np THEN 0.0 ELSE greatest(least(((n - np) - (1 - p) * (z * n)) / (n - np), 1.0), 0.0) END AS fnr,
   CASE WHEN n = z * n THEN 0.0 ELSE greatest(least((np - p * (z * n)) / (n - z * n), 1.0), 0.0) END AS sens FROM c, z, t),
m AS (SELECT *, min(least(raw, 1.0)) OVER (ORDER BY p DESC) AS q_value, max(sens) OVER (ORDER BY p) AS s_value FROM b),
ps AS (SELECT s, m.* FROM p JOIN m USING (p))"""

_HOURLY = "v AS (SELECT event_type, (epoch(date_trunc('hour', ts)) / 3600)::BIGINT AS hour, sum(round(value * 100)::BIGINT) / 100.0::DOUBLE AS v FROM events GROUP BY 1, 2)"


def _smooth(kind: str) -> str:
    w = weights(kind, 5)
    terms = [f"{w[0]} * v"] + [f"{w[j]} * (coalesce(lag(v, {j}) OVER o, 0) + coalesce(lead(v, {j}) OVER o, 0))" for j in (1, 2)]
    return f"WITH {_HOURLY} SELECT event_type, hour, {f4(' + '.join(terms))} AS smooth FROM v WINDOW o AS (PARTITION BY event_type ORDER BY hour)"


_MASS = "(VALUES " + ", ".join(f"('{c}', {m}::DOUBLE)" for c, m in RESIDUES.items()) + ") AS x(c, m)"
_FOLDS = """f AS (SELECT l_partkey, sum(round(l_extendedprice * 100)::BIGINT) FILTER (l_linestatus = 'F') AS a, sum(round(l_extendedprice * 100)::BIGINT) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1),
g AS (SELECT l_partkey, CASE WHEN p_brand LIKE '%1' THEN 'HUMAN' WHEN p_brand LIKE '%2' THEN 'YEAST' ELSE 'ECOLI' END AS species, log2(b::DOUBLE) AS x, log2(a::DOUBLE / b::DOUBLE) AS y FROM f JOIN part ON p_partkey = l_partkey WHERE a > 0 AND b > 0)"""

_RES = """s AS (SELECT l_returnflag AS run_id, l_partkey, l_partkey::VARCHAR AS peptide_ref, sum(round(l_extendedprice * 100)::BIGINT) AS c, max(round(l_discount * 100)::BIGINT) <= 5 AS decoy, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, c / 100.0::DOUBLE AS v, 'P' || (l_partkey % 50)::VARCHAR AS protein, l_partkey % 3 > 0 AS is_unique, c / 1e6::DOUBLE AS total_score FROM s),
ok AS (SELECT * FROM k WHERE q > 1 AND NOT decoy)"""

_BY_RUN = """r AS (SELECT coalesce(lang, 'none') AS run_id, doc_id, n_chars::DOUBLE AS s, quality = 0 AS decoy FROM documents JOIN labels USING (doc_id)),
t AS (SELECT run_id, count(*) FILTER (decoy) AS nd, count(*) FILTER (NOT decoy) AS n, min(s) FILTER (NOT decoy) > max(s) FILTER (decoy) AS sep FROM r GROUP BY 1),
l AS (SELECT run_id, s, count(*) FILTER (NOT decoy) AS k, count(*) FILTER (decoy) AS d FROM r GROUP BY 1, 2),
a AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY run_id ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM l),
p AS (SELECT run_id, s, k, n, sep, CASE WHEN nd > 0 THEN greatest(above / nd::DOUBLE, 1.0::DOUBLE / nd) END AS p FROM a JOIN t USING (run_id) WHERE k > 0),
w AS (SELECT run_id, i / 20.0::DOUBLE AS x, n, sep, coalesce(sum(k) FILTER (p >= i / 20.0::DOUBLE), 0)::BIGINT AS w FROM p, range(10) q(i) GROUP BY run_id, i, n, sep),
e AS (SELECT *, w::DOUBLE / n / (1 - x) AS pi0 FROM w),
ms AS (SELECT *, w / (n::DOUBLE ** 2 * (1 - x) ** 2) * (1 - w::DOUBLE / n) + (pi0 - min(pi0) OVER (PARTITION BY run_id)) ** 2 AS mse FROM e),
z AS (SELECT run_id, CASE WHEN any_value(sep) THEN 1e-6 ELSE least(arg_min(pi0, (mse, x)) FILTER (pi0 > 0), 1.0) END AS z FROM ms GROUP BY 1),
g AS (SELECT run_id, p, n, sum(k) AS k FROM p GROUP BY 1, 2, 3),
c AS (SELECT run_id, p, p * z * n / sum(k) OVER (PARTITION BY run_id ORDER BY p) AS raw, z FROM g JOIN z USING (run_id)),
m AS (SELECT *, min(least(raw, 1.0)) OVER (PARTITION BY run_id ORDER BY p DESC) AS q_value, greatest(least(raw, 1.0), 0.0) AS fdr FROM c)"""
_PAIRS = f"""{_HOURLY}, h AS (SELECT hour, row_number() OVER (ORDER BY hour) AS i FROM (SELECT DISTINCT hour FROM v)), k AS (SELECT DISTINCT event_type FROM v),
f AS (SELECT event_type, i, coalesce(v, 0.0::DOUBLE) AS v FROM h CROSS JOIN k LEFT JOIN v USING (event_type, hour)),
y AS (SELECT event_type, i, (v - avg(v) OVER o) / stddev_pop(v) OVER o AS y, count(*) OVER o AS n FROM f WINDOW o AS (PARTITION BY event_type)),
c AS (SELECT a.event_type AS a, b.event_type AS b, a.i - b.i AS lag, round(sum(a.y * b.y) / any_value(a.n), 9) AS r FROM y a JOIN y b ON a.event_type <= b.event_type GROUP BY 1, 2, 3),
x AS (SELECT a, b, max(r) AS best, abs(arg_min(lag, (-r, lag)))::DOUBLE AS lag FROM c GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN a = b THEN 1.0 ELSE 2.0 END / (SELECT count(*) ** 2 FROM k) AS w FROM x)"""
_NOISE = f"""{_HOURLY}, u AS (SELECT *, greatest(1.0, (avg(v) OVER o + 3 * stddev_pop(v) OVER o) / 30) AS size FROM v WINDOW o AS (PARTITION BY event_type)),
l AS (SELECT *, least(trunc(v / size), 29) AS slot FROM u),
m AS (SELECT a.event_type, a.hour, any_value(a.v) AS v, any_value(a.size) AS size, count(*) AS n, list_sort(list(b.slot))[(count(*) + 1) // 2] AS median FROM l a JOIN l b ON a.event_type = b.event_type AND b.hour BETWEEN a.hour - 100 AND a.hour + 100 GROUP BY 1, 2),
s AS (SELECT event_type, hour, v, v / CASE WHEN n < 10 THEN 2.0 ELSE greatest(1.0, (median + 0.5) * size) END AS sn FROM m)"""
_GAUSS = f"""{_HOURLY}, d AS (SELECT a.event_type, a.hour, b.hour AS x, b.v AS y, abs(b.hour - a.hour) / 0.01::DOUBLE AS d FROM v a JOIN v b ON a.event_type = b.event_type AND abs(b.hour - a.hour) < 25),
g AS (SELECT *, least(floor(d), 2499) AS q FROM d), e AS (SELECT *, exp(-((q * 0.01::DOUBLE) ** 2) / (2 * 6.25::DOUBLE * 6.25)) AS k0, exp(-(((q + 1) * 0.01::DOUBLE) ** 2) / (2 * 6.25::DOUBLE * 6.25)) AS k1 FROM g),
k AS (SELECT *, k0 + (d - q) * (k1 - k0) AS k FROM e),
t AS (SELECT event_type, hour, y, lead(x) OVER w - x AS dx, k, lead(k) OVER w AS kn, lead(y) OVER w AS yn FROM k WINDOW w AS (PARTITION BY event_type, hour ORDER BY x)),
s AS (SELECT event_type, hour, count(*) AS n, any_value(y) AS lone, sum(dx * (kn + k) / 2) AS norm, sum(dx * (kn * yn + k * y) / 2) AS total FROM t GROUP BY 1, 2)"""
_XS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _det(m: list[list[str]]) -> str:
    """The determinant of a matrix of SQL terms, by its first row."""
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {x} * {_det([r[:j] + r[j + 1 :] for r in m[1:]])}" for j, x in enumerate(m[0])) + ")"


def _discriminant() -> str:
    """Normal equations by Cramer's rule, columns scaled to the same size."""
    scale = dict(zip(_XS, ("1.0", "500.0", "500.0", "0.001"), strict=True))
    x = [f"({c}::DOUBLE * {scale[c]})" for c in _XS]
    sums = ", ".join([f"sum({x[i]} * {x[j]}) AS x{i}{j}" for i in range(4) for j in range(i, 4)] + [f"sum({x[i]} * (l_returnflag = 'R')::INT) AS y{i}" for i in range(4)])
    m = [[f"x{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
    one = lambda k: _det([[f"y{i}" if j == k else m[i][j] for j in range(4)] for i in range(4)])
    return f"WITH s AS (SELECT {sums} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS name, {f4(f'{one(k)} / {_det(m)} * {scale[c]}', 6)} AS weight FROM s" for k, c in enumerate(_XS))


SQL: dict[str, str] = {
    "fdr_per_run": f"WITH {_BY_RUN} SELECT run_id, doc_id, r.s AS score, {f4('p.p')} AS p, {f4('z')} AS pi0, {f4('q_value')} AS q_value, {f4('fdr')} AS fdr, CASE WHEN {f4('fdr')} <= 0.05 THEN 1 ELSE 2 END::INT AS status FROM r JOIN p USING (run_id, s) LEFT JOIN m USING (run_id, p) WHERE NOT decoy",
    "xcorr_shape": f"WITH {_PAIRS} SELECT {f4('avg(best)')} AS shape, {f4('sum(best * w)')} AS shape_weighted, {f4('avg(lag) + stddev_samp(lag)')} AS coelution, {f4('sum(lag * w)')} AS coelution_weighted FROM z",
    "noise_sn": f"WITH {_NOISE} SELECT event_type, hour, {f4('sn')} AS sn, {f4('v * sn / (sn + 1)')} AS denoised FROM s",
    "gauss_kernel": f"WITH {_GAUSS} SELECT event_type, hour, {f4('CASE WHEN n = 1 THEN lone ELSE total / norm END')} AS smooth FROM s",
    "linear_discriminant": _discriminant(),
    "decoy_fragments": f"""WITH s AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS s FROM part),
d AS (SELECT p_partkey, length(s) AS n, translate(s[1], '{SWAP_FROM}', '{SWAP_TO}') || s[2:-2] || translate(s[-1], '{SWAP_FROM}', '{SWAP_TO}') AS s FROM s),
l AS (SELECT p_partkey, n, s, i, coalesce(m, 0) + CASE WHEN i = n - 1 THEN 57.021464::DOUBLE ELSE 0 END AS m FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d) LEFT JOIN {_MASS} ON c = s[i])
SELECT p_partkey, s AS decoy_sequence, (n - 2)::BIGINT AS modified, {f4(f'coalesce(sum(m) FILTER (i > n - 3), 0) + {ENDS["y"]}::DOUBLE + {H}::DOUBLE')} AS y3, {f4(f'(coalesce(sum(m) FILTER (i <= 4), 0) + {ENDS["b"]}::DOUBLE + 2 * {H}::DOUBLE) / 2')} AS b4 FROM l GROUP BY 1, 2, 3""",
    "fdr_pipeline": f"WITH {_M}, sep AS (SELECT min(s) FILTER (NOT decoy) > max(s) FILTER (decoy) AS sep FROM r) SELECT doc_id, r.s AS score, {f4('p')} AS p, {f4('z')} AS pi0, {f4('q_value')} AS q_value, {f4('fdr')} AS fdr, CASE WHEN {f4('fdr')} <= 0.05 THEN 1 ELSE 2 END::INT AS status FROM r JOIN ps USING (s), z WHERE NOT decoy",
    "pvalue_empirical": f"WITH {_P} SELECT doc_id, {f4('p')} AS p FROM r JOIN p USING (s) WHERE NOT decoy",
    "pvalue_parametric": f"WITH {_ROWS}, d AS (SELECT avg(s) AS mu, stddev_pop(s) AS sd FROM r WHERE decoy), x AS (SELECT doc_id, (s - mu) / sd / sqrt(2.0) AS x FROM r, d WHERE NOT decoy), e AS (SELECT doc_id, sum(exp(-((i * x / 100.0) ** 2))) * any_value(x) * 2.0 / sqrt(pi()) / 100.0 AS e FROM x, range(1, 101) q(i) GROUP BY doc_id) SELECT doc_id, {f4('1 - 0.5 * (1 + e)')} AS p FROM e",
    "pi0_bootstrap": f"WITH {_LAMBDA} SELECT x AS lambda, w, {f4('pi0')} AS pi0, {f4('mse', 8)} AS mse FROM ms",
    "qvalue": f"WITH {_M} SELECT s::BIGINT AS score, {f4('q_value')} AS q_value FROM ps",
    "fdr_metrics": f"WITH {_M} SELECT s::BIGINT AS score, n_positive, {f4('fdr')} AS fdr, {f4('fnr')} AS fnr, {f4('sens')} AS sensitivity, {f4('s_value')} AS s_value FROM ps",
    "decoy_fdr": f"WITH {_M}, y AS (SELECT l.s, d, k, CASE WHEN k > 0 THEN l.s END AS ts, CASE WHEN k > 0 THEN fdr END AS tf FROM l LEFT JOIN ps USING (s)), n AS (SELECT s, d, last_value(ts IGNORE NULLS) OVER u AS ls, last_value(tf IGNORE NULLS) OVER u AS lf, first_value(ts IGNORE NULLS) OVER v AS rs, first_value(tf IGNORE NULLS) OVER v AS rf FROM y WINDOW u AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT s::BIGINT AS score, {f4('CASE WHEN ls IS NULL THEN NULL WHEN rs IS NULL THEN lf WHEN s - ls < rs - s THEN lf ELSE rf END')} AS fdr FROM n WHERE d > 0",
    "threshold_at_fdr": f"WITH {_M}, k AS (SELECT s, {f4('fdr', 9)} AS fdr, {f4('q_value', 9)} AS q FROM ps) (SELECT 'fdr' AS rule, s::BIGINT AS score FROM k WHERE fdr < 0.8 ORDER BY fdr DESC, s LIMIT 1) UNION ALL (SELECT 'q_value', s::BIGINT FROM k ORDER BY abs(q - 0.3), s LIMIT 1)",
    "page_filter": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20 OFFSET 20",
    "regex_filter": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'RING', 'i')",
    "array_filter": "SELECT p_partkey, 'contains' AS rule FROM part WHERE list_contains(string_split(p_name, ' '), 'small') UNION ALL SELECT p_partkey, 'fewer' FROM part WHERE len(string_split(p_type, ' ')) < 2",
    "in_status_between": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 50000",
    "stab_window": "WITH w AS (SELECT i AS window_id, 900.0 + 12.5 * i AS a, 920.0 + 12.5 * i AS b FROM range(8) q(i)) SELECT p_partkey, min(window_id)::BIGINT AS window_id, count(*) AS windows FROM part JOIN w ON p_retailprice BETWEEN a AND b GROUP BY 1",
    "enabled_default": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT (c_acctbal < 0) GROUP BY 1",
    "range_join_windows": "SELECT i::BIGINT AS window_id, count(*) AS n, sum(round(p_retailprice * 100)::BIGINT)::BIGINT AS price_cents FROM part JOIN range(10) q(i) ON p_retailprice >= 900 + 10 * i AND p_retailprice < 910 + 10 * i GROUP BY 1",
    "eic_sum": "SELECT p_partkey, month(l_shipdate)::BIGINT AS rt, sum(l_quantity::BIGINT)::BIGINT AS intensity FROM part JOIN lineitem ON l_extendedprice / l_quantity BETWEEN p_retailprice * (1 - 0.05::DOUBLE) AND p_retailprice * (1 + 0.05::DOUBLE) GROUP BY 1, 2",
    "inner_left_fill": "SELECT c_custkey, coalesce(sum(round(o_totalprice * 100)::BIGINT), 0)::BIGINT AS total_cents, CASE WHEN count(o_orderkey) = 0 THEN 5 ELSE 1 END::INT AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "semi_anti": "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) THEN 'with' ELSE 'without' END AS rule FROM customer",
    "report_pivot": 'SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = \'F\')::BIGINT AS "F", sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = \'O\')::BIGINT AS "O", sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = \'P\')::BIGINT AS "P" FROM orders GROUP BY 1',
    "nearest_asof": "WITH e AS (SELECT event_type, event_id, floor(epoch(ts))::BIGINT AS sec FROM events), m AS (SELECT i * 3600 AS mark FROM (SELECT unnest(range((SELECT min(sec) // 3600 FROM e), (SELECT max(sec) // 3600 + 1 FROM e))) AS i)) SELECT mark::BIGINT AS mark, event_type, arg_min(event_id, (abs(sec - mark), sec, event_id)) AS event_id FROM m CROSS JOIN e GROUP BY 1, 2",
    "proximity_pairs": "SELECT a.c_custkey, count(*) AS links FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND abs(a.c_acctbal - b.c_acctbal) <= 50 GROUP BY 1",
    "proximity_links": """
WITH p AS (SELECT o_orderkey, o_custkey, floor(o_totalprice * 100 + 0.5) AS pm FROM orders),
w AS (SELECT range AS w, range * 5000000.0 AS a, (range + 1) * 5000000.0 + 100000.0 AS b FROM range(12)),
f AS (SELECT o_custkey, o_orderkey, pm, l_linenumber, floor(max(l_extendedprice) * 100 + 0.5) AS m FROM lineitem JOIN p ON l_orderkey = o_orderkey GROUP BY ALL),
h AS (SELECT o_orderkey, max(w) AS w FROM p JOIN w ON pm BETWEEN a AND b GROUP BY 1),
o AS (SELECT t.o_orderkey, t.l_linenumber, count(*) AS n FROM f t JOIN f s ON s.o_custkey = t.o_custkey AND abs(s.m - t.m) <= 2000 AND (s.o_orderkey, s.l_linenumber) > (t.o_orderkey, t.l_linenumber) GROUP BY 1, 2),
g AS (SELECT f.*, w.w FROM f JOIN w ON pm BETWEEN a AND b),
x AS (SELECT t.o_orderkey, t.l_linenumber, count(*) AS n FROM f t JOIN h USING (o_orderkey) JOIN g s ON s.w = h.w AND s.m > t.m - 2000 AND s.m < t.m + 2000 WHERE s.o_custkey <> t.o_custkey GROUP BY 1, 2)
SELECT f.o_custkey, f.o_orderkey, f.l_linenumber, coalesce(o.n, 0) AS own_links, coalesce(x.n, 0) AS other_links FROM f LEFT JOIN o USING (o_orderkey, l_linenumber) LEFT JOIN x USING (o_orderkey, l_linenumber)""",
    "similar_pairs": "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x * 10::FLOAT)::BIGINT) AS p FROM embeddings) SELECT a.vec_id, b.vec_id AS vec_id_b, len(list_distinct(list_intersect(a.p, b.p)))::BIGINT AS overlap FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id AND b.vec_id - a.vec_id <= 2",
    "collision_band": "SELECT a.p_size, sum((abs(a.p_retailprice - b.p_retailprice) <= 5)::INT)::BIGINT AS within_5, count(*) AS within_10 FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 10 GROUP BY 1",
    "data_with_sums": "WITH l AS (SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem WHERE l_quantity >= 45 GROUP BY 1) SELECT o_orderkey, quantity, CASE WHEN quantity IS NULL AND o_orderstatus = 'O' THEN 4 WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END::INT AS status FROM orders LEFT JOIN l ON l_orderkey = o_orderkey",
    "dims_and_counts": "SELECT n_name, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation LEFT JOIN region ON r_regionkey = n_regionkey",
    "group_first_page": "SELECT p_brand, min(p_partkey) AS first_key, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1 ORDER BY 1 LIMIT 5 OFFSET 5",
    "distinct_counts": "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_partkey, l_suppkey)) AS pairs, count(*) AS n FROM lineitem",
    "hit_counts": "SELECT sum((k >= 500)::INT)::BIGINT AS hit, count(*) AS suppliers, sum(k)::BIGINT AS pairs FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY 1)",
    "hist_equal": f"WITH b AS (SELECT trunc(trunc(min(p_retailprice)) / 100) * 100 AS a, (trunc(trunc(max(p_retailprice)) / 100) + 1) * 100 AS z FROM part), s AS (SELECT i, a + i * (z - a) / 20 AS lo, a + (i + 1) * (z - a) / 20 AS hi FROM b, range(20) q(i)) SELECT i::INT AS bin, {f4('lo')} AS lo, {f4('hi')} AS hi, (SELECT count(*) FROM part WHERE p_retailprice > lo AND p_retailprice <= hi) AS n FROM s",
    "hist_uneven": "WITH b(bin, lo) AS (VALUES " + ", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(FDR_BINS)) + "), c AS (SELECT bin, lo, lead(lo) OVER (ORDER BY bin) AS hi FROM b) SELECT bin::INT AS bin, lo, (SELECT count(*) FROM lineitem WHERE l_discount >= lo AND (hi IS NULL OR l_discount < hi)) AS n FROM c",
    "argmax_group": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem WHERE l_quantity >= 5) WHERE k = 1",
    "mode_then_max": "SELECT l_partkey, l_suppkey, n, top FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS k FROM (SELECT l_partkey, l_suppkey, count(*) AS n, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2)) WHERE k = 1",
    "cross_run_merge": f"SELECT l_partkey, {f4('avg(v)')} AS intensity, count(*) AS effect_num FROM (SELECT l_partkey, l_returnflag, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "merge_summary": f"SELECT sum((e = 1)::INT)::BIGINT AS hit1, sum((e = 2)::INT)::BIGINT AS hit2, sum((e = 3)::INT)::BIGINT AS hit3, count(*) AS items, {f4('1 - sum(e) / (3.0::DOUBLE * count(*))')} AS missing_ratio FROM (SELECT l_partkey, count(DISTINCT l_returnflag) AS e FROM lineitem WHERE l_quantity >= 30 GROUP BY 1)",
    "fold_change": f"WITH {_FOLDS} SELECT l_partkey, species, {f4('x')} AS x, {f4('y')} AS y FROM g",
    "fold_stats": f"WITH {_FOLDS} SELECT species, count(*) AS n, {f4('avg(y)')} AS mean, {f4('stddev_samp(y)')} AS sd FROM g GROUP BY 1",
    "legacy_percentile": f"WITH a AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT l_returnflag, v, n, i AS pct, least(greatest(i / 100.0::DOUBLE * (n + 1), 1.0), n) AS pos FROM a, range(1, 100) q(i)) SELECT l_returnflag, pct::INT AS pct, {f4('v[floor(pos)::INT] + (pos - floor(pos)) * (v[ceil(pos)::INT] - v[floor(pos)::INT])')} AS value FROM p",
    "ion_cv": f"SELECT p_brand, {f4('stddev_samp(p_retailprice) / avg(p_retailprice)', 6)} AS cv, count(*) AS n FROM part WHERE p_retailprice > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6",
    "unique_keys": "SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1",
    "min_decoy_score": "SELECT l_returnflag, coalesce(min(l_extendedprice) FILTER (l_linestatus = 'O' AND l_quantity > 10), -9999.0) AS least FROM lineitem GROUP BY 1",
    "group_lists": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY 1",
    "smooth_gauss5": _smooth("gauss"),
    "smooth_sg5": _smooth("savitzky_golay"),
    "smooth_linear": _smooth("linear"),
    "local_maxima": f"WITH {_HOURLY}, w AS (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS b FROM v WINDOW o AS (PARTITION BY event_type ORDER BY hour)) SELECT event_type, hour, {f4('v')} AS v FROM w WHERE v > a AND v > b AND a >= 1e-6 AND b >= 1e-6",
    "lib_similarity": f"""WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, abs(unnest(embedding)::DOUBLE) AS r FROM embeddings),
l AS (SELECT label, i, avg(r) AS l FROM e GROUP BY 1, 2), x AS (SELECT vec_id, r, l FROM e JOIN l USING (label, i)),
t AS (SELECT vec_id, sum(r) AS sr, sum(l) AS sl, sum(sqrt(r)) AS qr, sum(sqrt(l)) AS ql, sum(r * r) AS rr, sum(l * l) AS ll, sum(r * l) AS rl, count(*) AS n, sum(sqrt(r * l)) AS dp, max(r / l) AS hi, min(r / l) AS lo FROM x GROUP BY 1),
d AS (SELECT vec_id, avg(abs(r / sr - l / sl)) AS rsmd, sqrt(avg((r / sr - l / sl) ** 2)) AS avg_sqr, sum(abs(sqrt(r) / qr - sqrt(l) / ql)) AS manhattan FROM x JOIN t USING (vec_id) GROUP BY 1)
SELECT vec_id, {f4('dp / sqrt(sr * sl)')} AS dotprod, {f4('acos(least(1.0, rl / sqrt(rr * ll)))')} AS sangle, {f4('rsmd')} AS rsmd, {f4('avg_sqr')} AS avg_sqr, {f4('manhattan')} AS manhattan, {f4('(hi - lo) / hi')} AS int_shift,
{f4('CASE WHEN rr - sr * sr / n > 1e-6 AND ll - sl * sl / n > 1e-6 THEN (rl - sr * sl / n) / sqrt((rr - sr * sr / n) * (ll - sl * sl / n)) ELSE 0 END')} AS pearson FROM t JOIN d USING (vec_id)""",
    "rt_fit": f"SELECT l_returnflag, {f4('regr_slope(l_extendedprice, l_quantity)')} AS slope, {f4('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, {f4('regr_r2(l_extendedprice, l_quantity)')} AS r2, count(*) AS n FROM lineitem GROUP BY 1",
    "rt_residuals": f"WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS k, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1) SELECT l_returnflag, {f4('avg(abs(l_extendedprice - k * l_quantity - b))', 2)} AS mean_abs, {f4('max(abs(l_extendedprice - k * l_quantity - b))', 2)} AS largest FROM lineitem JOIN f USING (l_returnflag) GROUP BY 1",
    "weighted_score": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {f4('0.0::DOUBLE + 0.5::DOUBLE * coalesce(l_quantity, 0) + -2.0::DOUBLE * coalesce(l_discount, 0) + 4.0::DOUBLE * coalesce(l_tax, 0) + 0.001::DOUBLE * coalesce(l_extendedprice, 0)')} AS score FROM lineitem",
    "string_ops": f"""SELECT p_partkey, regexp_replace(replace(p_name, ' ', '(UniMod:4)') || '(x)', '\\([^)]*\\)', '', 'g') AS stripped,
array_to_string(list_distinct_in_order, ',') AS proteins, p_size::BIGINT AS charge, lower(replace(p_type, ' ', '')) AS header, p_type AS organism, {f4('same / length(p_name)')} AS identity
FROM (SELECT *, list_filter(string_split(p_type, ' '), lambda x, i: list_position(string_split(p_type, ' '), x) = i) AS list_distinct_in_order,
  (SELECT count(*) FROM range(1, length(p_name) + 1) q(i) WHERE substr(p_name, i, 1) = substr(reverse(p_name), i, 1)) AS same FROM part)""",
    "digest": "WITH p AS (SELECT DISTINCT doc_id, unnest(string_split(replace(replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'K', 'K|'), 'R', 'R|'), '|')) AS peptide FROM documents) SELECT peptide FROM p WHERE length(peptide) BETWEEN 5 AND 30 GROUP BY 1 HAVING count(DISTINCT doc_id) = 1",
    "mass_of_text": "SELECT doc_id, " + f4(" + ".join(["0.0::DOUBLE"] + [f"(length(text) - length(replace(replace(text, '{c}', ''), '{c.lower()}', ''))) * {m}::DOUBLE" for c, m in RESIDUES.items()]), 2) + " AS mass FROM documents",
    "peptide_mass": f"WITH s AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS s FROM part), l AS (SELECT p_partkey, unnest(string_split(s, '')) AS c FROM s), w AS (SELECT p_partkey, sum(coalesce(m, 0)) AS w FROM l LEFT JOIN {_MASS} USING (c) GROUP BY 1) SELECT p_partkey, {f4(f'(w + {ENDS["full"]}::DOUBLE + 2 * {H}::DOUBLE) / 2')} AS mz2, {f4(f'w + {ENDS["y"]}::DOUBLE + {H}::DOUBLE')} AS y1, translate(s[1], '{SWAP_FROM}', '{SWAP_TO}') || s[2:-2] || translate(s[-1], '{SWAP_FROM}', '{SWAP_TO}') AS decoy FROM s JOIN w USING (p_partkey)",
    "kv_json": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract(props, '$.k')::DOUBLE AS kv FROM events",
    "set_ops": """WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier), few AS (SELECT k FROM c WHERE k < 12)
SELECT k, count(*) AS n, 'union_all' AS op FROM (SELECT k FROM c UNION ALL SELECT k FROM s) GROUP BY 1 UNION ALL
SELECT k, count(*), 'union' FROM (SELECT k FROM few UNION SELECT k FROM s) GROUP BY 1 UNION ALL SELECT k, count(*), 'intersect' FROM (SELECT k FROM few INTERSECT SELECT k FROM s) GROUP BY 1 UNION ALL
SELECT k, count(*), 'except_all' FROM (SELECT k FROM s EXCEPT ALL SELECT k FROM few) GROUP BY 1 UNION ALL SELECT k, count(*), 'except' FROM (SELECT k FROM s EXCEPT SELECT k FROM few) GROUP BY 1""",
    "sort_rank": "SELECT s_suppkey, row_number() OVER w AS rn, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS dr, ntile(2) OVER w AS half, max(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)",
    "running_total": "SELECT o_orderkey, sum(c) OVER (ORDER BY o_orderkey)::BIGINT AS total_cents FROM (SELECT o_orderkey, sum(round(o_totalprice * 100)::BIGINT) AS c FROM orders GROUP BY 1)",
    "alias_ordinals": "SELECT s_suppkey, 'run-' || row_number() OVER w AS alias, row_number() OVER w = 1 AS is_default FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)",
    "overview_statistics": f"WITH {_RES}, a AS (SELECT run_id, count(*) AS peptides, sum(is_unique::INT)::BIGINT AS unique_peptides FROM ok GROUP BY 1), p AS (SELECT run_id, protein, count(*) AS n FROM ok GROUP BY 1, 2), b AS (SELECT run_id, count(*) AS proteins, sum((n >= 20)::INT)::BIGINT AS hit_proteins FROM p GROUP BY 1) SELECT run_id AS overview_id, peptides, unique_peptides, proteins, hit_proteins FROM a LEFT JOIN b USING (run_id)",
    "run_report": f"WITH {_RES} SELECT p_brand AS protein, p_partkey::VARCHAR AS peptide_ref, " + ", ".join(f"{f4(f'coalesce(sum(v) FILTER (run_id = {chr(39)}{r}{chr(39)}), 0)', 2)} AS \"{r}\"" for r in "ANR") + " FROM part LEFT JOIN ok ON l_partkey = p_partkey GROUP BY 1, 2",
    "group_merge": f"WITH {_RES} SELECT protein || '-->' || peptide_ref AS item, {f4('avg(v)', 2)} AS intensity, count(*) AS effect_num FROM ok WHERE is_unique AND run_id IN ('A', 'R') GROUP BY 1",
    "rt_pairs": f"WITH {_RES} SELECT run_id, peptide_ref, q AS x, {f4("q - CASE run_id WHEN 'A' THEN (p_size - 1) / 2.0 WHEN 'N' THEN p_size / 4.0 ELSE p_size END")} AS y FROM ok JOIN part ON p_partkey = l_partkey",
    "ambiguous_top2": f"WITH {_RES}, r AS (SELECT peptide_ref, total_score, row_number() OVER (PARTITION BY peptide_ref ORDER BY total_score DESC, run_id) AS n FROM k WHERE total_score > 0.05) SELECT a.peptide_ref FROM r a JOIN r b ON a.peptide_ref = b.peptide_ref AND a.n = 1 AND b.n = 2 WHERE a.total_score - b.total_score < 0.5",
    "old_new_diff": "WITH r AS (SELECT DISTINCT l_partkey, l_linestatus AS s FROM lineitem WHERE l_quantity = 7) SELECT l_partkey, CASE WHEN min(s) = 'F' THEN 'old' ELSE 'new' END AS side FROM r WHERE s IN ('F', 'O') GROUP BY 1 HAVING count(*) = 1",
    "prefix_filter": "SELECT p_partkey FROM part WHERE NOT starts_with(p_name, 's')",
    "neighbour_windows": "SELECT i::BIGINT AS window_id, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, p_retailprice + k * 10.0 AS v FROM part, (VALUES (-1), (0), (1)) q(k)) JOIN range(10) w(i) ON v >= 900 + 10 * i AND v < 910 + 10 * i GROUP BY 1",
    "identifier_links": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'https://www.uniprot.org/uniprot/' || s_suppkey END AS uniprot_link FROM supplier",
    "fragments_of_text": f"""WITH s AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS s FROM part), i AS (SELECT *, unnest(range(1, length(s))) AS n FROM s),
l AS (SELECT p_partkey, s, i, coalesce(m, 0) AS m FROM (SELECT p_partkey, s, unnest(range(1, length(s) + 1)) AS i FROM s) LEFT JOIN {_MASS} ON c = s[i]),
b AS (SELECT p_partkey, i, sum(m) OVER (PARTITION BY p_partkey ORDER BY i) AS pre, sum(m) OVER (PARTITION BY p_partkey ORDER BY i DESC) AS suf, length(s) AS len FROM l),
f AS (SELECT 'b' || i AS name, pre + {ENDS["b"]}::DOUBLE AS w FROM b WHERE i < len UNION ALL SELECT 'y' || (len - i + 1), suf + {ENDS["y"]}::DOUBLE FROM b WHERE i > 1),
z AS (SELECT CASE WHEN z = 1 THEN name ELSE name || '^2' END AS cut_info, (w + z * {H}::DOUBLE) / z AS mz FROM f, (VALUES (1), (2)) q(z))
SELECT cut_info, count(*) AS n, {f4("sum(round(mz, 6)::DECIMAL(20, 6))::DOUBLE", 2)} AS mz FROM z GROUP BY 1""",
}
