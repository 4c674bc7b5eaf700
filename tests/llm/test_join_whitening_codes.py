import hashlib
import random

import duckdb
import numpy as np
import pytest

from ionflow.llm import ngram_join as J
from ionflow.llm import queries as Q
from ionflow.llm import vector_codes as V
from ionflow.llm import whitening as W
from ionflow.llm.common import whole_vectors

SF = "/root/testdata/sf0.001"


# n-gram join --------------------------------------------------------------------------------------


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out


def plain_join(rows, shingle=4, percent=85):
    """Every pair, by Python's sets: (doc_id, set size, smallest reachable id)."""
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    lowest = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(sets[i]), lowest[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def joined(df, **options):
    return sorted([tuple(r) for r in J.similar(df, **options).select("doc_id", "n_shingles", "component_id").collect()], key=str)


def variants(n, seed=3):
    """Texts around the limit of similarity: scattered edits, blocks added and cut, subsets, chains and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for k in range(n):
        base = [word() for _ in range(rng.choice([3, 4, 6, 9, 10, 25, 60, 120, 400]))]
        if k % 3 == 0:
            base = base[: len(base) // 3] + passage + base[len(base) // 3 :]
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = word()
            cut = rng.randrange(0, 1 + len(t) // 8)
            t = t[cut:] if rng.random() < 0.5 else t + [word() for _ in range(cut)]
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    return rows


def test_ngram_join_finds_all_links(spark):
    rows = variants(60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_join(rows)
    assert len({r[2] for r in want}) < len(rows) - 60
    assert joined(df) == want
    assert joined(df, block=4) == want  # wide tiles and groups
    assert joined(df, percent=60, shingle=2) == plain_join(rows, 2, 60)


def test_ngram_join_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(90, "one two three"), (91, "ONE  two\nthree"), (92, "one two three four"), (93, ""), (None, "one two three"), (None, "only here and there")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df) == plain_join(rows)
    assert joined(odd) == plain_join(rows[:-6])
    assert joined(none) == []


def test_common_shingles_only_order(spark):
    rows = variants(20, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    values, rank = J.common_shingles(df.select("text"), 4, least=2, most=50)
    assert len(values) == 50 and (np.diff(values.astype(object)) > 0).all() and sorted(rank) == list(range(1, 51))
    grams = np.sort(np.concatenate([values[:5], np.array([1, 2, 3], np.uint64)]))
    assert set(J.prefix(grams, 85, (values, rank)).tolist()) == {1, 2}
    assert len(J.prefix(np.arange(100, dtype=np.uint64), 85, (values[:0], rank[:0]))) == 16


def test_bitmaps_bound_overlaps():
    rng = np.random.default_rng(2)
    for n in (1, 7, 40, 300):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n, np.uint64)]))
        sign = [np.frombuffer(J.bitmap(x), np.uint64) for x in (a, b)]
        width = min(map(len, sign))
        x, y = (np.bitwise_or.reduce(s.reshape(-1, width)) for s in sign)
        bound = J.overlap_bound(x, len(a), y[None], len(b))[0]
        assert len(np.intersect1d(a, b)) <= bound < max(len(a), len(b)) + (n < 3)


def test_ngram_join_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in Q.op11_ngram_join(spark, SF).collect()], key=str) == plain_join(rows)


# Whitening ----------------------------------------------------------------------------------------


def plain_whitening(x, scale=256):
    """(n, S, covariance) of the distinct rows, formed outright."""
    fit = np.unique(np.floor(x * scale).astype(np.int64), axis=0)
    c = fit - fit.mean(axis=0)
    return len(fit), fit.sum(axis=0), c.T @ c / len(fit)


def check_whitening(found, ids, x, scale=256):
    n, s, cov = plain_whitening(x, scale)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(4, int((values > 1e-13 * max(values[0], 0)).sum())) if values[0] > 0 else 0
    assert len(found) == k * len(ids)
    whole = np.floor(x * scale).astype(np.int64)
    by = {}
    for r in found:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    sample = {}
    for c in by:
        want = (whole - s / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        rows = [by[c][i].pop() for i in ids]
        got = np.array([r["whitened"] for r in rows])
        sample[c] = got
        gap = min(abs(values[c - 1] - values[j]) for j in range(len(values)) if j != c - 1) if len(values) > 1 else values[0]
        if gap > 1e-6 * values[0]:
            sign = np.sign(got @ want)
            assert np.allclose(got * sign, want, atol=1e-9 * values[0] / gap)
        for i, r in zip(range(len(ids)), rows, strict=True):
            assert r["n"] == n and r["deviation"] == int(((n * whole[i].astype(object) - s.astype(object)) ** 2).sum())
            assert abs(r["explained"] - values[c - 1] / np.trace(cov)) <= 1e-9 and r["identity_error"] <= 1e-9


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    check_whitening(Q.op12_lanczos_whitening(spark, SF).collect(), [r["vec_id"] for r in rows], x)


def test_whitening_restarts_and_equal_values(spark):
    rng = np.random.default_rng(4)
    # All values are equal, so the first block is an invariant space and the next one must be fresh.
    x = np.zeros((20, 10))
    for i in range(10):
        x[2 * i, i], x[2 * i + 1, i] = 3, -3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    distinct = whole_vectors(df, 1, "vec_id", "embedding").select("x").distinct()
    model = W.fit(distinct, components=4, block=4)
    assert model.breakdowns >= 1 and np.allclose(model.values, 0.9) and np.allclose(model.vectors.T @ model.vectors, np.eye(4))
    assert W.identity_error(distinct, model) < 1e-12
    # A long table with a steep spectrum ends before the basis is full.
    y = rng.standard_normal((400, 60)) * 1e6 * 0.3 ** np.minimum(np.arange(60), 9)[None]
    steep = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>").repartition(5)
    model = W.fit(whole_vectors(steep, 1, "vec_id", "embedding").select("x").distinct(), 4)
    assert model.passes < 8 and model.residual <= 1e-11
    assert np.allclose(model.values, np.linalg.eigvalsh(plain_whitening(y, 1)[2])[::-1][:4], rtol=1e-9)


def test_whitening_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, component int, n string"
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [1.5, -1.0]), (None, [2.0, 0.25]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (9, [3e38, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], schema)
    found = W.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r["n"] for r in found} == {3}
    check_whitening([r for r in found if r["vec_id"] == 2 or r["vec_id"] is None or r["vec_id"] == 1], [1, 1, 2, None], np.array([[0.5, 1.0], [0.5, 1.0], [1.5, -1.0], [2.0, 0.25]]))
    assert W.whiten(df.where("vec_id = 1")).collect() == [] == W.whiten(df.where("vec_id > 2")).collect()
    big = spark.createDataFrame([(1, [1e13, 2.0], 1, "n"), (2, [-3e13, 1.0], 1, "n")], schema.replace("float", "double"))
    assert {r["deviation"] for r in W.whiten(big).collect()} == {None}


# Codes --------------------------------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Lloyd with every distance, in Python's whole numbers: rows (vec_id, x, label) -> (vec_id, code, error, label_error, sha)."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[list(cut(r[1], p)) for r in order[:entries]] for p in range(parts)]

    def nearest(y, book):
        return min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(cut(r[1], p), books[p])[1] for r in rows]
            for e in range(len(books[p])):
                own = [cut(r[1], p) for r, a in zip(rows, at, strict=True) if a == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    best = [[nearest(cut(r[1], p), books[p]) for p in range(parts)] for r in rows]
    errors = [sum(d for d, _ in b) for b in best]
    total = {}
    for r, e in zip(rows, errors, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted(((r[0], [e for _, e in b], err, total[r[2]], sha) for r, b, err in zip(rows, best, errors, strict=True)), key=str)


def coded(df, **options):
    return sorted([(r["vec_id"], list(r["code"]), r["error"], r["label_error"], r["codebooks_sha256"]) for r in V.compress(df, **options).collect()], key=str)


@pytest.mark.parametrize(("spread", "entries"), [(3, 8), (40, 16), (1e5, 12), (1e8, 12)])
def test_codes_equal_plain_lloyd(spark, spread, entries):
    rng = np.random.default_rng(int(spread))
    x = rng.integers(-spread, spread + 1, (300, 8)) + (rng.integers(0, 4, (300, 1)) * int(2 * spread))
    rows = [(i, v, int(i) % 3 if i % 7 else None) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame([(i, [float(c) for c in v], k) for i, v, k in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    assert coded(df, entries=entries, scale=1) == plain_codes(rows, entries=entries)


def test_bounds_prune_but_never_decide():
    rng = np.random.default_rng(1)
    x = rng.integers(-9, 10, (500, 4)) + rng.integers(0, 5, (500, 1)) * 40
    last, entries = x[:20].copy(), x[:20] + rng.integers(-2, 3, (20, 4))
    code, _, upper, lower = V.assign_all(x, V.Codebook(last[None]), 0)
    new, exact, up, low, computed = V.assign_again(x, V.Codebook(entries[None], last[None]), 0, code, upper, lower)
    d = V.distances(x, entries)
    assert (new == d.argmin(axis=1)).all() and computed < d.size / 2
    assert (up >= np.sqrt(d.min(axis=1))).all() and (low <= np.sqrt(d)).all()
    assert ((exact < 0) | (exact == d.min(axis=1))).all()


def test_codes_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, error string"
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 1), (5, [1.0, 2.0, 3.0, 4.0], 1), (5, [0.0, 2.0, 3.0, 4.0], None), (None, [9.0, 9.0, 9.0, 9.0], None), (7, None, 1), (8, [float("nan"), 1.0, 1.0, 1.0], 1), (9, [None, 1.0, 1.0, 1.0], 1), (1, [float("-inf"), 1.0, 1.0, 1.0], 1), (2, [], 2), (3, [-0.0, -0.00001, 1e-9, 0.5], 2)]
    df = spark.createDataFrame([(*r, "c", "e") for r in rows], schema)
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int).tolist(), k) for i, v, k in rows if i not in (7, 8, 9, 1, 2)]
    assert coded(df) == plain_codes(kept)
    assert coded(df, entries=2, rounds=1) == plain_codes(kept, entries=2, rounds=1)
    assert coded(df.where("false")) == []
    with pytest.raises(ValueError, match="cut into"):
        V.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], "vec_id long, embedding array<double>, label int"))


def test_codes_prune_on_the_tables(spark):
    stats = []
    V.compress(spark.read.parquet(f"{SF}/embeddings.parquet"), entries=32, stats=stats)
    assert len(stats) == 5 and max(stats[1:]) < stats[0]


# DuckDB -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "table"), [("op11_ngram_join", "documents"), ("op13_elkan_codes", "embeddings")])
def test_query_matches_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, rel = Q.QUERIES[name](spark, SF), con.sql(Q.SQL[name])
    want = sorted(str([str(dict(zip(rel.columns, r, strict=True))[c]) for c in df.columns]) for r in rel.fetchall())
    assert sorted(str([str(v) for v in r]) for r in df.collect()) == want
