import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash

from ionflow.llm import covering_simhash as C
from ionflow.llm import piecewise_hash as P
from ionflow.llm import queries


def plain_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(marks, radius):
    ids = sorted(marks)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (marks[a] ^ marks[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_masks_cover():
    masks, rng = C.covering_masks(4), random.Random(2)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5)))
        assert any(not m & flips for m in masks)


def test_components_match_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(1, 7))) for b in base for _ in range(6)] + [0, 0]
    marks = dict(enumerate(fps))
    for kwargs in ({}, {"block": 16}, {"wide": 8}):
        df = spark.createDataFrame([(C._signed(x),) for x in set(fps)], "fp long")
        found = {r.node: r.root for r in C.components(C.links(df, 4, **kwargs)).collect()}
        want = plain_components({C._signed(x): x for x in marks.values()}, 4)
        assert {k: found.get(k, k) for k in want} == {k: want[k] for k in want}


def test_near_duplicates(spark, odd, none):
    docs = odd.where("doc_id IS NOT NULL")
    rows = C.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {i: plain_simhash(t) for i, t in texts.items()}
    assert len(rows) == docs.count() and all(r.fp % (1 << 64) == marks[r.doc_id] for r in rows)
    assert {r.doc_id: r.component_id for r in rows} == plain_components(marks, 4)
    assert C.near_duplicates(none).count() == 0 and C.near_duplicates(odd).count() == odd.count()


def test_keep_one(spark, odd, none):
    words = [f"w{i}" for i in range(4000)]
    rng = random.Random(8)
    docs, groups = [], {}
    for g in range(12):
        t = rng.sample(words, 200)
        for c in range(4):
            u = t[:]
            if c:
                u[rng.randrange(200)] = "changed"  # similarity about 0.95
            groups[len(docs)] = g
            docs.append((len(docs), " ".join(u)))
    docs += [(100 + i, " ".join(rng.sample(words, 150))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(r.doc_id for r in C.keep_one(df).collect())
    assert kept == [4 * g for g in range(12)] + [100 + i for i in range(20)]
    kept = C.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and None not in ids and 1 not in ids  # rows without an id are copies of rows with one
    assert C.keep_one(none).count() == 0


def test_keep_one_goes_by_row(spark):
    """Different texts under one id, copies under several, and rows without an id, against every pair."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefgh"}
    close = text["g"].replace("g30", "other")
    rows = [(7, "a"), (7, "b"), (3, "d"), (9, "d"), (9, "e"), (None, "a"), (None, "f"), (None, "f"), (9, "e"), (None, "h"), (5, None), (6, ""), (None, None)]
    data = [(i, text.get(t, t), n) for n, (i, t) in enumerate(rows)] + [(20, close, 100), (4, text["g"], 101), (4, text["g"], 102), (4, close, 103)]
    sets = [frozenset(tuple((t or "").split()[k : k + 5]) for k in range(len((t or "").split()) - 4)) for _, t, _ in data]
    alike = lambda x, y: x == y or (x and y and len(x & y) >= 0.8 * len(x | y))
    root = list(range(len(data)))
    for _ in data:
        root = [min(root[j] for j in range(len(data)) if alike(sets[i], sets[j])) for i in range(len(data))]
    kept = C.keep_one(spark.createDataFrame(data, "doc_id long, text string, n long").repartition(3))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = {}
    for (i, t, _), r in zip(data, root, strict=True):
        want.setdefault(r, []).append((i is None, i or 0, i, t))
    assert len(got) == len(want) == len(set(root))
    for rows_ in want.values():
        least = min(x[:2] for x in rows_)
        assert sum((x[2], x[3]) in got for x in {y for y in rows_ if y[:2] == least}) == 1
    assert not [g for g in got if g[0] is None and g[1] not in (text["f"], text["h"])]


def test_block_edits_are_near_copies(spark):
    rng, fresh = random.Random(5), itertools.count()
    docs, want, far = [], [], []
    for size, edit, share in itertools.product((100, 300, 800), ("append", "truncate", "insert"), (0.05, 0.1, 0.15, 0.2, 0.23, 0.3)):
        for _ in range(6):
            a = [f"w{next(fresh)}" for _ in range(size)]
            block, at = [f"w{next(fresh)}" for _ in range(int(size * share))], rng.randrange(size)
            b = a + block if edit == "append" else a[: size - len(block) * 4 // 5] if edit == "truncate" else a[:at] + block + a[at:]
            x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
            (want if len(x & y) / len(x | y) >= 0.8 else far).append(len(docs))
            docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(b))]
    found = {r.doc_id: r.component_id for r in C.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(want) > 200 and len(far) > 50
    assert [i for i in want if found[i] != found[i + 1]] == []
    assert [i for i in far if found[i] == found[i + 1]] == []


def exact_components(texts, similarity=0.8, n=5):
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if not x and not y or len(x & y) >= similarity * len(x | y) > 0:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("block", [16, 2048])
def test_wide_buckets_of_near_copies(spark, block):
    """A large group of near copies, a crowd that shares a passage, chains and strangers; blocks far smaller than the groups."""
    rng, fresh = random.Random(9), itertools.count()
    new = lambda k: [f"n{next(fresh)}" for _ in range(k)]
    base, passage = new(200), new(120)
    docs = []
    for _ in range(150):  # similar to the base, often not to one another
        t = base[:]
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(200)] = f"n{next(fresh)}"
        docs.append(t)
    docs += [passage + new(rng.randrange(40, 100)) for _ in range(120)]
    chain = new(150)
    for _ in range(40):
        chain = chain[8:] + new(8)
        docs.append(chain)
    docs += [new(80) for _ in range(60)] + [docs[3], docs[3], docs[160], [], []]
    rng.shuffle(docs)
    texts = {i: " ".join(t) for i, t in enumerate(docs)}
    found = C.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=block).collect()
    assert {r.doc_id: r.component_id for r in found} == exact_components(texts)


def test_forest_spans_all_links():
    rng = np.random.default_rng(3)
    for k in range(60):
        n = int(rng.integers(1, 40))
        link = rng.random((n, n)) < rng.choice([0.02, 0.1, 0.5])
        link |= link.T
        first = None if k % 2 else int(rng.integers(0, n + 1))
        label = rng.integers(0, n, n) if k % 3 else None
        edges = C._forest(np.arange(n), lambda i, rows: rows[link[i, rows]], first, label)
        root = list(range(n))

        def merge(pairs, root):
            for a, b in pairs:
                a, b = root[a], root[b]
                root[:] = [a if x == b else x for x in root]
            return root

        same = [] if label is None else [(i, int(np.flatnonzero(label == label[i])[0])) for i in range(n)]
        want = merge([(i, j) for i in range(n) for j in range(n) if link[i, j] and (first is None or min(i, j) < first)] + same, list(range(n)))
        got = merge(edges + same, root)
        assert [want.index(x) for x in want] == [got.index(x) for x in got]
        assert len(edges) == len(set(merge(same, list(range(n))))) - len(set(want))


def test_packed_shingles():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64))
    assert (C.unpacked(C.packed(x)) == x >> np.uint64(24)).all() and len(C.unpacked(C.packed(x[:0]))) == 0


def test_fingerprints(spark, odd, none):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    for n in (20, 300, 3000, 60_000):
        t = " ".join(rng.choice(words) for _ in range(n))
        x = t.split(" ")
        x[n // 2] = "inserted words here"
        near, far = P.fingerprint(" ".join(x)), P.fingerprint(" ".join(rng.choice(words) for _ in range(n)))
        assert P.likeness(P.fingerprint(t), near) > 0.5 > P.likeness(P.fingerprint(t), far)
        assert P.likeness(P.fingerprint(t), P.fingerprint(t)) == 1.0
    assert P.fingerprint(None) == P.fingerprint("") == "3::"
    raw = np.frombuffer(b"hello world, this is a test of stretches" * 50, np.uint8)
    whole = P.rolling(raw, raw[:0])
    assert (np.concatenate([P.rolling(raw[:700], raw[:0]), P.rolling(raw[700:], raw[694:700])]) == whole).all()


def test_common_length():
    def slow(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40))) for _ in "ab")
        assert P.common_length(a, b) == slow(a, b)


def check_next(df, buckets):
    rows = P.with_next(df, buckets=buckets).collect()
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64) * (h >> 63)
    order = sorted((r.doc_id if r.doc_id is not None else -(1 << 63), signed(r.text or ""), r.text or "") for r in df.collect())
    want = []
    for k, (i, _, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][2]
        n = len(t) // 4
        want.append((i, t, t[: len(t) - n] + nxt[:n], P.likeness(P.fingerprint(t), P.fingerprint(nxt))))
    assert sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.text, r.edited, r.near_next) for r in rows) == sorted(want)


def test_next_documents(spark, odd, none):
    for buckets in (1, 3, 8):
        check_next(odd, buckets)
    assert P.with_next(none).count() == 0
    one = P.with_next(odd.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_next_documents_of_hot_ids(spark):
    """Null ids and one id that hold a third of the rows each are dealt to several buckets, in order."""
    rng = random.Random(2)
    rows = [((None, 5, i)[i % 3], " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 30)))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check_next(df, 9)


def test_fingerprint_query(spark, tmp_path):
    rng = random.Random(7)
    rows = [(3 * i, " ".join(rng.choice(["alpha", "beta", "gamma", "éa"]) for _ in range(rng.randrange(0, 200))) if i % 9 else None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_piecewise_hash(spark, f"file://{tmp_path}").collect()}
    assert len(got) == 60
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % 60][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), P.fingerprint(t), P.fingerprint(edited))
        assert r.near_edited == P.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == P.likeness(r.fingerprint, P.fingerprint(nxt))


def test_simhash_query(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(i, " ".join(base[: 300 - i % 3] if i % 2 else [rng.choice(words) for _ in range(i)]) if i % 10 else None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_covering_simhash(spark, f"file://{tmp_path}").collect()}
    marks = {i: C.fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {i: r.component_id for i, r in got.items()} == plain_components(marks, 4)


def byte_by_byte(text):
    """The fingerprint with a hash that is rolled from byte to byte, chunk by chunk."""
    import xxhash

    data = (text or "").encode()
    if not data:
        return "3::"

    def signature(size, most):
        window, mixed, out, chunk = [0] * 7, 0, "", b""
        for c in data:
            window = [*window[1:], c]
            total, weighted = sum(window), sum((i + 1) * w for i, w in enumerate(window))
            mixed = 0
            for w in window:
                mixed = (mixed << 5 ^ w) & 0xFFFFFFFF
            h = (total + weighted + mixed) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            h ^= h >> 13
            chunk += bytes([c])
            if h % size == size - 1 and len(out) < most - 1:
                out, chunk = out + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[xxhash.xxh32_intdigest(chunk) % 64], b""
        if chunk:
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[xxhash.xxh32_intdigest(chunk) % 64]
        return out

    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and len(signature(size, 64)) < 32:
        size //= 2
    return f"{size}:{signature(size, 64)}:{signature(2 * size, 32)}"


def test_fingerprint_byte_by_byte(odd):
    from ionflow.llm import piecewise_hash

    rng = random.Random(12)
    texts = [r.text for r in odd.collect()] + ["".join(rng.choice("abcdeé \n") for _ in range(n)) for n in (1, 6, 7, 8, 60, 500, 4000)] + ["ab" * 3000, "z" * 900, "€" * 50]
    for t in texts:
        assert piecewise_hash.fingerprint(t) == byte_by_byte(t)
