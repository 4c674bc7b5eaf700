import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ionflow.llm import mixture_packing, queries, tree_bpe

NAME = "word_bpe_49k.json"
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tree_bpe.tokenizer_path(NAME))


@pytest.mark.parametrize("name", [NAME, "byte_bpe_50k.json"])
def test_trees_are_exact(name):
    library = Tokenizer.from_file(tree_bpe.tokenizer_path(name))
    rng = random.Random(1)
    for k in range(150):
        bpe = tree_bpe.load(name, 16 if k % 2 else 64)
        alphabet = rng.choice(["abcdefghijklmnopqrstuvwxyz", "ab", "aé", "!?#", "a!b1", "ÀÉİßΣ", "a  \x1c \u0085b.,'s\t\n"])
        t = "".join(rng.choice(alphabet) for _ in range(rng.choice([17, 65, 128, 129, 1000, 4000])))
        if k % 3 == 0:
            t += " <|endoftext|> x" + t[:70] + "<|endoftext|>" + t
        want = library.encode(t, add_special_tokens=False).ids
        ids, bounds, decoded, trees = bpe.encode_all(pa.array([None, t, ""]), True)
        assert ids.tolist() == want and bounds.tolist() == [0, 0, len(want), len(want)]
        assert decoded.to_pylist() == ["", library.decode(want, skip_special_tokens=False), ""]
        assert trees.tolist() == [0, sum(len(run) > bpe.leaf for _, run in bpe.runs(t)), 0]
        rows = [(i, p[0], p[3] if p[3] is not None else bpe.encode_piece(p[1], p[2])) for i, p in enumerate(bpe.pieces(t, 50))]
        assert bpe.assemble(rows) == want
        assert (max((len(r) for _, r in bpe.runs(t)), default=0) > 50) == any(r >= 0 for _, r, _ in rows)


@pytest.mark.parametrize("name", [NAME, "byte_bpe_50k.json"])
def test_round_trip(spark, odd, none, name):
    library = Tokenizer.from_file(tree_bpe.tokenizer_path(name))
    rows = tree_bpe.round_trip(odd, name, leaf=16, spread=256).collect()
    texts = sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    assert len(rows) == len(texts)
    want = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in texts)
    assert sorted((r.doc_id or -1, list(r.ids)) for r in rows) == want
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in rows)
    assert {r.doc_id: r.trees for r in rows}[6] == 1
    assert tree_bpe.round_trip(none, name).count() == 0


def test_round_trip_query(spark, tmp_path, library):
    rng = random.Random(8)
    texts = [None, "", "x" * 70_000 + " end", *(" ".join("".join(rng.choice("abcdeéĀ19-") for _ in range(rng.randrange(1, 60))) for _ in range(30)) for _ in range(40))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op9_tree_bpe(spark, f"file://{tmp_path}").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        bpe = tree_bpe.load(NAME, queries.LEAF)
        assert rows[i].trees == sum(len(run) > bpe.leaf for c in (t or "").split() if len(c) > bpe.leaf for _, run in bpe.runs(c))
    assert sum(r.trees > 0 for r in rows.values()) > 5


def check_pieces(pieces, want, seq_len):
    """Every id in one piece, sequences gapless and short enough, padding none."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert sum(len(p.ids) // 4 for p in pieces) == sum(map(len, want))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length * 4 == len(p.ids) > 0
            at += p.length
        assert at <= seq_len and (at == seq_len or at & (at - 1) == 0)
    return by_doc


def test_packing(spark, odd, none, library):
    whole = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in whole.collect()}
    pieces = mixture_packing.pack(whole, NAME, seq_len=64).collect()
    by_doc = check_pieces(pieces, want.values(), 64)
    for i, ids in want.items():
        got = b"".join(p.ids for p in sorted(by_doc[i], key=lambda p: p.start))
        assert got == np.array(ids, "<u4").tobytes() and {p.doc_tokens for p in by_doc[i]} == {len(ids)}
        assert zlib.crc32(got) == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert mixture_packing.pack(odd, NAME).groupBy().sum("length").first()[0] > sum(map(len, want.values()))
    assert mixture_packing.pack(none, NAME).count() == 0


def test_mixture(spark):
    rows = [(i, f"word{i} " * (30 + i % 7), "abc"[i % 3] if i % 5 else "rare") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}

    def shares(**how):
        pieces = mixture_packing.pack(df, NAME, seq_len=128, **how).collect()
        out = defaultdict(lambda: defaultdict(int))
        for p in pieces:
            out[p.sequence_id][source[p.doc_id]] += p.length
        return out

    by_target = shares(targets={"a": 0.6, "b": 0.2})
    for s in range(30):  # the others share what is left
        assert abs(by_target[s]["a"] - 0.6 * 128) <= 2 and abs(by_target[s]["b"] - 0.2 * 128) <= 2
    equal = shares(power=0)
    assert all(abs(equal[s][x] - 32) <= 1 for s in range(20) for x in ("a", "b", "c", "rare"))
    own = shares(power=1)
    size = defaultdict(int)
    for s in own.values():
        for x, n in s.items():
            size[x] += n
    assert all(abs(n - 128 * size[x] / sum(size.values())) <= 2 for s in range(len(own) - 8) for x, n in own[s].items())


def test_many_sources(spark):
    """Each large source has a queue of its own; the small ones share one."""
    rows = [(i, "some words here " * 9, f"s{i}" if i % 2 else f"big{i % 6}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    pieces = mixture_packing.pack(df, NAME, seq_len=128, queues=10).collect()
    check_pieces(pieces, [[0] * p.doc_tokens for p in pieces if not p.start], 128)
    source = {i: s for i, _, s in rows}
    by_queue = defaultdict(set)
    for p in pieces:
        by_queue[p.queue].add(source[p.doc_id])
    assert sorted(map(len, by_queue.values())) == [1, 1, 1, 300]


def test_plan_is_deficit_round_robin():
    rng = random.Random(5)
    for _ in range(60):
        totals = {k: rng.randrange(0, 5000) for k in rng.sample(range(20), rng.randrange(1, 9))}
        weights = {k: rng.choice([rng.randrange(1, 100), rng.random() * 1e-4]) for k in totals}
        plan = mixture_packing.MixturePlan(totals, weights, 64)
        seen = np.zeros(sum(totals.values()), bool)
        for k, n in totals.items():  # each queue in uneven stretches, as documents are
            cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(20))})
            first, size = np.array(cuts[:-1], np.int64), np.diff(cuts)
            row, start, length, sequence, offset = plan.cut(np.full(len(first), k), first, size) if n else [np.zeros(0, np.int64)] * 5
            assert np.array_equal(np.bincount(row, length, len(first)).astype(np.int64), size) or not n
            whole = len(seen) // 64
            begin = np.concatenate([np.arange(whole) * 64, plan.tail])
            for s, o, m in zip(sequence, offset, length, strict=True):
                assert not seen[begin[s] + o : begin[s] + o + m].any() and begin[s] + o + m <= begin[s + 1]
                seen[begin[s] + o : begin[s] + o + m] = True
        assert seen.all()
        # Against the round written out token by token: the queue whose next token is due first gives it.
        order, given, left = [], dict.fromkeys(plan.queues.tolist(), 0), dict(zip(plan.queues.tolist(), plan.totals.tolist(), strict=True))
        for p in range(len(plan.starts)):
            end = plan.starts[p + 1] if p + 1 < len(plan.starts) else plan.total
            rate = dict(zip(plan.queues.tolist(), plan.rates[p].tolist(), strict=True))
            y = dict.fromkeys(given, 0)
            for _ in range(int(end - plan.starts[p])):
                k = min((q for q in given if rate[q]), key=lambda q: (((2 * y[q] + 1) << 31) // (2 * rate[q]), q))
                assert given[k] < left[k]
                y[k] += 1
                given[k] += 1
                order.append(k)
            assert any(given[q] == left[q] for q in given if rate[q])
        at = np.arange(0, plan.total + 1, 37)
        want = np.array([[order[:x].count(q) for q in plan.queues.tolist()] for x in at.tolist()]).reshape(len(at), -1)
        assert np.array_equal(plan.given(at), want) or not plan.total


def test_packing_query(spark, tmp_path, library):
    rows = [(i, "one two three " * (i * 7 % 90) if i % 9 else None, f"src{i % 4}" if i % 5 else None) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    pieces = queries.op4_mixture_packing(spark, f"file://{tmp_path}").collect()
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    for p in pieces:
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for i, ids in want.items():
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) == len(ids)
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append((p.offset, p.length))
    for s in by_seq.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()] and sum(n for _, n in s) <= 2048
