import itertools
import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from ionflow.llm import host_quality, surrogates, tree_bpe

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def shingles(text, n=5):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


@needs_data
def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, step = docs.columns, {}
    for k, (name, stage) in enumerate(C.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        step[name] = docs, spark.read.parquet(path)
        docs = step[name][1]
        assert k == len(C.STAGES) - 1 or docs.columns == columns

    before, after = step["quality"]
    kept = {r.doc_id for r in host_quality.judge(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept

    before, after = step["language"]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert len(gone) <= 0.02 * before.count()

    before, after = step["near_duplicates"]
    texts = {r.doc_id: shingles(r.text) for r in before.collect()}
    left = {r.doc_id for r in after.collect()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    alike = defaultdict(float)
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = texts[a], texts[b]
        j = len(x & y) / len(x | y)
        if j:
            alike[a] = max(alike[a], j)
            alike[b] = max(alike[b], j)
        if j >= 0.8:
            near += 1
            assert not (a in left and b in left)
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert near > 0 and all(i in left for i in texts if alike[i] < 0.6)

    before, after = step["personal_data"]
    old, new = ({r.doc_id: r for r in d.collect()} for d in (before, after))
    assert set(old) == set(new) and any(old[i].text != new[i].text for i in old)
    hidden = {r.text[s:e] for r in old.values() for s, e, _ in surrogates.entities(r.text)}
    assert hidden and not any(h in r.text for h in hidden for r in new.values())
    for i, r in old.items():
        if not surrogates.entities(r.text):
            assert r == new[i]

    before, after = step["packing"]
    library = Tokenizer.from_file(tree_bpe.tokenizer_path(C.TOKENIZER))
    want = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in before.collect()}
    got = defaultdict(list)
    for p in after.collect():
        got[p.doc_id].append(p)
    assert {i: np.frombuffer(b"".join(p.ids for p in sorted(v, key=lambda p: p.start)), "<u4").tolist() for i, v in got.items()} == want


@pytest.mark.parametrize("stage", [n for n, _ in C.STAGES])
def test_odd_rows_pass_every_stage(spark, odd, none, tmp_path, stage):
    names = ["doc_id", "text", "lang", "source", "n_chars", "host", "salt", "m", "fp", "file", "key", "later"]
    run = dict(C.STAGES)[stage]
    for df, name in ((odd, "odd"), (none, "none")):
        path = f"file://{tmp_path}/{name}"
        run(spark, df.select(names), "").write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == names or stage == "packing"
        assert out.count() <= (df.count() if stage != "packing" else 10**9) and (name == "odd" or out.count() == 0)


def test_language_without_labels_keeps_texts(spark):
    """No label outside the fold means that no language can be told, not that documents go."""
    rows = [(i, f"plain words of text number {i}" if i % 5 else ["", None, "123 !"][i % 3], None, "s", 3) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = C.language(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(20) if i % 5}


def test_packing_leaves_little_in_its_workers(spark):
    """Spark keeps Python workers; what the last stage left there came on top of the memory of the next run's first ones."""
    rows = [(i, " ".join(f"word{i * 500 + k}" for k in range(500)), "en", "s", 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(1)

    def held(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(tree_bpe.load(C.TOKENIZER).ids)])], ["n"])

    assert C.packing(spark, docs, SF).count() >= 400
    found = [r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()]
    assert max(found) <= tree_bpe.REST_ENTRIES


def test_caches_at_rest_encode_alike():
    bpe = tree_bpe.Bpe(tree_bpe.tokenizer_path(C.TOKENIZER), leaf=16)
    texts = pa.array(["some plain words, and more", "x" * 40 + " plain words", None, "y" * 65 + "!"])
    for decode in (False, True, True, False):
        ids, bounds, decoded, trees = bpe.encode_all(texts, decode)
        bpe.rest()
        assert not bpe.trees and all(len(c) <= 16 for c in bpe.ids) and set(bpe.texts) <= set(bpe.ids)
        assert trees.tolist() == [0, 1, 0, 1] and bounds[2] == bounds[3]
        plain = Tokenizer.from_file(tree_bpe.tokenizer_path(C.TOKENIZER))
        assert ids.tolist() == [i for t in texts.to_pylist() for i in plain.encode(t or "", add_special_tokens=False).ids]
