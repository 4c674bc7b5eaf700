from collections import Counter

import duckdb
import pytest

from ionflow.llm import host_quality, queries

SF = "/root/testdata/sf0.001"


def plain(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_measures_and_edges(spark, odd, none):
    texts = {r.doc_id: r.text for r in odd.where("doc_id IS NOT NULL").collect()}
    rows = host_quality.judge(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert host_quality.judge(none).count() == 0
    kept = host_quality.filter_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)


def test_hosts(spark):
    good = "many different words make up this clean text which goes on for a while so that it passes every rule about length and about repetition without any trouble whatsoever since each part of it is new and plainly written by someone who cares for readers more than for counts or tricks of trade today"
    rows = [(i, good, "clean") for i in range(200)] + [(1000 + i, "bad", "junk") for i in range(200)] + [(2000, good, "junk"), (2001, good + " # #" * 20, "junk"), (2002, good, None)]
    got = {r.doc_id: r.kept for r in host_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(200)) and got[2002]
    assert not got[2000] and not got[1000] and not got[2001]


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the test tables")
def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.sql(queries.SQL["op1_host_quality"])
    df = queries.op1_host_quality(spark, SF)
    assert sorted(map(str, (dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()))) == sorted(map(str, ({c: r[c] for c in rel.columns} for r in df.collect())))


def test_no_python_in_plan(spark, odd):
    plan = host_quality.judge(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
