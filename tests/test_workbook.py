import math
import os
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from ionflow.sources import workbook as W

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parsed(path):
    """Rows of every sheet of a workbook, as a reader of spreadsheets sees them."""
    out = []
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and "[Content_Types].xml" in z.namelist()
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet")]
        for k in range(1, len(sheets) + 1):
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{NS}row"):
                values = {}
                for c in row:
                    name = re.match("[A-Z]+", c.get("r"))[0]
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                        values[name] = re.sub("_x([0-9A-F]{4})_", lambda m: chr(int(m[1], 16)), text)
                    else:
                        v = c.find(f"{NS}v").text
                        values[name] = bool(int(v)) if c.get("t") == "b" else float(v)
                rows.append(values)
            out.append(rows)
    return out


def books(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith("."))


def test_report_parses_back(spark, tmp_path):
    sums = spark.createDataFrame([("r1", "AC_2", 1.5), ("r2", "AC_2", 2.0), ("r2", "DE_3", 1e-9)], "run_id string, peptide_ref string, sum double")
    peptides = spark.createDataFrame([("AC_2", ["P1", "P<2>"]), ("DE_3", ["P&3"]), ("GG_1", ["Q"])], "peptide_ref string, proteins array<string>")
    report = W.peptide_report(sums, peptides, [("r1", "first run"), ("r2", "x-2")])
    W.write(report, f"{tmp_path}/out", ["Peptide"])
    (name,) = books(f"{tmp_path}/out")
    (rows,) = parsed(f"{tmp_path}/out/{name}")
    assert rows == [{"A": "Protein", "B": "Peptide", "C": "Unique", "D": "first run", "E": "x-2"}, {"A": "P1,P<2>", "B": "AC_2", "C": False, "D": 1.5, "E": 2.0}, {"A": "P&3", "B": "DE_3", "C": True, "E": 1e-9}, {"A": "Q", "B": "GG_1", "C": True}]
    with pytest.raises(ValueError, match="differ"):
        W.peptide_report(sums, peptides, [("r1", "x"), ("r2", "X")])


def test_values_of_all_kinds(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, CAST(2.50 AS DECIMAL(9,2)) AS b, DOUBLE('NaN') AS c, 'a\nb\u0001 _x0041_ ü 😀  ' AS d, DATE'2024-02-03' AS e, TIMESTAMP'2024-02-03 04:05:06' AS f, array(1, null, 3) AS g, CAST(null AS STRING) AS h, true AS i, 9007199254740993L AS j")
    W.write(df, f"file://{tmp_path}/v")
    ((head, row),) = parsed(f"{tmp_path}/v/{books(f'{tmp_path}/v')[0]}")
    assert list(head.values()) == list("abcdefghij")
    assert row["A"] == 1 and row["B"] == 2.5 and row["C"] == "nan" and math.isclose(row["J"], 2.0**53) and row["I"] is True and "H" not in row
    assert row["D"] == "a\nb\u0001 _x0041_ ü 😀  " and row["E"] == "2024-02-03" and row["F"].startswith("2024-02-03T04:05:06") and row["G"] == "1,,3"
    W.write(df.where("false"), f"file://{tmp_path}/v")
    assert [len(s) for s in parsed(f"{tmp_path}/v/{books(f'{tmp_path}/v')[0]}")] == [1] and len(books(f"{tmp_path}/v")) == 1


def test_many_files_in_order_and_sheets(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 2).alias("twice"))
    W.write(df, f"{tmp_path}/m", ["id"], one_file=False)
    names = books(f"{tmp_path}/m")
    rows = [r["A"] for n in names for r in parsed(f"{tmp_path}/m/{n}")[0][1:]]
    assert len(names) > 1 and rows == list(range(1000))
    W.write(df.limit(5), f"{tmp_path}/m")
    assert len(books(f"{tmp_path}/m")) == 1  # the old files are gone


def test_sheets_have_a_bound(tmp_path, monkeypatch):
    monkeypatch.setattr(W, "MOST_ROWS", 4)
    with open(tmp_path / "s.xlsx", "wb") as f:
        book = W.Workbook(f, ["n"])
        for i in range(7):
            book.add([i])
        book.close()
    sheets = parsed(tmp_path / "s.xlsx")
    assert [[r["A"] for r in s[1:]] for s in sheets] == [[0, 1, 2], [3, 4, 5], [6]] and all(s[0] == {"A": "n"} for s in sheets)
    assert [W.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    with pytest.raises(ValueError, match="characters"):
        W.text_cell("x" * 40_000)


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    good = spark.range(10).select("id")
    bad = good.repartition(2).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    spark.dataSource.register(W.WorkbookSink)
    with pytest.raises(Exception, match="no"):
        bad.write.format("workbook").mode("append").save(f"{tmp_path}/x")
    assert not os.path.isdir(f"{tmp_path}/x") or books(f"{tmp_path}/x") == []
    W.write(good, f"{tmp_path}/y")
    kept = books(f"{tmp_path}/y")
    with pytest.raises(Exception, match="no"):
        W.write(bad, f"{tmp_path}/y")
    assert books(f"{tmp_path}/y") == kept
