"""Reports as workbooks: a Spark data sink that writes spreadsheet files as streams.

``df.write.format("workbook").mode("overwrite").save(folder)``: each task writes one ``.xlsx`` file, row
by row into a compressed stream, so nothing of a report is held in memory; ``write`` brings it
into order first, and a report of one partition is one file. A sheet takes 2^20 rows; further rows
go to further sheets of the file. Files are written aside and moved in place when all tasks are
done; a write that fails leaves nothing, and an overwrite removes the old files only after that.

Numbers and truth values become cells of their kind, lists are joined by commas, everything else
is text. NaN and infinities are text, since sheets have no such numbers; missing values are empty
cells. Characters that XML can't hold are written by their number. Text beyond 32 767 characters and
over 16 384 columns are refused.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ionflow.sources.spectra import file_system

MOST_ROWS, MOST_COLUMNS, MOST_TEXT = 1 << 20, 1 << 14, 32_767
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]|_x[0-9A-Fa-f]{4}_")
_STYLES = f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'


def column_name(i: int) -> str:
    """Letters of a column, from 0: A, B, ..., Z, AA."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def text_cell(value: str) -> str:
    if len(value) > MOST_TEXT:
        raise ValueError(f"a cell takes {MOST_TEXT} characters, not {len(value)}")
    # What looks like a numbered character, and what is none of XML's, is written by number.
    return escape(_ODD.sub(lambda m: "_x005F" + m[0] if len(m[0]) > 1 else f"_x{ord(m[0]):04X}_", value))


def cell(place: str, value: object, style: int = 0) -> str:
    mark = f' s="{style}"' if style else ""
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"{mark}><v>{int(value)}</v></c>'
    if isinstance(value, (int, Decimal)) or isinstance(value, float) and value - value == 0:
        return f'<c r="{place}"{mark}><v>{value!r}</v></c>' if not isinstance(value, Decimal) else f'<c r="{place}"{mark}><v>{value}</v></c>'
    if isinstance(value, (date, datetime)):
        value = value.isoformat()
    if isinstance(value, list):
        value = ",".join("" if v is None else str(v) for v in value)
    return f'<c r="{place}" t="inlineStr"{mark}><is><t xml:space="preserve">{text_cell(str(value))}</t></is></c>'


class Workbook:
    """An ``.xlsx`` file that is written to a stream from first to last byte."""

    def __init__(self, stream, columns: list[str]):
        if len(columns) > MOST_COLUMNS:
            raise ValueError(f"a sheet takes {MOST_COLUMNS} columns")
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        self.columns, self.names = columns, [column_name(i) for i in range(len(columns))]
        self.sheets, self.sheet, self.rows = 0, None, 0

    def _open(self) -> None:
        self.sheets, self.rows = self.sheets + 1, 0
        self.sheet = self.zip.open(zipfile.ZipInfo(f"xl/worksheets/sheet{self.sheets}.xml"), "w", force_zip64=True)
        self.sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self._row(self.columns, 1)

    def _row(self, values: list, style: int = 0) -> None:
        self.rows += 1
        cells = "".join(cell(f"{n}{self.rows}", v, style) for n, v in zip(self.names, values, strict=True))
        self.sheet.write(f'<row r="{self.rows}">{cells}</row>'.encode("utf-8", "replace"))

    def _shut(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()

    def add(self, values: list) -> None:
        if self.sheet is None:
            self._open()
        elif self.rows >= MOST_ROWS:
            self._shut()
            self._open()
        self._row(values)

    def close(self) -> None:
        if self.sheet is None:
            self._open()
        self._shut()
        each = range(1, self.sheets + 1)
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for k in each)
        self.zip.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/>{over}</Types>')
        self.zip.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.zip.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="Sheet{k}" sheetId="{k}" r:id="rId{k}"/>' for k in each) + "</sheets></workbook>")
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in each) + f'<Relationship Id="rId{self.sheets + 1}" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        self.zip.writestr("xl/styles.xml", _STYLES)
        self.zip.close()


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = path.rstrip("/"), columns, overwrite
        self.mark = uuid.uuid4().hex[:12]

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        system, inner = file_system(self.path)
        return system, inner, f"{inner}/_writing-{self.mark}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, _, aside = self._folder()
        system.create_dir(aside, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.mark}-{context.attemptNumber()}.xlsx"
        rows = 0
        with system.open_output_stream(f"{aside}/{name}", compression=None) as stream:
            book = Workbook(stream, self.columns)
            for b in iterator:
                for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    book.add(list(values))
                rows += b.num_rows
            book.close()
        return Written(name, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner, aside = self._folder()
        system.create_dir(inner, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".xlsx")] if self.overwrite else []
        # Empty partitions leave no file, unless the whole report is empty.
        kept = [m for m in messages if m and m.rows] or [m for m in messages if m][:1]
        for m in kept:
            system.move(f"{aside}/{m.file}", f"{inner}/{m.file.rsplit('-', 1)[0]}.xlsx")
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner, aside = self._folder()
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)
        if not self.overwrite and system.get_file_info(inner).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(inner)):
            system.delete_dir(inner)


class WorkbookSink(DataSource):
    """``df.write.format("workbook")``; modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        raise ValueError("a workbook is only written")

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], [f.name for f in schema.fields], overwrite)


def write(df: DataFrame, path: str, order: list[str | Column] | None = None, one_file: bool = True) -> None:
    """Write a report as workbook files under ``path``, in order: one file, or one of each range of rows."""
    df.sparkSession.dataSource.register(WorkbookSink)
    if order:
        df = df.orderBy(*order)
    (df.coalesce(1) if one_file else df).write.format("workbook").mode("overwrite").save(path)


def peptide_report(sums: DataFrame, peptides: DataFrame, runs: list[tuple[str, str]]) -> DataFrame:
    """Protein, Peptide, Unique and a sum per run, named by the run's alias: the sheet of ``write``.

    ``sums``: run_id, peptide_ref, sum; ``peptides``: peptide_ref, proteins; ``runs``: (run_id, title) in order.
    """
    titles = [t for _, t in runs]
    if len({t.lower() for t in titles}) < len(titles):
        raise ValueError("titles of runs must differ")
    wide = sums.groupBy("peptide_ref").pivot("run_id", [r for r, _ in runs]).agg(F.sum("sum"))
    named = wide.select("peptide_ref", *[F.col(f"`{r}`").alias(t) for r, t in runs])
    return peptides.join(named, "peptide_ref", "left").select(F.array_join("proteins", ",").alias("Protein"), F.col("peptide_ref").alias("Peptide"), (F.size("proteins") == 1).alias("Unique"), *[f"`{t}`" for t in titles])
