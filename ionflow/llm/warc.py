"""WARC archives: a writer and a PySpark Python data source.

``write_archives`` turns pages into records. Of records whose payloads are equal, of
``min_revisit`` bytes and more, that with the smallest page id is a response; the others revisit
it and hold no payload. Each task writes its own archives (gzip, one member per record, or plain)
into the given folder under names of its own; archives of attempts that did not commit are
removed when the write has ended.

``WarcSource`` (format "warc") plans one partition per range of archives, takes predicates on the
record type and on header columns down to the reader, reads each record's headers first and skips
the payload of records that fail them: plain archives by seeking, compressed ones by inflating
into nothing. Option ``payloads``: "return" them (checked against their digest), only "verify"
them, or "skip" them all.

Files are opened through pyarrow's file systems, so the folder may be on any store it knows.

Defined results: null html is an empty payload; a null page id is written as an empty header and
read back as null, and it is never revisited nor a revisit; rows that repeat the smallest id of
their payload are all responses; an empty table gives an empty result; further columns
are ignored. A truncated or damaged archive, one cut within the trailer of a compressed member too,
fails with its path and the position up to which it was read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from ionflow.llm.common import materialise

SCHEMA = "page_id long, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, refers_to_page long, content_length long, payload binary, payload_read boolean"
#: Column of the source: header of the record.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
EPOCH = "1970-01-01T00:00:00Z"
BLOCK = 1 << 16


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, mark: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{mark}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, mark: str, first: int | None) -> bytes:
    """One WARC 1.1 record; ``first``: the page id that it revisits."""
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{x:02X}" for x in c.encode("utf-8", "replace")) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, mark)}",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{mark}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if first is None else http
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, mark)}", f"X-Refers-To-Page: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Deflated:
    """Reads the members of a gzip file as one stream."""

    def __init__(self, raw):
        self.raw, self.left, self.out, self.inflate, self.begun = raw, b"", b"", zlib.decompressobj(31), False

    def read(self, n: int) -> bytes:
        parts, got = [], 0
        while got < n:
            if not self.out:
                self.left = self.left or self.raw.read(BLOCK)
                if not self.left:
                    if self.begun and not self.inflate.eof:
                        raise ValueError("compressed member cut off")
                    break
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
                self.begun = True
                self.out = self.inflate.decompress(self.left)
                self.left = self.inflate.unused_data
                continue
            take = self.out[: n - got]
            self.out = self.out[len(take) :]
            parts.append(take)
            got += len(take)
        return b"".join(parts)

    def skip(self, n: int) -> int:
        gone = 0
        while gone < n:
            x = self.read(min(BLOCK, n - gone))
            if not x:
                break
            gone += len(x)
        return gone


class _Plain:
    def __init__(self, raw):
        self.raw = raw

    def read(self, n: int) -> bytes:
        return self.raw.read(n)

    def skip(self, n: int) -> int:
        self.raw.seek(self.raw.tell() + n)
        return n


def open_archive(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def records(raw, compressed: bool, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, body or None) of every record whose headers pass ``wanted``."""
    source = _Deflated(raw) if compressed else _Plain(raw)
    held = b""
    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            more = source.read(4096)
            if not more:
                if held.strip():
                    raise ValueError(f"record cut off in its headers: {held[:80]!r}")
                return
            held += more
            end = held.find(b"\r\n\r\n", max(0, len(held) - len(more) - 3))
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        held = held[end + 4 :]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        take, body = wanted(head), None
        if take and payloads:
            body = held[:size] if len(held) >= size else held + source.read(size - len(held))
            if len(body) < size:
                raise ValueError(f"record {head.get('warc-record-id')} cut off in its body")
        elif len(held) < size and source.skip(size - len(held)) < size - len(held):
            raise ValueError(f"record {head.get('warc-record-id')} cut off in its body")
        held = held[size:]
        if len(held) < 4:
            held += source.read(4 - len(held))
        if held[:4] != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} lacks its end")
        held = held[4:]
        if take:
            yield head, body


class Archives(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    """Plans the archives, holds the pushed predicates and reads."""

    def __init__(self, schema, options: dict[str, str]):
        self.columns = [f.name for f in schema.fields]
        self.path, self.at_once = options["path"], int(options.get("archivesPerTask", "1"))
        self.payloads = options.get("payloads", "return")
        if self.payloads not in ("return", "verify", "skip"):
            raise ValueError(f"payloads: {self.payloads}")
        self.tests: list[tuple[str, frozenset]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, frozenset([f.value])))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, frozenset(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.present.append(name)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, inner = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else scheme
        found = sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and f.size), key=lambda f: -f.size)
        return [Archives([prefix + f.path for f in found[i : i + self.at_once]]) for i in range(0, len(found), self.at_once)]

    def header(self, head: dict[str, str], name: str):
        value = head.get(HEADERS[name].lower())
        return value.removeprefix("sha1:") if name == "payload_digest" and value else value

    def wanted(self, head: dict[str, str]) -> bool:
        return all(self.header(head, n) in values for n, values in self.tests) and all(self.header(head, n) is not None for n in self.present)

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.bool_() if n == "payload_read" else pa.int64() if n in ("page_id", "payload_bytes", "refers_to_page", "content_length") else pa.string()) for n in self.columns])
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with open_archive(path) as raw:
                try:
                    for head, body in records(raw, path.endswith(".gz"), self.wanted, self.payloads != "skip"):
                        row = {n: self.header(head, n) for n in HEADERS}
                        for column, key in (("page_id", "x-page-id"), ("payload_bytes", "x-payload-length"), ("refers_to_page", "x-refers-to-page"), ("content_length", "content-length")):
                            row[column] = int(head[key]) if head.get(key) else None
                        row["payload_read"] = body is not None
                        if body is not None and row["record_type"] != "revisit":
                            body = body.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else body
                            if row["payload_digest"] and digest(body) != row["payload_digest"]:
                                raise ValueError(f"record {row['record_id']} does not match its digest")
                            if self.payloads == "return":
                                row["payload"] = body
                        rows.append(row)
                        size += len(body or b"") + 400
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{path}, before byte {raw.tell()}: {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: payloads (return, verify, skip), archivesPerTask (1)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, compress: bool = True, max_bytes: int = 256 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives under ``folder``; one row per archive: path, records, bytes."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    key = F.unhex(F.sha1("html"))
    marks = rows.select("page_id", key.alias("key"), F.octet_length("html").alias("n"))
    firsts = marks.where(F.col("n") >= min_revisit).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = marks.where(F.col("n") >= min_revisit).join(firsts, "key").where("page_id <> first").select("page_id", "key", "first").distinct()
    joined = rows.withColumn("key", key).join(materialise(again, "revisits"), ["page_id", "key"], "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(inner, recursive=True)
        out, name, n, size = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for b in batches:
            for page, url, text, first in zip(*(b.column(i) for i in range(4)), strict=True):
                payload = text.as_py().encode("utf-8", "replace")
                data = record(page.as_py(), url.as_py(), payload, digest(payload), first.as_py())
                if compress:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                if out is not None and size + len(data) > max_bytes:
                    yield done()
                    out = None
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc{'.gz' * compress}", 0, 0
                    out = system.open_output_stream(f"{inner.rstrip('/')}/{name}", compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            yield done()

    written = materialise(joined.mapInArrow(run, "archive string, records long, bytes long"), "archives")
    committed = {r["archive"] for r in written.select("archive").toLocalIterator()}  # as many as files
    system, inner = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if f.base_name not in committed and f.base_name.endswith((".warc", ".warc.gz")):
            system.delete_file(f.path)
    return written


def read_archives(spark: SparkSession, path: str, payloads: str = "return") -> DataFrame:
    """All records of an archive or a folder of archives; filters on header columns reach the reader."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payloads", payloads).load(path)


def parse(data: bytes, compressed: bool = False) -> list[tuple[dict[str, str], bytes | None]]:
    """All records of an archive held in memory."""
    return list(records(io.BytesIO(data), compressed, lambda head: True, True))
