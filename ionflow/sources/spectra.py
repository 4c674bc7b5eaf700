"""Runs of spectra as a Spark data source: a JSON block index beside a binary file of compressed scans.

``spark.read.format("spectra").load(path)`` gives one row per scan. ``path`` is an index file or a folder
of them; the scans of ``x.json`` lie in the file beside it that has the ending ``ending``. A block holds the
scans of one isolation window (or of level 1) in order of time: per scan the m/z array, then the
intensity array.

Comparisons of run_id, level, window_id, mz_start, mz_end, num and rt with constants are pushed
down. They choose index files by name, then blocks, then scans, before any task is planned: tasks
get the byte ranges that are left, cut to about ``bytesPerTask``, and read nothing else. The indexes
of up to ``indexesOnDriver`` files are read for that; of more, each task reads its own one.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not

from ionflow.functions import codecs

SCHEMA = "run_id string, level int, window_id int, mz_start double, mz_end double, num int, rt double, mz array<float>, intensity array<float>"
_ARROW = pa.schema([("run_id", pa.string()), ("level", pa.int32()), ("window_id", pa.int32()), ("mz_start", pa.float64()), ("mz_end", pa.float64()), ("num", pa.int32()), ("rt", pa.float64()), ("mz", pa.list_(pa.float32())), ("intensity", pa.list_(pa.float32()))])
PUSHED = {"run_id", "level", "window_id", "mz_start", "mz_end", "num", "rt"}
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda a, b: a in b, IsNotNull: lambda a, _: True}


def _opposite(compare):
    return lambda a, b: not compare(a, b)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


@dataclass
class Block:
    """Scans of one block that are still wanted: their times, numbers and the places of their arrays."""

    level: int
    window_id: int | None
    mz_start: float | None
    mz_end: float | None
    rts: np.ndarray
    nums: list[int | None]
    starts: np.ndarray
    mzs: np.ndarray
    ints: np.ndarray

    def only(self, at: np.ndarray) -> Block:
        return Block(self.level, self.window_id, self.mz_start, self.mz_end, self.rts[at], [self.nums[i] for i in at.tolist()], self.starts[at], self.mzs[at], self.ints[at])


@dataclass
class Scans(InputPartition):
    """Blocks of one run, or (without any) a run whose index the task reads itself."""

    run_id: str
    index: str
    data: str
    blocks: list[Block] = field(default_factory=list)
    planned: bool = True


def blocks_of(index: dict, where: str = "index") -> list[Block]:
    """All blocks of an index; lists of different lengths, or places beyond the block's end, are refused."""
    windows: dict[tuple, int] = {}
    out = []
    for k, b in enumerate(index.get("indexList") or []):
        rts, mzs, ints = (np.array(b.get(n) or [], t) for n, t in (("rts", float), ("mzs", np.int64), ("ints", np.int64)))
        nums = b.get("nums") or [None] * len(rts)
        if not len(rts) == len(mzs) == len(ints) == len(nums):
            raise ValueError(f"{where}, block {k}: {len(rts)} times, {len(mzs)} and {len(ints)} sizes, {len(nums)} numbers")
        span = b.get("windowRange") or b.get("range") or {}
        starts = int(b["startPtr"]) + np.cumsum(mzs + ints) - (mzs + ints)
        if b.get("endPtr") and len(rts) and starts[-1] + mzs[-1] + ints[-1] > b["endPtr"]:
            raise ValueError(f"{where}, block {k}: its scans end after byte {b['endPtr']}")
        level = int(b["level"])
        window = None
        if level > 1:
            window = b.get("window_id")
            if window is None:
                window = windows.setdefault((span.get("start"), span.get("end")), len(windows))
        out.append(Block(level, window, span.get("start"), span.get("end"), rts, nums, starts, mzs, ints))
    return out


def chosen(blocks: list[Block], run_id: str, tests: list[tuple[str, object, object]]) -> list[Block]:
    """The scans that pass all tests (column, comparison, value)."""
    out = []
    for b in blocks:
        whole = {"run_id": run_id, "level": b.level, "window_id": b.window_id, "mz_start": b.mz_start, "mz_end": b.mz_end}
        if not all(whole[c] is not None and compare(whole[c], v) for c, compare, v in tests if c in whole):
            continue
        keep = np.ones(len(b.rts), bool)
        for c, compare, v in tests:
            if c in ("rt", "num"):
                keep &= np.array([x is not None and bool(compare(x, v)) for x in (b.rts.tolist() if c == "rt" else b.nums)], bool)
        if keep.any():
            out.append(b if keep.all() else b.only(np.flatnonzero(keep)))
    return out


class SpectraReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.ending = options["path"], options.get("ending", ".bin")
        self.codec, self.log10 = options.get("codec", "packed"), options.get("log10", "false").lower() == "true"
        self.size, self.most = int(options.get("bytesPerTask", str(32 << 20))), int(options.get("indexesOnDriver", "64"))
        self.tests: list[tuple[str, object, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            x = f.child if isinstance(f, Not) else f
            name = x.attribute[0] if hasattr(x, "attribute") and len(x.attribute) == 1 else None
            if name in PUSHED and type(x) in _COMPARED and not (x is not f and isinstance(x, IsNotNull)):
                compare = _COMPARED[type(x)]
                self.tests.append((name, compare if x is f else _opposite(compare), getattr(x, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, inner = file_system(self.path)
        info = system.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        runs = [(f.base_name.rpartition(".")[0], prefix + f.path) for f in files if f.type == fs.FileType.File and f.path.endswith(".json")]
        runs = sorted((r, p) for r, p in runs if all(compare(r, v) for c, compare, v in self.tests if c == "run_id"))
        parts: list[InputPartition] = []
        for run_id, index in runs:
            whole = Scans(run_id, index, index.rpartition(".")[0] + self.ending)
            if len(runs) > self.most:
                whole.planned = False
                parts.append(whole)
                continue
            for blocks in self.cut(self.wanted(whole)):
                parts.append(Scans(run_id, index, whole.data, blocks))
        return parts

    def wanted(self, run: Scans) -> list[Block]:
        system, inner = file_system(run.index)
        with system.open_input_file(inner) as f:
            try:
                index = json.loads(f.read())
            except ValueError as e:
                raise ValueError(f"{run.index} is no JSON: {e}") from e
        return chosen(blocks_of(index, run.index), run.run_id, self.tests)

    def cut(self, blocks: list[Block]) -> Iterator[list[Block]]:
        """Groups of blocks, or parts of them, of about ``bytesPerTask``."""
        held, size = [], 0
        for b in blocks:
            step = np.cumsum(b.mzs + b.ints) // self.size
            for k in np.unique(step).tolist():
                part = b if len(np.unique(step)) == 1 else b.only(np.flatnonzero(step == k))
                own = int((part.mzs + part.ints).sum())
                if held and size + own > self.size:
                    yield held
                    held, size = [], 0
                held.append(part)
                size += own
        if held:
            yield held

    def read(self, partition: Scans) -> Iterator[pa.RecordBatch]:
        blocks = partition.blocks if partition.planned else self.wanted(partition)
        if not blocks:
            return
        system, inner = file_system(partition.data)
        with system.open_input_file(inner) as f:
            for b in blocks:
                # Neighbouring scans are read at once, up to 8 MB.
                ends = b.starts + b.mzs + b.ints
                fresh = np.concatenate([[True], b.starts[1:] != ends[:-1]])
                group = np.cumsum(fresh | np.concatenate([[False], np.diff(ends // (8 << 20)) > 0]))
                for g in np.unique(group).tolist():
                    at = np.flatnonzero(group == g)
                    base = int(b.starts[at[0]])
                    yield self.decoded(partition, b, at, base, f.read_at(int(ends[at[-1]]) - base, base))

    def decoded(self, run: Scans, b: Block, at: np.ndarray, base: int, data: bytes) -> pa.RecordBatch:
        mz, y = [], []
        for i in at.tolist():
            s, m = int(b.starts[i]) - base, int(b.mzs[i])
            try:
                mz.append(codecs.decode_mz(data[s : s + m], self.codec))
                y.append(codecs.decode_intensity(data[s + m : s + m + int(b.ints[i])], self.log10))
            except Exception as e:
                raise ValueError(f"{run.data}, scan at byte {base + s}: {e}") from e
        n = len(at)
        lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in v])]).astype(np.int32), np.concatenate([*v, np.zeros(0, np.float32)]).astype(np.float32)) for v in (mz, y)]
        same = [pa.array([v] * n, t) for v, t in ((run.run_id, pa.string()), (b.level, pa.int32()), (b.window_id, pa.int32()), (b.mz_start, pa.float64()), (b.mz_end, pa.float64()))]
        return pa.RecordBatch.from_arrays([*same, pa.array([b.nums[i] for i in at.tolist()], pa.int32()), pa.array(b.rts[at]), *lists], schema=_ARROW)


class SpectraSource(DataSource):
    """``spark.read.format("spectra")``; options: ending (.bin), codec (packed or delta), log10, bytesPerTask, indexesOnDriver."""

    @classmethod
    def name(cls) -> str:
        return "spectra"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SpectraReader:
        return SpectraReader(dict(self.options))


def read_spectra(spark: SparkSession, path: str, **options) -> DataFrame:
    """Scans of one run or of a folder of runs; filters on everything but the arrays reach the reader."""
    spark.dataSource.register(SpectraSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    scans = spark.read.format("spectra").options(**{k: str(v) for k, v in options.items()}).load(path)
    # All scans have a time. With a filter of its own every query plans its own read; without any, one would
    # be given the last plan made from this DataFrame, with the filters of that.
    return scans.where(F.col("rt").isNotNull())


def level_one(scans: DataFrame, rt_start: float | None = None, rt_end: float | None = None) -> DataFrame:
    """The level 1 scans, of a range of times on demand."""
    return _between(scans.where("level = 1"), rt_start, rt_end)


def of_precursor(scans: DataFrame, mz: float, rt_start: float | None = None, rt_end: float | None = None) -> DataFrame:
    """The level 2 scans of the window that holds a precursor, of a range of times on demand."""
    return _between(scans.where(f"level = 2 AND mz_start <= {mz!r}D AND mz_end > {mz!r}D"), rt_start, rt_end)


def one_spectrum(scans: DataFrame, mz: float, rt: float) -> DataFrame:
    """The scan of a precursor's window at exactly this time."""
    return of_precursor(scans, mz).where(f"rt = {rt!r}D")


def _between(scans: DataFrame, low: float | None, high: float | None) -> DataFrame:
    scans = scans if low is None else scans.where(F.col("rt") >= float(low))
    return scans if high is None else scans.where(F.col("rt") <= float(high))


# The index as tables --------------------------------------------------------------------------------

_RANGE = "struct<start:double,end:double,mz:double,charge:int>"
_BLOCK = f"struct<level:int,startPtr:bigint,endPtr:bigint,windowRange:{_RANGE},range:{_RANGE},window_id:int,nums:array<int>,rts:array<double>,mzs:array<bigint>,ints:array<bigint>>"
_INDEX = f"features string, fileSize bigint, rangeList array<{_RANGE}>, instruments array<map<string,string>>, compressors array<struct<target:string,methods:array<string>,precision:int>>, softwares array<map<string,string>>, parentFiles array<map<string,string>>, indexList array<{_BLOCK}>"


def _indexes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(_INDEX).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("run_id"), F.col("_metadata.file_size").alias("index_bytes"), "*")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run: run_id, its windows, features, instruments, compressors, softwares, parent files and sizes. Files that are no JSON fail the read."""
    return _indexes(spark, path).select("run_id", "index_bytes", F.col("fileSize").alias("vendor_bytes"), F.coalesce("rangeList", F.array().cast(f"array<{_RANGE}>")).alias("windows"), "features", "instruments", "compressors", "softwares", F.col("parentFiles").alias("parent_files"))


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """One row per isolation window of a run: run_id, window_id (its place among the windows), mz_start, mz_end."""
    return read_runs(spark, path).select("run_id", F.posexplode("windows").alias("window_id", "w")).select("run_id", "window_id", F.col("w.start").alias("mz_start"), F.col("w.end").alias("mz_end"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row per block: run_id, block, level, mz_start, mz_end, start_ptr, end_ptr, nums, rts, mzs, ints, and ``problem`` (null for a sound block)."""
    b = _indexes(spark, path).select("run_id", F.posexplode("indexList").alias("block", "b"))
    span = F.coalesce("b.windowRange", "b.range")
    rows = b.select("run_id", "block", F.col("b.level").alias("level"), span["start"].alias("mz_start"), span["end"].alias("mz_end"), F.col("b.startPtr").alias("start_ptr"), F.col("b.endPtr").alias("end_ptr"), *[F.coalesce(f"b.{n}", F.array().cast(t)).alias(n) for n, t in (("nums", "array<int>"), ("rts", "array<double>"), ("mzs", "array<bigint>"), ("ints", "array<bigint>"))])
    return rows.withColumn("problem", block_problem())


def block_problem() -> Column:
    """What is wrong with a block of ``read_blocks``."""
    n, total = F.size("rts"), lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    falling = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(F.get("rts", i) < F.get("rts", i - 1), F.lit(False)))
    return (
        F.when(F.col("level").isNull() | F.col("start_ptr").isNull(), "no level or place")
        .when((F.size("mzs") != n) | (F.size("ints") != n) | ((F.size("nums") != n) & (F.size("nums") > 0)), "lists of different lengths")
        .when((F.col("level") > 1) & (F.col("mz_start").isNull() | F.col("mz_end").isNull()), "no window")
        .when(F.col("end_ptr").isNotNull() & (F.col("start_ptr") + total("mzs") + total("ints") != F.col("end_ptr")), "sizes do not fill the block")
        .when(falling, "times do not ascend")
    )
