import json
import zlib

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

from ionflow.functions import codecs as C
from ionflow.sources import spectra as S


# Codecs -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 127, 128, 160, 1000])
@pytest.mark.parametrize("spread", [0, 1, 90, 70_000, 4_000_000])
def test_packed_round_trip(n, spread):
    values = np.cumsum(np.random.default_rng(n + spread).integers(0, spread + 1, n))
    words = C.pack_sorted(values)
    assert words.dtype == np.dtype("<u4") and C.unpack_sorted(words).tolist() == values.tolist()
    if len(words) > 1:
        with pytest.raises(ValueError):
            C.unpack_sorted(words[:-1])


def plain_unpack(words):
    """One bit at a time."""
    n, at, out, last = words[0], 1, [], 0

    def block(width, at):
        nonlocal last
        for i in range(32):
            value = 0
            for b in range(width):
                place = i * width + b
                value |= (words[at + place // 32] >> (place % 32) & 1) << b
            last += value
            out.append(last)
        return at + width

    while n - len(out) >= 128:
        head, at = words[at], at + 1
        for shift in (24, 16, 8, 0):
            at = block(head >> shift & 255, at)
    while n - len(out) >= 32:
        at = block(words[at], at + 1)
    data, value, shift = b"".join(int(w).to_bytes(4, "little") for w in words[at:]), 0, 0
    for x in data:
        value |= (x & 127) << shift
        shift += 7
        if x & 128:
            last, value, shift = last + value, 0, 0
            out.append(last)
            if len(out) == n:
                break
    return out


def test_packed_against_bits_and_fixed_words():
    rng = np.random.default_rng(1)
    for n in (5, 40, 200, 333):
        values = np.cumsum(rng.integers(0, [1, 2, 500, 1 << 20][n % 4] + 1, n) * rng.integers(0, 2, n))
        words = C.pack_sorted(values)
        assert plain_unpack(words.tolist()) == values.tolist() == C.unpack_sorted(words).tolist()
    # Differences of 1: one bit each; of 100 and 300 at the end: a byte of 100 | 128, and 44 then 2 | 128.
    assert C.pack_sorted(np.arange(1, 33)).tolist() == [32, 1, 0xFFFFFFFF]
    assert C.pack_sorted(np.array([100, 400])).tolist() == [2, 0x00822CE4]
    assert C.pack_sorted(np.arange(0, 256, 2)).tolist()[:2] == [128, 0x02020202]
    assert C.unpack_sorted(np.array([3, 0x00838281], "<u4")).tolist() == [1, 3, 6]
    with pytest.raises(ValueError, match="ascend"):
        C.pack_sorted(np.array([2, 1]))
    with pytest.raises(ValueError, match="bits"):
        C.unpack_sorted(np.array([32, 33, *[0] * 33], "<u4"))


def test_array_codecs():
    mz = np.array([100.001, 250.5, 999.123])
    for codec in ("packed", "delta"):
        assert C.decode_mz(C.encode_mz(mz, codec), codec) == pytest.approx(mz, abs=1e-4)
    assert C.decode_intensity(C.encode_intensity([10.0, 1000.0], True), True) == pytest.approx([10, 1000])
    assert C.decode_intensity(zlib.compress(np.array([1, 2], "<f4").tobytes()), log10=True).tolist() == [10, 100]
    assert C.from_text(C.to_text(np.array([1.5, -2.0], np.float32))).tolist() == [1.5, -2.0]
    assert C.from_text(C.to_text(np.array([7, -9])), "i4").tolist() == [7, -9]


# The source ---------------------------------------------------------------------------------------


def write_run(folder, name, windows=3, scans=20, seed=1):
    """A run of one level 1 block and a block per window; returns the scans as (level, window, rt, mz, intensity)."""
    rng = np.random.default_rng(seed)
    blob, blocks, truth = bytearray(b"head"), [], []
    for k in range(windows + 1):
        start, rts, mzs, ints = len(blob), [], [], []
        for i in range(scans):
            n = int(rng.integers(0, 80)) if (k, i) != (1, 3) else 0
            m, y = np.sort(rng.integers(100_000, 900_000, n)) / 1000, rng.integers(1, 999, n).astype(float)
            a, b = C.encode_mz(m, "packed"), C.encode_intensity(y)
            blob += a + b
            rts.append(10.0 + 3 * i + k / 8)
            mzs.append(len(a))
            ints.append(len(b))
            truth.append((1 if k == 0 else 2, None if k == 0 else k - 1, rts[-1], np.float32(m).tolist(), y.tolist()))
        span = None if k == 0 else {"start": 300.0 + 100 * k, "end": 400.0 + 100 * k, "mz": 350.0 + 100 * k}
        blocks.append({"level": 1 if k == 0 else 2, "startPtr": start, "endPtr": len(blob), "windowRange": span, "nums": list(range(scans)), "rts": rts, "mzs": mzs, "ints": ints})
    (folder / f"{name}.bin").write_bytes(bytes(blob))
    index = {"features": "a:1", "fileSize": 99, "rangeList": [b["windowRange"] for b in blocks[1:]], "instruments": [{"model": "x"}], "compressors": [{"target": "mz", "methods": ["zlib"], "precision": 1000}], "parentFiles": [{"name": "p"}], "indexList": blocks}
    (folder / f"{name}.json").write_text(json.dumps(index))
    return truth, index


def rows(df):
    return sorted(((r.level, r.window_id, r.rt, list(r.mz), list(r.intensity)) for r in df.collect()), key=str)


def test_all_scans_and_pushed_filters(spark, tmp_path):
    truth, _ = write_run(tmp_path, "a")
    other, _ = write_run(tmp_path, "b", 2, 5, 2)
    for options in ({}, {"bytesPerTask": 700}, {"indexesOnDriver": 0}):
        scans = S.read_spectra(spark, f"file://{tmp_path}", **options)
        assert rows(scans) == sorted(truth + other, key=str)
        one = scans.where("run_id = 'a'")
        assert rows(S.level_one(one)) == sorted([t for t in truth if t[0] == 1], key=str)
        assert rows(S.level_one(one, 20, 40)) == sorted([t for t in truth if t[0] == 1 and 20 <= t[2] <= 40], key=str)
        assert rows(S.of_precursor(one, 500.0, 30)) == sorted([t for t in truth if t[1] == 1 and t[2] >= 30], key=str)
        found = S.one_spectrum(one, 610.0, 10.0 + 9 + 3 / 8)
        assert rows(found) == [t for t in truth if t[1] == 2 and t[2] == 19.375]
        assert rows(scans.where("window_id IN (0, 2) AND num < 2 AND run_id = 'a'")) == sorted([t for t in truth if t[1] in (0, 2) and t[2] < 16], key=str)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan and "Filter [" not in plan  # all of it is the reader's
    assert S.read_spectra(spark, f"{tmp_path}/b.json").count() == len(other)
    assert rows(scans) == sorted(truth + other, key=str)  # filters of other queries are not kept
    assert scans.where("size(mz) = 0").count() == sum(not t[3] for t in truth + other)


class Counted:
    """A file that adds up what is read from it."""

    def __init__(self, file, log):
        self.file, self.log = file, log

    def read_at(self, n, at):
        self.log.append((at, n))
        return self.file.read_at(n, at)

    def read(self):
        return self.file.read()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def test_a_lookup_reads_one_scan(tmp_path, monkeypatch):
    truth, index = write_run(tmp_path, "a")
    reader = S.SpectraReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("level",), 2), LessThanOrEqual(("mz_start",), 450.0), GreaterThanOrEqual(("mz_end",), 450.5), EqualTo(("rt",), 10.125 + 3 * 7), EqualTo(("mz",), 1)]))
    assert [f.attribute for f in left] == [("mz",)]
    parts, log = reader.partitions(), []
    system = S.file_system

    class Logged:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def open_input_file(self, path):
            return Counted(self.inner.open_input_file(path), log)

    monkeypatch.setattr(S, "file_system", lambda path: (Logged(system(path)[0]), system(path)[1]))
    got = [b for p in parts for b in reader.read(p)]
    assert len(parts) == 1 and sum(b.num_rows for b in got) == 1
    block = index["indexList"][1]
    assert log == [(block["startPtr"] + sum(block["mzs"][:7]) + sum(block["ints"][:7]), block["mzs"][7] + block["ints"][7])]
    # Without filters neighbouring scans are read together: one read a block.
    log.clear()
    reader = S.SpectraReader({"path": str(tmp_path)})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(truth) and len([x for x in log if x[1] > 1]) == 4
    # Tasks are cut by bytes.
    assert len(S.SpectraReader({"path": str(tmp_path), "bytesPerTask": "500"}).partitions()) > 10


def test_damage_is_told_with_its_place(spark, tmp_path):
    _, index = write_run(tmp_path, "a", 1, 4)
    block = index["indexList"][1]
    data = bytearray((tmp_path / "a.bin").read_bytes())
    bad = block["startPtr"] + block["mzs"][0] + block["ints"][0]
    data[bad : bad + 4] = b"junk"
    (tmp_path / "a.bin").write_bytes(bytes(data))
    scans = S.read_spectra(spark, str(tmp_path))
    assert scans.where("level = 1").count() == 4 and scans.where("level = 2 AND num <> 1").count() == 3
    with pytest.raises(Exception, match=f"scan at byte {bad}"):
        scans.collect()
    block["rts"] = block["rts"][:-1]
    (tmp_path / "a.json").write_text(json.dumps(index))
    with pytest.raises(Exception, match="block 1: 3 times"):
        S.read_spectra(spark, str(tmp_path)).collect()
    (tmp_path / "a.json").write_text("{ no json")
    with pytest.raises(Exception, match="no JSON"):
        S.read_spectra(spark, str(tmp_path)).collect()
    with pytest.raises(Exception):
        S.read_runs(spark, str(tmp_path)).collect()


def test_run_index(spark, tmp_path):
    _, index = write_run(tmp_path, "a", 2, 4)
    run = S.read_runs(spark, str(tmp_path)).first()
    assert (run.run_id, run.vendor_bytes, run.features, run.instruments, run.parent_files) == ("a", 99, "a:1", [{"model": "x"}], [{"name": "p"}])
    assert run.index_bytes == (tmp_path / "a.json").stat().st_size and [w.start for w in run.windows] == [400.0, 500.0] and run.compressors[0].precision == 1000
    assert [tuple(r) for r in S.read_windows(spark, str(tmp_path)).orderBy("window_id").collect()] == [("a", 0, 400.0, 500.0), ("a", 1, 500.0, 600.0)]
    blocks = S.read_blocks(spark, str(tmp_path)).orderBy("block").collect()
    assert [b.problem for b in blocks] == [None] * 3 and [b.level for b in blocks] == [1, 2, 2] and blocks[1].rts == index["indexList"][1]["rts"]
    index["indexList"][0]["mzs"][0] += 1
    index["indexList"][1]["ints"].pop()
    index["indexList"][2]["rts"][2] = 0.0
    (tmp_path / "a.json").write_text(json.dumps(index))
    assert [b.problem for b in S.read_blocks(spark, str(tmp_path)).orderBy("block").collect()] == ["sizes do not fill the block", "lists of different lengths", "times do not ascend"]
    del index["indexList"][2]["windowRange"], index["indexList"][1]["level"]
    (tmp_path / "a.json").write_text(json.dumps(index))
    assert [b.problem for b in S.read_blocks(spark, str(tmp_path)).orderBy("block").collect()][1:] == ["no level or place", "no window"]
