"""Readers of files that no registered query reads."""

import gzip
import hashlib
import json
import os
import random

import pyarrow as pa
import pytest
from stratawave.sources import digests, readers, specs, writers


def test_quoted_lines_of_a_file(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('"date,value"\n"2001-01-31,1.5"\n"2001-02-28,2.5"\n')
    got = readers.read_quoted_lines(spark, f"file:{path}", ["date", "value"]).collect()
    assert sorted((str(r["date"]), float(r["value"])) for r in got) == [("2001-01-31", 1.5), ("2001-02-28", 2.5)]


def test_specs_of_a_file(spark, tmp_path):
    path = tmp_path / "specs.json"
    path.write_text(json.dumps([{"name": "long", "horizon": 60, "regime": "LOW"}, {"name": "plain"}]))
    got = {r["name"]: (r["type"], r["regime"], r["horizon"]) for r in specs.read_specs(spark, f"file:{path}").collect()}
    assert got == {"long": ("path", "low", 60), "plain": ("path", "combined", 48)}


@pytest.mark.parametrize("newer", ["a", "b"])
def test_latest_by_file_takes_the_newer_file(spark, tmp_path, newer):
    rows = {"a": [(1, 10), (2, 20), (None, 5)], "b": [(2, 21), (3, 30)]}
    for name, values in rows.items():
        writers.save(spark.createDataFrame(values, "k int, v int"), f"file:{tmp_path}/{name}")
        for file in (tmp_path / name).glob("*.parquet"):
            os.utime(file, (2_000_000_000, 2_000_000_000 + (name == newer)))
    got = {r["k"]: r["v"] for r in writers.latest_by_file(spark, f"file:{tmp_path}", ["k"]).collect()}
    assert got == {1: 10, 2: 20 if newer == "a" else 21, 3: 30, None: 5}


def test_latest_by_file_of_one_time(spark, tmp_path):
    for name, values in (("a", [(1, 3), (1, 9)]), ("b", [(1, 4), (1, 6)])):
        writers.save(spark.createDataFrame(values, "k int, v int").coalesce(1), f"file:{tmp_path}/{name}")
        for file in (tmp_path / name).glob("*.parquet"):
            os.utime(file, (2_000_000_000, 2_000_000_000))
    assert [tuple(r) for r in writers.latest_by_file(spark, f"file:{tmp_path}", ["k"], ties=["v"]).collect()] == [(1, 6)]


FILES = {
    "short file.bin": b"abc",
    "even.bin": b"x" * 9_999 + b"\n" + b"x" * 49_999 + b"\n",
    "lines.bin": b"\n" * 40_001,
    "ends.bin": bytes(random.Random(1).randbytes(50_000)) + b"\n",
    "open.bin": bytes(random.Random(2).randbytes(130_000)) + b"\r",
    "a b%41#\u00e9+?.bin": bytes(random.Random(3).randbytes(77_777)) + b"\n\n",
    "sub/other.bin": b"\0\n" * 30_000 + b"\0",
    "one line.bin": b"y" * 40_000,
    "marked.csv": b"\xef\xbb\xbf" + b"1,2\r\n" * 9_000,
    "marked open.csv": b"\xef\xbb\xbf\n\xef\xbb\xbf" + b"1,2\n" * 9_000 + b"3",
    "packed.gz": gzip.compress(random.Random(4).randbytes(60_000)),
}


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


@pytest.fixture
def conf(spark):
    was = {}

    def put(name, value):
        was.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield put
    for name, value in was.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


@pytest.mark.parametrize("split", ["7000", "30000", "128m"])
def test_manifest_of_long_files(spark, folder, conf, split):
    conf("spark.sql.files.maxPartitionBytes", split)
    got = sorted(tuple(r) for r in writers.file_manifest(spark, f"file:{folder}", part=30_000).collect())
    assert got == sorted((n.split("/")[-1], len(x), hashlib.sha256(x).hexdigest()) for n, x in FILES.items())


def test_manifest_reads_no_long_file_whole(spark, folder, conf):
    """The binary source brings a whole file to a task; here it refuses all beyond 30,000 bytes."""
    conf("spark.sql.sources.binaryFile.maxLength", "30000")
    got = {r["bytes"]: r["sha256"] for r in writers.file_manifest(spark, f"file:{folder}", "*.bin", part=30_000).collect()}
    assert got == {len(x): hashlib.sha256(x).hexdigest() for n, x in FILES.items() if n.endswith(".bin")}


def test_manifest_task_takes_a_part(spark, folder, conf, monkeypatch):
    conf("spark.sql.files.maxPartitionBytes", "8000")
    seen, cut = [], digests.cut_lineage
    monkeypatch.setattr(digests, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    writers.file_manifest(spark, f"file:{folder}", "o*n.bin", part=30_000).collect()
    left = [len(FILES["open.bin"]), *(s.first()["left"] for s in seen[1:])]
    taken = [a - b for a, b in zip(left, left[1:])]
    assert len(taken) == 5 and max(taken) < 30_000 + 8_000 + 3_000 and left[-1] == 0


def test_manifest_without_states_hashes_whole(spark, folder, monkeypatch):
    monkeypatch.setattr(writers, "resumable", lambda: False)
    got = {r["sha256"] for r in writers.file_manifest(spark, f"file:{folder}", part=30_000).collect()}
    assert got == {hashlib.sha256(x).hexdigest() for x in FILES.values()}


@pytest.mark.parametrize("cut", [0, 1, 55, 63, 64, 65, 1000])
def test_sha256_goes_on_from_its_state(cut):
    data = random.Random(cut).randbytes(1000)
    first = digests.Sha256().update(data[:cut])
    assert digests.resumable() and first.hexdigest() == hashlib.sha256(data[:cut]).hexdigest()
    assert digests.Sha256(first.state).update(data[cut:]).hexdigest() == hashlib.sha256(data).hexdigest()


def test_lines_beyond_the_end_of_a_file_fail():
    start = digests.Sha256().state
    rows = [{"file_id": 0, "block": b, "left": left, "value": v} for b, left, v in ((-1, 4, start), (0, 0, b"abc"), (0, 0, b"d"))]
    schema = pa.schema([("file_id", pa.int64()), ("block", pa.int64()), ("left", pa.int64()), ("value", pa.binary())])
    with pytest.raises(ValueError, match="more bytes"):
        list(digests._go_on(iter([pa.RecordBatch.from_pylist(rows, schema)])))
    assert [b.to_pylist() for b in digests._go_on(iter([pa.RecordBatch.from_pylist(rows[:2], schema)]))] == [
        [{"file_id": 0, "left": 0, "state": digests.Sha256().update(b"abc\n").state}]]
