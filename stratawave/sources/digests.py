"""SHA-256 of long files in steps of bounded size.

A sha256 is one chain over the bytes of a file, but what it hands from one byte to the next is a small state.  A long
file is stored as lines, each step brings the lines of its next part to one task, and that task goes on from the state
the step before has left.  Only Spark's readers touch the files, so any store that Spark reads will do.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.session import checkpoint_folder, cut_lineage

#: Files beyond this size are hashed in steps of about as many bytes.
PART = 128 << 20
#: Bytes of SHA256_CTX, a plain public struct of openssl/sha.h.
_CONTEXT = 112
#: The text source unpacks files with these endings and leaves out a leading byte order mark.
_PACKED, _MARK = r"\.(gz|bz2|deflate|snappy|lz4|zst)$", b"\xef\xbb\xbf"
_STATES = pa.schema([("file_id", pa.int64()), ("left", pa.int64()), ("state", pa.binary())])


@cache
def _crypto() -> ctypes.CDLL:
    """The OpenSSL that Python's own hashlib uses."""
    import _hashlib

    library = ctypes.CDLL(_hashlib.__file__)
    library.SHA256_Init.argtypes = [ctypes.c_void_p]
    library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    library.SHA256_Final.argtypes = [ctypes.c_void_p, ctypes.c_void_p]
    return library


class Sha256:
    """A sha256 that can stop and go on elsewhere: ``state`` is all that it needs."""

    def __init__(self, state: bytes | None = None) -> None:
        self.context = ctypes.create_string_buffer(state or b"", _CONTEXT)
        if state is None:
            _crypto().SHA256_Init(self.context)

    def update(self, data: bytes) -> Sha256:
        _crypto().SHA256_Update(self.context, data, len(data))
        return self

    @property
    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        _crypto().SHA256_Final(out, Sha256(self.state).context)
        return out.raw.hex()


@cache
def resumable() -> bool:
    """Whether this Python's OpenSSL can hand its state on; some builds hide these functions."""
    try:
        return Sha256(Sha256().update(b"a" * 100).state).update(b"b" * 100).hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()
    except (ImportError, AttributeError, OSError):
        return False


def is_long(part: int) -> Column:
    """Whether a file of a file source is hashed in steps."""
    return (F.col("_metadata.file_size") > part) & ~F.col("_metadata.file_name").rlike(_PACKED)


def _go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (file_id, block, left, value) in order: each file's state comes first, then its lines.

    A line lacks its line feed, as the file's last one may do: ``left`` cuts it there.
    """
    file_id, sha, left = None, None, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file_id": file_id, "left": left, "state": sha.state}], _STATES)

    for batch in batches:
        ids, blocks = batch.column("file_id").to_numpy(), batch.column("block").to_numpy()
        bounds = sorted({0, *(blocks < 0).nonzero()[0].tolist(), len(ids)})
        for a, b in zip(bounds, bounds[1:]):
            values = batch.column("value").slice(a, b - a).to_pylist()
            if blocks[a] < 0:
                if sha:
                    yield out()
                file_id, left, sha = int(ids[a]), batch.column("left")[a].as_py(), Sha256(values.pop(0))
            if values:
                data = b"\n".join([*values, b""])
                if len(data) > left + 1:
                    raise ValueError(f"a file has more bytes than were listed: {len(data) - left} beyond its end")
                sha.update(data[:left])
                left -= len(data[:left])
    if sha:
        yield out()


def _chained(files: DataFrame, lines: DataFrame, n_files: int, steps: int, before: bytes) -> DataFrame:
    """(file_id, left, state) of each file after all its lines; its first bytes ``before`` are no part of its lines."""
    ddl = "file_id long, left long, state binary"
    states = files.select("file_id", (F.col("bytes") - len(before)).alias("left"), F.lit(bytearray(Sha256().update(before).state)).alias("state"))
    for step in range(steps):
        rows = states.select("file_id", F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("line"), "left", F.col("state").alias("value"))
        rows = rows.unionByName(lines.where(F.col("step") == step).drop("step").withColumn("left", F.lit(0).cast("long")))
        rows = rows.repartitionById(n_files, F.col("file_id").cast("int")).sortWithinPartitions("file_id", "block", "line")
        states = cut_lineage(rows.select("file_id", "block", "left", "value").mapInArrow(_go_on, ddl))
    return states


def long_digests(spark: SparkSession, read: Callable[..., DataFrame], part: int) -> DataFrame | None:
    """(path, bytes, sha256) of the long files of ``read(format, **options)``; none where there are none.

    A task reads about ``part`` bytes, and at most one split of the text source beyond that, or a line if it is longer.
    """
    place = F.col("_metadata.file_path").alias("place")
    listed = read("binaryFile").where(is_long(part)).select("path", F.col("length").alias("bytes"), place)
    files = cut_lineage(listed.coalesce(1).withColumn("file_id", F.monotonically_increasing_id()))
    n_files, longest = files.agg(F.count("*"), F.max("bytes")).first()
    if not n_files:
        return None
    text = read("text", lineSep="\n").where(is_long(part)).select(
        place, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("value"))
    where = f"{checkpoint_folder(spark)}/file-lines-{uuid.uuid4().hex}"
    lines = text.join(F.broadcast(files.select("place", "file_id")), "place").select(
        "file_id", "block", "line", "value", F.expr(f"block div {part}").alias("step"))
    lines.write.partitionBy("step").parquet(where)
    lines = spark.read.schema("file_id long, block long, line long, value binary, step long").parquet(where)
    steps = -(-longest // part)
    states = _chained(files, lines, n_files, steps, b"")
    marked = states.where(F.col("left").isin(len(_MARK), len(_MARK) - 1)).select("file_id")  # less one: no line feed at the end
    if marked.count():
        some = files.join(F.broadcast(marked), "file_id")
        states = states.join(F.broadcast(marked), "file_id", "left_anti").union(
            _chained(some, lines.join(F.broadcast(marked), "file_id"), n_files, steps, _MARK))
    done = F.udf(lambda state: Sha256(bytes(state)).hexdigest(), "string")
    short = F.raise_error(F.concat(F.lit("not all bytes of a file were read: "), "path"))
    return files.join(states, "file_id").select("path", "bytes", F.when(F.col("left") == 0, done("state")).otherwise(short).alias("sha256"))
