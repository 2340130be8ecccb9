"""Token ids in binary files of independent zstandard frames.

A file is one zstandard frame for each document, one frame that names the documents, and the trailing seek table of
the public seekable format: a skippable frame with the compressed size, the size and a checksum (low 32 bits of XXH64) of
every frame.  A reader fetches the table, then only the frames it wants.  Any zstandard tool can unpack a file whole.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratawave.session import checkpoint_folder

from .common import digest, stored, table
from .tokens import batches, crc, encoder, vocabulary

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: The frame of document names: mark, bytes of an id, number of documents; then a byte (has an id) and 8 bytes for each.
_HEAD = "<4sBQ"
_MARK = b"TOK1"

_FILES = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_ROWS = pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Writer:
    """Writes one file; documents stream through, only their names and frame sizes are held."""

    def __init__(self, path: str, width: int, level: int = 3) -> None:
        system, where = _place(path)
        self.out, self.width, self.pack = system.open_output_stream(where, compression=None), width, zstandard.ZstdCompressor(level=level)
        self.table, self.names, self.n_tokens = [], [], 0

    def _frame(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), _checksum(data)))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._frame(ids.astype(f"<u{self.width}").tobytes())
        self.names.append(doc_id)
        self.n_tokens += len(ids)

    def close(self) -> None:
        head = struct.pack(_HEAD, _MARK, self.width, len(self.names))
        some = bytes(x is not None for x in self.names)
        self._frame(head + some + np.array([x or 0 for x in self.names], "<i8").tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class Reader:
    """Opens a file by its seek table; ``ids`` decompresses one document and checks it."""

    def __init__(self, path: str) -> None:
        system, where = _place(path)
        self.file = system.open_input_file(where)
        size = self.file.size()
        n, flags, mark = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if mark != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError(f"no seek table in {path}")
        entries = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.packed, self.sizes, self.sums = entries[:, 0].astype(np.int64), entries[:, 1].astype(np.int64), entries[:, 2]
        self.starts = np.cumsum(self.packed) - self.packed
        names = self._frame(n - 1)
        mark, self.width, count = struct.unpack_from(_HEAD, names)
        if mark != _MARK or count != n - 1:
            raise ValueError(f"no document names in {path}")
        some = np.frombuffer(names, np.uint8, count, struct.calcsize(_HEAD))
        ids = np.frombuffer(names, "<i8", count, struct.calcsize(_HEAD) + count)
        self.doc_ids = [int(x) if s else None for x, s in zip(ids, some, strict=True)]

    def _frame(self, i: int) -> bytes:
        packed = self.file.read_at(int(self.packed[i]), int(self.starts[i]))
        data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, int(self.sizes[i])))
        if len(data) != self.sizes[i] or _checksum(data) != self.sums[i]:
            raise ValueError(f"frame {i} is damaged")
        return data

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self._frame(i), f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """Write the ids of all docs (doc_id, text) in ascending doc_id order; returns the stored list of files.

    * The list has (part, file, n_docs, n_tokens); files in order of ``part`` hold the documents in order of doc_id, null
      first, repeated ids by their texts.  A task that runs again writes a file of another name; only listed files count.
    * Null texts are empty; every document ends with ``end_id``.  ``width``: bytes of an id, 2 or 4.
    * Memory: one text and its ids at a time.  An empty table gives an empty list.
    """
    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, spaced=False), np.array([end_id], "<u4")
        writer, path = None, ""
        for batch in source:
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                if writer is None:
                    path = f"{folder}/tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
                    system, where = _place(folder)
                    system.create_dir(where, recursive=True)
                    writer = Writer(path, width)
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if writer is not None:
            writer.close()
            row = [TaskContext.get().partitionId(), path, len(writer.names), writer.n_tokens]
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _FILES, strict=True)], schema=_FILES)

    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest(F.col("text")).alias("digest"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(rows.mapInArrow(write, "part long, file string, n_docs long, n_tokens long"), "token-files")


def read_tokens(files: DataFrame, wanted: set[int] | None = None, with_ids: bool = False) -> DataFrame:
    """(part, nth, doc_id, start, n_tokens, ids_crc32[, ids]) of the documents in the listed files.

    ``start`` counts the ids of all documents before it.  ``wanted``: only these ids are decompressed; ``start`` is null
    then.  What comes before a file is summed over the list of files, one row each, before the files are read.
    """
    schema = _ROWS.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _ROWS

    def read(batch: pa.RecordBatch):
        for part, path, before in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            reader = Reader(path)
            for i, doc_id in enumerate(reader.doc_ids):
                if wanted is None or doc_id in wanted:
                    ids = reader.ids(i)
                    row = [part, i, doc_id, before if wanted is None else None, len(ids), crc(ids.astype("<u4").tobytes())]
                    yield [*row, ids.tolist()] if with_ids else row
                    before += len(ids)
            reader.close()

    ddl = "part long, nth long, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    n = max(1, files.count())
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("base"))
    return listed.repartition(n).mapInArrow(batches(read, schema), ddl)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
    files = write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), 1)
    return read_tokens(files).select("doc_id", "start", "n_tokens", "ids_crc32")
