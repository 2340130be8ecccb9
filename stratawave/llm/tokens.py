"""Token ids of whole texts, with a bounded memory of the words seen."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space outside ASCII, which the tokenizers' patterns also know.
_OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: What a text must lack to be cut at its single spaces: runs and other kinds of white space, and the mark of a start.
_UNEVEN = ("  ", "\n ", " \n", "\n\n", "\t", "\x0b", "\x0c", "\r", "\x01")
_ENDS = ".,;:!?"
_LONG, _CHUNK = 64, 8_000_000


def worker_state() -> dict:
    """A dictionary of this process.  Task code travels by value, so a module's own globals would not outlive a task."""
    return sys.modules.setdefault("_stratawave_worker", types.ModuleType("_stratawave_worker")).__dict__


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones themselves, others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Byte-level vocabularies split a text by a pattern before any merge: a character that is no white space never shares a
    token with white space after it, and a run of letters is one unit.  So a text's ids are those of its pieces, and
    pieces repeat.  With ``spaced`` a piece is a word with the space before it; without, white space makes no tokens.
    The distinct pieces of some megabytes of text are looked up at once.  Units of letters go to the vocabulary's merges
    directly, other pieces through the whole tokenizer; texts with unusual white space go through it whole.

    Memory: ids of pieces in two generations of ``most`` / 2 pieces each; what the older one holds and nobody asks for is
    forgotten.  Pieces of over 64 characters are not kept.
    """

    def __init__(self, path: str, spaced: bool, most: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.spaced, self.most, self.known, self.older = spaced, most, {}, {}
        self.characters = _byte_characters()
        self.space = self.characters[32]
        self.small = {x: self._unit(x) for x in _ENDS} | {"": b"", "\n": self._unit(self.characters[10])}

    def _unit(self, unit: str) -> bytes:
        ids = [x.id for x in self.merges.tokenize(unit)]
        return pack(f"<{len(ids)}I", *ids)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, piece: str) -> bytes | None:
        """Ids of a piece that is letters and at most one mark after them; None for others."""
        head = end = lead = ""
        if self.spaced:
            if piece[:1] == "\n":
                head, piece = "\n", piece[1:]
            elif piece[:1] == "\x01":
                piece = piece[1:]
            else:
                lead = self.space
        if piece[-1:] in _ENDS:
            piece, end = piece[:-1], piece[-1:]
        if not self.spaced:
            piece = piece.lower() if piece.isascii() else self.normalizer.normalize_str(piece)
        if not piece.isalpha():
            return None
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.characters)
        return self.small[head] + self._unit(lead + piece) + self.small[end]

    def _text(self, piece: str) -> str:
        """The text of a piece."""
        if not self.spaced or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == "\x01" else " " + piece

    def _ids(self, pieces: list[str]) -> list[bytes]:
        known, older = self.known, self.older
        out = [known.get(p) for p in pieces]
        missing = [i for i, x in enumerate(out) if x is None]
        slow = []
        for i in missing:
            p = pieces[i]
            out[i] = x = older.get(p) or self._letters(p)
            if x is None:
                slow.append(i)
        for i, x in zip(slow, self._whole([self._text(pieces[i]) for i in slow]), strict=True):
            out[i] = x
        for i in missing:
            if len(pieces[i]) <= _LONG:
                known[pieces[i]] = out[i]
        if len(known) >= self.most // 2:
            self.older, self.known = known, {}
        return out

    def _chunk(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        lists = pc.split_pattern(column, " ") if self.spaced else pc.ascii_split_whitespace(column)
        pieces = lists.flatten().dictionary_encode()
        ids = pa.array(self._ids(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        # binary_join wants lists with 32-bit offsets; a chunk is small, and a longer text has a chunk of its own.
        offsets = lists.offsets.to_numpy()
        joined = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), ids)
        return pc.binary_join(joined, pa.scalar(b"", pa.large_binary())).to_pylist()

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= _CHUNK:
                yield from self._mixed(held)
                held, size = [], 0
        if held:
            yield from self._mixed(held)

    def _mixed(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        even = []
        for i, text in enumerate(texts):
            if self.spaced and (any(x in text for x in _UNEVEN) or text[:1] == " " or text[-1:] == " " or not text.isascii() and _OTHER_SPACE.search(text)):
                out[i] = self._whole([text])[0]
            elif text:
                even.append(i)
        if even:
            cut = [("\x01" + texts[i].replace("\n", " \n")) if self.spaced else texts[i] for i in even]
            for i, x in zip(even, self._chunk(cut), strict=True):
                out[i] = x
        return out


def encoder(path: str, spaced: bool, most: int = 1_000_000) -> Encoder:
    """The encoder of a vocabulary file, one in each Python worker."""
    own = worker_state().setdefault("encoders", {})
    if path not in own:
        own[path] = Encoder(path, spaced, most)
    return own[path]


def release() -> None:
    """Give memory that is free in this process back to the system.

    Arrow and the C library keep what was freed, and a worker stays between its tasks while the executor's other
    processes need the memory.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def forget(but: str = "") -> None:
    """Drop what this process remembers, ``but`` one thing: tasks of another kind need the memory."""
    own = worker_state()
    for name in [x for x in own if not x.startswith("__") and x != but]:
        del own[name]
    release()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def batches(function: Callable[[pa.RecordBatch], Iterator[list]], schema: pa.Schema, rows: int = 20_000, encodes: bool = False) -> Callable:
    """A function for mapInArrow: ``function`` yields rows (lists) for a batch, which go out ``rows`` at a time.

    What tasks of another kind remember is dropped first; one that ``encodes`` keeps the encoders.  Free memory is given
    back after each batch, by a task that encodes at its end.
    """
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("encoders" if encodes else "")
        held: list[list] = []
        for batch in source:
            for row in function(batch):
                held.append(row)
                if len(held) >= rows:
                    yield _batch(held, schema)
                    held = []
            del batch
            if not encodes:
                release()
        if held:
            yield _batch(held, schema)
        held = []
        release()

    return run


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
