"""Sum-of-squares online packing of token sequences.

Each task packs the documents it reads, in order. A document's full windows are cut off at once; its rest goes to the
fill level (or to a new window) for which the sum over the levels of the squared number of partly filled windows grows
least. The level array of a task has one number per fill level, whatever the input's size. With OPEN windows open, a rest
that would need a new one is cut instead: its first ids fill up the window whose closing lowers the sum of squares most, and
what is left is placed anew. So only OPEN windows stay open when a task ends; these are cut into full ones, and each task
pads one window at most.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import freed
from .tokencount import vocabulary_path

#: Ranks of the vocabulary ``byte_bpe_50k.json``; the ids are those of that file.
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: Id that ends each document.
END = 1
WINDOW = 2048
#: Partly filled windows that a task keeps at most.
OPEN = 64
#: Units that a task remembers.
CACHE = 100_000

#: White space as the vocabulary's pattern has it (fixed by Unicode).
_SPACE = "\t\n\v\f\r \x85\xa0                　"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+$")


class _Spaces(Exception):
    """The text has runs of white space, so it cannot be cut at its single spaces."""


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    No pre-token reaches from a word over the white space behind it, so a text is the sum of its units (white space and
    the word that follows). Units repeat; a bounded cache holds their ids.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

        def encode(text: str) -> bytes:
            ids = encoding.encode(text, allowed_special="all") if "<|" in text else encoding.encode_ordinary(text)
            return array("I", ids).tobytes()

        class Units(dict):
            lead = ""

            def __missing__(self, piece: str) -> bytes:
                if self.lead and (not piece or piece[0] in _SPACE or piece[-1] in _SPACE):
                    raise _Spaces
                if len(self) >= CACHE:
                    self.clear()
                found = encode(self.lead + piece)
                if len(piece) < 200:
                    self[piece] = found
                return found

        self.units, self.spaced = Units(), Units()
        self.spaced.lead = " "

    def forget(self) -> None:
        """Free the memory of the units; a Python worker may outlive its tasks."""
        self.units.clear()
        self.spaced.clear()

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and first[-1] not in _SPACE:
            try:
                return self.units[first] + b"".join(map(self.spaced.__getitem__, rest))
            except _Spaces:
                pass
        return b"".join(map(self.units.__getitem__, _UNIT.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class LevelPacker:
    """Online packing into windows; pieces are (document, start, ids, document's tokens)."""

    def __init__(self, window: int = WINDOW, most: int | None = OPEN):
        self.window, self.most = window, most
        self.open: dict[int, list[list]] = {}
        self.level = np.zeros(window + 1, np.int64)
        self.count = 0

    def place(self, doc, ids: bytes) -> Iterator[list]:
        """Put one document's ids; yields the windows that are full now."""
        n, size = len(ids) // 4, self.window * 4
        full = n // self.window * size
        for at in range(0, full, size):
            yield [(doc, at // 4, ids[at : at + size], n)]
        if full < len(ids):
            yield from self._put((doc, full // 4, ids[full:], n))

    def _put(self, piece: tuple) -> Iterator[list]:
        doc, start, ids, n = piece
        size, level = len(ids) // 4, self.level
        top = self.window - size
        # Growth of the sum of squares, halved, for each level h that the piece would leave for h + size.
        growth = level[size : self.window + 1] - level[: top + 1] + 1.0
        growth[top] = 0.5 - level[top]  # the window is full then, and no longer counted
        growth[level[: top + 1] == 0] = np.inf
        growth[0] = level[size] + 0.5  # a new window
        h = top - int(np.argmin(growth[::-1]))
        if not h and self.most is not None and self.count >= self.most:
            fits = growth[1:].min(initial=np.inf) < np.inf
            h = top - int(np.argmin(growth[:0:-1])) if fits else self._fullest()
        if h + size > self.window:  # cut: no window has room for the whole piece
            room = self.window - h
            yield [*self._take(h), (doc, start, ids[: room * 4], n)]
            yield from self._put((doc, start + room, ids[room * 4 :], n))
            return
        window = self._take(h) if h else []
        window.append(piece)
        if h + size == self.window:
            yield window
            return
        level[h + size] += 1
        self.count += 1
        self.open.setdefault(h + size, []).append(window)

    def _take(self, h: int) -> list:
        self.level[h] -= 1
        self.count -= 1
        return self.open[h].pop()

    def _fullest(self) -> int:
        """The level with most windows; of several, the fullest one."""
        return self.window - int(np.argmax(self.level[::-1]))

    def finish(self) -> Iterator[list]:
        """Cut what is still open into full windows; the last one may be short."""
        window, room = [], self.window
        for h in sorted(self.open, reverse=True):
            for doc, start, ids, n in (p for w in self.open[h] for p in w):
                at = 0
                while at < len(ids):
                    cut = ids[at : at + room * 4]
                    window.append((doc, start + at // 4, cut, n))
                    at += len(cut)
                    room -= len(cut) // 4
                    if not room:
                        yield window
                        window, room = [], self.window
        if window:
            yield window
        self.open, self.level, self.count = {}, np.zeros(self.window + 1, np.int64), 0


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``, if asked for).

    Every id of every document, its end id included, lies in one piece; a null or empty text has the end id alone.
    Repeated rows are packed each. A sequence shorter than ``window`` is to be padded to it, but for a length that is a
    power of two. An empty table gives an empty result. ``sequence_id`` holds the task's number and a running number.
    """
    path = path or vocabulary_path(VOCABULARY)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.binary()))
    schema = pa.schema(fields)
    end = array("I", [END]).tobytes()

    def run(batches):
        known, packer = encoder(path), LevelPacker(window)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def close(done: list) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, n in done:
                rows.append((doc, start, len(ids) // 4, crc32(ids), n, number, offset) + ((ids,) if with_ids else ()))
                offset += len(ids) // 4
            number += 1

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows.clear()
            return out

        for b in batches:
            for doc, value in zip(b.column(0).to_pylist(), b.column(1)):
                for done in packer.place(doc, known.ids(value.as_py() or "") + end):
                    close(done)
            if rows:
                yield batch()
        for done in packer.finish():
            close(done)
        known.forget()
        if rows:
            yield batch()

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").mapInArrow(freed(run), out)
