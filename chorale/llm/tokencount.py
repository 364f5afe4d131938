"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list; a heap holds the ranks of adjacent pairs. The lowest rank is popped and merged
again and again; the count is the initial symbols minus the merges, and no identifiers are emitted. Words repeat, so
each process keeps counts of the pieces between spaces it has met, in a cache of bounded size.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Vocabulary of the registered query, by the public tokenizers' own name.
VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Entries of each cache; a full cache starts anew.
CACHE = 300_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter:
    """Counts tokens as the vocabulary file's own library does: normalise, split, merge."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_symbols()
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.inner = [ids[letters[b]] for b in range(256)]
        self.final = [ids[letters[b] + suffix] for b in range(256)]
        self.rank, self.result = {}, []
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(ids[a] << 20 | ids[b], rank)
            self.result.append(ids[a + b])
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any("<" not in t or " " in t for t in special):  # counting looks for them only in pieces with this sign
            raise ValueError("a special string of this vocabulary has no < or has a space")
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special
        self.words: dict[bytes, int] = {}
        counter = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= CACHE:
                    self.clear()
                found = counter.count_piece(piece)
                if len(piece) < 200:
                    self[piece] = found
                return found

        self.pieces = Pieces()

    def merge(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(word)
        symbols = [self.inner[b] for b in word]
        symbols[-1] = self.final[word[-1]]
        rank, result = self.rank.get, self.result
        heap = []
        for i in range(n - 1):
            r = rank(symbols[i] << 20 | symbols[i + 1])
            if r is not None:
                heap.append(r << 40 | i)
        if not heap:
            return n
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFFFF, top >> 40
            j = after[i]
            if symbols[i] < 0 or j >= n or rank(symbols[i] << 20 | symbols[j]) != r:
                continue  # one of the two has been merged away since
            new = symbols[i] = result[r]
            symbols[j] = -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank(new << 20 | symbols[k])) is not None:
                    heappush(heap, r << 40 | i)
            p = before[i]
            if p >= 0 and (r := rank(symbols[p] << 20 | new)) is not None:
                heappush(heap, r << 40 | p)
        return left

    def count_piece(self, piece: str) -> int:
        """Tokens of a piece of text; special strings count one each, whatever stands around them."""
        total, parts = 0, [piece]
        if self.special is not None and "<" in piece:
            total += len(self.special.findall(piece))
            parts = self.special.split(piece)
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            for word in self.split.findall(part.lower()):
                raw = word.encode()
                found = self.words.get(raw)
                if found is None:
                    found = self.merge(raw)
                    if len(self.words) >= CACHE:
                        self.words.clear()
                    if len(raw) < 200:
                        self.words[raw] = found
                total += found
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a text; no pre-token crosses a space, so the pieces between spaces are counted one by one."""
        return sum(map(self.pieces.__getitem__, text.split(" "))) if text else 0


@lru_cache(maxsize=4)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, text: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``; existing columns of these names are replaced.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each, an empty table stays empty.
    """
    path = path or vocabulary_path(VOCABULARY)
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        count = merge_counter(path).count
        return pa.array((count(t.as_py()) for t in texts), pa.int64())

    (counted,) = fresh(docs, "_tokens")
    return docs.withColumn(counted, tokens(F.col(text))).select(
        *kept,
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(counted).alias("n_tokens"),
        (F.col(counted) > limit).alias("over_limit"),
    )


def token_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, as ``count_tokens`` treats nulls, empty texts and repeated rows.
    Other columns of ``docs`` are left out, whatever their names."""
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
