"""SentencePiece encoding and decoding by a table of each prefix's last token.

In a merge-type (BPE) model every prefix of a text has one last token: of the tokens that an automaton finds to end there,
the one that may follow the last token of the prefix before it. Two tokens may stand together if merging their joined
characters gives just these two. The table is filled from left to right, and the ids are recovered backwards from its end.
"""

from __future__ import annotations

import codecs
import re
from array import array
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokencount import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
#: The sign that models write for a space.
BLANK = "▁"
#: Units of text, and pairs of tokens, that a worker remembers; a full memory starts anew. Units of over LONG characters are not kept.
UNITS, PAIRS, LONG = 250_000, 400_000, 100


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    """One replacement character for every byte that is not UTF-8."""
    return "�", error.start + 1


codecs.register_error("chorale-each-byte", _each_byte)


class _Units(dict):
    """Ids of units as text, as a worker remembers them; once full, only what is met again while as many others come stays."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.old = pieces, {}

    def __missing__(self, unit: str) -> str:
        found = self.old.get(unit) or self.pieces.spell(unit)
        if len(unit) <= LONG:
            if len(self) >= UNITS:
                self.old = dict(self)
                self.clear()
            self[unit] = found
        return found


class Pieces:
    """The vocabulary of a model file, and what it makes of texts."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)  # reads the file; texts are encoded and decoded here
        self.size, self.end, self.unknown = library.get_piece_size(), library.eos_id(), library.unk_id()
        self.names = [library.id_to_piece(i) for i in range(self.size)]
        self.control = {i for i in range(self.size) if library.is_control(i)}
        self.byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        plain = [i for i in range(self.size) if not (library.is_control(i) or library.is_byte(i) or library.is_unknown(i) or library.is_unused(i))]
        probe = " a\t  bÅａ "
        if not all(map(library.is_byte, self.byte_ids)) or not self._plain(library, probe):
            raise ValueError("only models with byte fallback that change nothing of a text but its spaces are supported")
        self.rank = {self.names[i]: -library.get_score(i) for i in plain}
        #: All that can be a token: pieces that merging leads to, and the single characters of pieces.
        self.ids = {self.names[i]: i for i in plain}
        if any(BLANK in name.lstrip(BLANK) for name in self.ids):
            raise ValueError("a piece of this model has a space after a character, so texts can't be cut into units")
        loose = sorted({c for name in self.ids for c in name} - self.ids.keys())  # written as bytes, but merged like pieces
        self.texts = self.names + loose
        self.automaton = ahocorasick.Automaton()
        for token, name in [*((self.ids[self.names[i]], self.names[i]) for i in plain), *((self.size + k, c) for k, c in enumerate(loose))]:
            if len(name) == 1 or self.merge(name) == [name]:
                self.automaton.add_word(name, (len(name), token))
        self.automaton.make_automaton()
        self.known = {name for name in map(self.texts.__getitem__, [*self.ids.values(), *range(self.size, len(self.texts))]) if len(name) == 1}
        self.pairs: dict[int, bool] = {}
        self.spelled = list(map(str, range(self.size)))
        self.units, self.odd = _Units(self), {}

    @staticmethod
    def _plain(library, probe: str) -> bool:
        """Whether the model only writes spaces as BLANK, with one more in front, and reads characters it lacks as bytes."""
        spelled = "".join(bytes([int(p[3:5], 16)]).decode("latin-1") if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.encode().decode("latin-1") for p in library.encode(probe, out_type=str))
        return spelled.encode("latin-1").decode() == BLANK + probe.replace(" ", BLANK)

    def merge(self, text: str) -> list[str]:
        """The tokens of a short text by merging: ever again the adjacent pair of the best rank, the leftmost of equal ones."""
        parts: list[str] = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, float("inf")) for a, b in zip(parts, parts[1:])]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit_together(self, left: int, right: int) -> bool:
        """Whether the right token may follow the left one."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = self.texts[left], self.texts[right]
        found = self.pairs[left << 20 | right] = self.merge(a + b) == [a, b]
        return found

    def tokens(self, unit: str) -> list[int]:
        """Ids of a unit (spaces, then other characters) as merging gives them; characters that no piece has are bytes."""
        many = len(unit) + 1
        last = [-1] * many if many < LONG else array("i", [-1]) * many  # token that ends a prefix; -1: a character that no piece has
        size = [0] * many if many < LONG else array("i", [0]) * many  # and its length
        pairs, fit = self.pairs.get, self.fit_together
        for end, (length, token) in self.automaton.iter(unit):
            end += 1
            if size[end]:
                continue
            before = last[end - length]
            if before >= 0:
                fits = pairs(before << 20 | token)
                if fits is None:
                    fits = fit(before, token)
                if not fits:
                    continue
            elif end > length and unit[end - length - 1] in self.known:
                continue  # no token ends there
            last[end], size[end] = token, length
        out: list[int] = []
        end = len(unit)
        while end:
            token, length = last[end], size[end]
            if length and token < self.size:
                out.append(token)
            else:
                out.extend(map(self.byte_ids.__getitem__, reversed(unit[end - 1].encode())))
            end -= length or 1
        out.reverse()
        return out

    def cut(self, text: str) -> list[str]:
        """The units of a text, with a space in front; no piece reaches from a character over the spaces behind it."""
        return _UNIT.findall(" " + text.replace(BLANK, " ")) if text else []

    def encode(self, text: str | None, end: bool = False) -> list[int]:
        return [i for unit in self.cut(text or "") for i in self.tokens(unit.replace(" ", BLANK))] + [self.end] * end

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are nothing, bytes are read together, and one space at the front goes."""
        out: list[str] = []
        raw, first = bytearray(), True
        for i in ids:
            if not 0 <= i < self.size:
                raise IndexError(f"there is no id {i}")
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "chorale-each-byte"))
                raw.clear()
            if i in self.control:
                continue
            name = " ⁇ " if i == self.unknown else self.names[i]
            if first and not any(out) and name.startswith(BLANK):
                name, first = name[1:], False
            out.append(name.replace(BLANK, " "))
        if raw:
            out.append(raw.decode("utf-8", "chorale-each-byte"))
        return "".join(out)

    def spell(self, unit: str) -> str:
        """The ids of a unit as text. What they decode to behind another unit is nearly always the unit; if not, it goes to ``odd``."""
        ids = self.tokens(unit.replace(" ", BLANK))
        if self.byte_of.keys().isdisjoint(ids):
            back = "".join(map(self.names.__getitem__, ids)).replace(BLANK, " ")
        else:
            back = self.decode([self.byte_ids[0], *ids])[1:]
        if back != unit:
            self.odd[unit] = back
        return " ".join(map(self.spelled.__getitem__, ids))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids with the end's, and the hashes of the ids and of the text that they decode to."""
        ids, back, count = sha256(), sha256(), 1
        units = self.cut(text or "")
        for start in range(0, len(units), 1 << 16):
            part = units[start : start + (1 << 16)]
            spelled = " ".join(map(self.units.__getitem__, part)) + " "
            count += spelled.count(" ")
            ids.update(spelled.encode())
            if self.odd and not self.odd.keys().isdisjoint(part):
                part = [self.odd.get(unit, unit) for unit in part]
            back.update("".join(part)[0 if start else 1 :].encode())
        ids.update(str(self.end).encode())
        return count, ids.hexdigest(), back.hexdigest()


_UNIT = re.compile(" *[^ ]+| +$")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(text: Column, vocabulary: str = VOCABULARY, end: bool = True) -> Column:
    """Ids of whole texts, as an array; a null text is empty."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        model = pieces(vocabulary_path(vocabulary))
        return pa.array((model.encode(t.as_py(), end) for t in texts), pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of an array of ids; null for null. An id that the model doesn't have is an error."""

    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        model = pieces(vocabulary_path(vocabulary))
        return pa.array((None if r.as_py() is None else model.decode(r.as_py()) for r in rows), pa.string())

    return text(ids)


def piece_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens (with the end's), ids_sha256 and decoded_sha256 of every row; a null text is empty: the end alone.

    Very long texts are taken in parts of units, each in time linear in its length; repeated rows are equal, ties can't be,
    and an empty table gives an empty result. Other columns of ``docs`` are left out, whatever their names.
    """
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pa.Array) -> pa.Array:
        model = pieces(vocabulary_path(VOCABULARY))
        return pa.array([dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), model.digest(t.as_py()))) for t in texts], kind)

    return docs.select("doc_id", digest("text").alias("found")).select("doc_id", "found.*")
