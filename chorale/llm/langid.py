"""Language identification by words first, then by ever shorter character n-grams.

A known word scores its log frequency in each language. An unseen word falls back to its known 4-grams, else to its
3-grams, 2-grams and single characters. The model is fitted on a bounded sample of the labelled documents, shared evenly
among the languages and bounded in documents and characters, and keeps every word and n-gram of it, so its size does not
grow with the corpus. Words and n-grams are named by 64 bits, and the model is sorted arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from xxhash import xxh3_64_intdigest

from .common import freed, fresh, id_remainder

#: Labelled documents to learn from: each language has an equal share, of which it uses all its documents or, of more, a
#: sample expected to fill the share. All languages are kept; labels of more than LANGUAGES are refused.
SAMPLE_DOCS, LANGUAGES = 8_000, 512
#: Characters that the sample is expected to have at most, shared evenly too; long documents lower its number of documents.
SAMPLE_CHARS = 1 << 25
LONGEST = 4
UNDETERMINED = "und"
#: Of every FOLDS documents by their ids' crc32, one is held out.
FOLDS = 5
#: Pieces, and numbers in their rows, that a task remembers.
CACHE, CACHE_CELLS = 50_000, 1 << 24

#: Characters of a text that are split into pieces at once.
SLICE = 1 << 18
#: An odd multiplier that mixes the code points of a 4-gram into 64 bits.
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: A run of letters, which may hold numerals that are no digits; these are cut out of the few runs that have them.
_RUN = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s")


def words_of(text: str) -> list[str]:
    """The runs of letters (Unicode's L, as the training's ``\\p{L}+``)."""
    runs = _RUN.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [w for r in runs for w in "".join(c if c.isalpha() else " " for c in r).split(" ") if w]


def slices(text: str) -> Iterator[str]:
    """Parts of a text of SLICE characters or more, cut before white space; a longer run without any stays whole."""
    start = 0
    while start < len(text):
        space = _SPACE.search(text, start + SLICE)
        end = space.start() if space else len(text)
        yield text[start:end]
        start = end


def word_key(word: str) -> int:
    """64 bits that name a word in the model. Of a model of a million words, one unseen word in 2e13 is taken for another."""
    return xxh3_64_intdigest(word)


def gram_keys(points: np.ndarray, n: int) -> np.ndarray:
    """Key of the n-gram that starts at each code point; up to three of them are packed whole, four are mixed."""
    out = points[: len(points) - n + 1].astype(np.uint64)
    for i in range(1, n):
        out = (out * _MIX if n > 3 else out << np.uint64(21)) + points[i : len(points) - n + 1 + i]
    return out


def padded_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, a space before each and one after the last, and each word's number of them (with one space)."""
    text = " " + " ".join(words) + " "
    return np.frombuffer(text.encode("utf-32-le"), "<u4"), np.fromiter(map(len, words), np.int64, len(words)) + 1


def within(starts: np.ndarray, sizes: np.ndarray, n: int, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places where an n-gram of a padded word starts, and the word's number: the word has ``size + 2 - n`` of them."""
    many = np.maximum(sizes + 2 - n, 0)
    place = np.arange(many.sum()) + np.repeat(starts - (np.cumsum(many) - many), many)
    return place, np.repeat(np.arange(len(sizes)) if word is None else word, many)


_COUNTED = pa.schema([("l", pa.string()), ("n", pa.int32()), ("k", pa.int64()), ("c", pa.int64())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words' keys (n = 0) and of those of their n-grams, added up for each batch; the work is linear in a word's length."""
    for batch in batches:
        for lang in pc.unique(batch["l"]).to_pylist():
            own = batch.filter(pc.equal(batch["l"], lang))
            words, counts = own["g"].to_pylist(), own["c"].to_numpy()
            points, sizes = padded_points(words)
            starts = np.cumsum(sizes) - sizes
            for n in range(LONGEST + 1):
                if n:
                    place, word = within(starts, sizes, n)
                    keys, rows = np.unique(gram_keys(points, n)[place], return_inverse=True)
                    found = np.bincount(rows, counts[word], len(keys)).astype(np.int64)
                else:
                    keys, found = np.fromiter(map(word_key, words), np.uint64, len(words)), counts
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(found)], schema=_COUNTED)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> dict:
    """Model from the training documents: ``langs``, and for n = 0 (words) to LONGEST the sorted ``keys`` of a table. Its i-th key
    has the row ``first[n] + i``, with the entries from ``starts[row]`` to ``starts[row + 1]``: languages ``at``, and how far
    their log frequency is above the floor, ``gain``."""
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (id_remainder(doc_id, FOLDS) != 0))
    labelled = labelled.select(F.col(lang).alias("l"), F.lower(F.col(text)).alias("t"), F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 30)).alias("h"))
    counted = labelled.groupBy("l").agg(F.count("*").alias("n"), F.min("h").alias("h"), F.sum(F.length("t")).alias("chars")).orderBy(F.desc("n"), "l").limit(LANGUAGES + 1).collect()
    if len(counted) > LANGUAGES:
        raise ValueError(f"the documents are labelled with more than {LANGUAGES} languages")
    langs = [r["l"] for r in counted]
    # Up to its least hash at least, so that no language is missed by the sample.
    share = lambda r: min(1.0, sample_docs / len(langs) / r["n"], SAMPLE_CHARS / len(langs) / max(r["chars"], 1))
    rates = [(r["l"], max(int(share(r) * (1 << 30)), r["h"] + 1)) for r in counted]
    sample = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(rates, "l string, below long")), "l").where("h < below")
    words = sample.select("l", F.explode(F.regexp_extract_all("t", F.lit(r"(\p{L}+)"))).alias("g")).groupBy("l", "g").agg(F.count("*").alias("c"))
    every = words.mapInArrow(freed(_cut), "l string, n int, k long, c long").groupBy("l", "n", "k").agg(F.sum("c").alias("c"))
    rows = every.toArrow().combine_chunks()  # the words and n-grams of the sample
    n_of, key, count = rows["n"].to_numpy(), rows["k"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    code = pc.index_in(rows["l"], pa.array(langs, pa.string())).to_numpy()
    keys, sizes, at, gain, first = [], [], [], [], [0]
    for n in range(LONGEST + 1):
        own = np.flatnonzero(n_of == n)
        own = own[np.lexsort((code[own], key[own]))]
        named, many = np.unique(key[own], return_counts=True)
        total = np.bincount(code[own], count[own], len(langs))
        # One floor for all languages: else a language of few documents would win by what none of them holds.
        floor = 0.5 / (total.max(initial=0) + 0.5 * len(named) + 1)
        keys.append(named)
        sizes.append(many)
        at.append(code[own].astype(np.uint16))
        gain.append(np.log1p(count[own] / total[code[own]] / floor).astype(np.float32))
        first.append(first[-1] + len(named))
    return {"langs": langs, "keys": keys, "first": first, "starts": np.concatenate([[0], *sizes]).cumsum(), "at": np.concatenate(at), "gain": np.concatenate(gain)}


class Scorer:
    """Scores texts with a model. Pieces between spaces repeat, so each keeps a row with the sum of its words' scores
    and, last, their number; the rows of a text's new pieces are computed together."""

    def __init__(self, model: dict):
        self.langs, self.keys, self.first = model["langs"], model["keys"], model["first"]
        self.size = len(self.langs)
        self.starts, self.at, self.gain = model["starts"], model["at"], model["gain"]
        self.limit = min(CACHE, CACHE_CELLS // (self.size + 1))
        scorer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> int:
                self[piece] = row = len(self)
                scorer.pending.append(words_of(piece.lower()))
                return row

        self.pieces, self.pending = Pieces(), []
        self.rows = np.zeros((4096, self.size + 1), np.float32)

    def find(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys in table n, and -1 for those that it does not have."""
        table = self.keys[n]
        if not len(table):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[place] == keys, place + self.first[n], -1)

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the model whose mean scores each word, and the number of the word they belong to; none if nothing is known."""
        row = self.find(0, np.fromiter(map(word_key, words), np.uint64, len(words)))
        rows, owners = [row[row >= 0]], [np.flatnonzero(row >= 0)]
        left = np.flatnonzero(row < 0)
        points, sizes = padded_points([words[i] for i in left])
        starts = np.cumsum(sizes) - sizes
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            place, owner = within(starts, sizes, n, left)
            row = self.find(n, gram_keys(points, n)[place])
            rows.append(row[row >= 0])
            owners.append(owner[row >= 0])
            still = ~np.isin(left, owners[-1])
            left, sizes, starts = left[still], sizes[still], starts[still]
        return np.concatenate(rows), np.concatenate(owners)

    def _settle(self) -> None:
        """Rows of the pieces that were new."""
        last = len(self.pieces)
        first = last - len(self.pending)
        while last > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        new = self.rows[first:last]
        new[:] = 0
        words = [w for piece in self.pending for w in piece]
        if words:
            piece = np.repeat(np.arange(last - first), [len(p) for p in self.pending])
            row, owner = self.known(words)
            share = 1 / np.maximum(np.bincount(owner, minlength=len(words)), 1)
            many = self.starts[row + 1] - self.starts[row]
            entry = np.arange(many.sum()) + np.repeat(self.starts[row] - (np.cumsum(many) - many), many)
            owner = np.repeat(owner, many)
            np.add.at(new, (piece[owner], self.at[entry]), (self.gain[entry] * share[owner]).astype(np.float32))
            new[:, -1] = np.bincount(piece, minlength=last - first)
        self.pending = []

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNDETERMINED, 0.0
        total = np.zeros(self.size + 1)
        for part in slices(text):
            if len(self.pieces) > self.limit:
                self.pieces.clear()
            parts = part.split()
            rows = np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts))
            if self.pending:
                self._settle()
            total += self.rows[rows].sum(axis=0, dtype=np.float64)
        if not total[-1]:
            return UNDETERMINED, 0.0
        best = int(np.argmax(total[:-1]))
        return self.langs[best], float(1 / np.exp(np.maximum(total[:-1] - total[best], -700)).sum())


def _scorer(model: dict) -> Scorer:
    """The model's scorer, kept with it: a Python worker drops both once its tasks use another broadcast."""
    if "scorer" not in model:
        model["scorer"] = Scorer(model)
    return model["scorer"]


def _judged(docs: DataFrame, model: dict | None, text: str, lang: str, doc_id: str) -> tuple[DataFrame, str]:
    """``docs`` with a column of a new name: a struct of lang_pred and score."""
    model = fit(docs, text, lang, doc_id) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see SAMPLE_DOCS and LANGUAGES
    (found,) = fresh(docs, "_found")
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @freed
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(shared.value)
        for texts in batches:
            yield pa.array([dict(zip(("lang_pred", "score"), scorer.predict(t.as_py()))) for t in texts], kind)

    predict = F.arrow_udf(judge, "lang_pred string, score double", ArrowUDFType.SCALAR_ITER)
    return docs.withColumn(found, predict(F.col(text))), found


def identify(docs: DataFrame, model: dict | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1, the posterior under equal priors); columns of these names are replaced.

    Without a model, one is fitted on ``docs`` first. A null text, or one without a letter, is ``und`` with score 0; so
    is every text if there is no labelled document. Ties go to the more frequent language. Repeated rows are judged
    alike, and an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    judged, found = _judged(docs, model, text, lang, doc_id)
    return judged.select(*kept, f"{found}.lang_pred", f"{found}.score")


def lang_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, as ``identify`` judges nulls, empty texts, ties and repeats; a null
    id is split as the empty text. Other columns of ``docs`` are left out, whatever their names."""
    thin = docs.select("doc_id", "text", "lang")
    return identify(thin).select("doc_id", (id_remainder("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", "score")


#: Smallest score of a document that the pipeline keeps: below it no language has a third of the posterior.
LEAST_SCORE = 0.3


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is determined, with all their columns as they were; ``lang`` is only learned from.

    Null texts, and texts without a letter, go, as do those whose score is below LEAST_SCORE; repeated rows share a fate; an
    empty table stays empty. Very long texts and unbroken runs are judged whole, in time linear in their length. Columns of
    any name, ``score`` and ``lang_pred`` too, pass through.
    """
    judged, found = _judged(docs, None, "text", "lang", "doc_id")
    return judged.where((F.col(f"{found}.lang_pred") != UNDETERMINED) & (F.col(f"{found}.score") >= LEAST_SCORE)).select(*docs.columns)
