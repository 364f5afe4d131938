"""Scoring documents with a context-tree-weighting byte model learned from the corpus, beside a word unigram base.

The model may be larger than any task's memory, so it is never gathered. The table is worked through in chunks of
consecutive rows, cut by rows and by bytes. Each chunk lists its different byte n-grams and words with their training
counts and sends each bucket its part. The lists of a bucket are dealt over as many shares as their entries fill; each
share merges its own, and the shares' sums, which hold an n-gram once each, make the bucket's model: the context trees
below its pairs of nearest bytes. The model goes back to each share, which answers its chunks with the log probability
(for a word: the count) of just what they listed, in their order. The nodes nearest to the root, at most 256 by 255 of
them, are summed up once and told to all. At last each chunk meets its answers and scores its texts. Texts are shuffled
once; what the model learns from grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ctw
from .common import durable, id_remainder, sized_join
from .wordbytes import joined, mix64, per_text, slices, word_hashes

#: Bytes of context.
DEPTH = 5
#: Of every FOLDS documents by their ids' crc32, one is held out.
FOLDS = 10
#: Rows and bytes of text at which a chunk ends.
CHUNK_ROWS, CHUNK_BYTES = 8192, 16 << 20
#: Listed entries of a bucket for each share.
SHARE_ENTRIES = 16 << 20
#: Bytes of text for each bucket of the model.
BUCKET_BYTES = 32 << 20
END = b"\xff"  # ends each text; no UTF-8 text holds it
LOG10 = np.log10

GRAM, WORD, CHECK = 0, 1, 2
_REQUEST = "kind int, bucket int, chunk long, n long, keys binary, counts binary, trained long"
_MODEL = "kind int, bucket int, n long, keys binary, counts binary"
_ANSWER = "kind int, bucket int, chunk long, n long, value binary"


def _shrink(values: np.ndarray) -> bytes:
    """Bytes of an array, place by place, compressed."""
    width = values.dtype.itemsize
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), "zstd", asbytes=True)


def _grow(blob: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(pa.decompress(blob, n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel()


def _sorted_blob(keys: np.ndarray) -> bytes:
    return _shrink(np.diff(keys, prepend=np.uint64(0)))


def _sorted_keys(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_grow(blob, n, np.uint64), dtype=np.uint64)


class Slice:
    """Some texts as n-grams and words, each with the number of its text."""

    def __init__(self, texts: list[str | None], depth: int):
        data, starts, ends = joined(texts, b"\n" * depth, END)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends + 1] -= 1
        place = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8)) if len(data) else np.zeros(0, int)
        self.grams = ctw.grams(data, depth)[place - depth]
        self.gram_text = np.repeat(np.arange(len(texts)), ends - starts + 1)
        spaced = data.copy()
        spaced[ends] = 32
        self.words, at = word_hashes(spaced)
        self.word_text = per_text(at, starts)


def _tables(texts: pa.Array, train: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted different n-grams, and words, of the texts with their counts in the training texts."""
    parts: list[list] = [[], []]
    for first, last in slices(texts):
        s = Slice(texts[first:last].to_pylist(), depth)
        for out, keys, text in ((parts[GRAM], s.grams, s.gram_text), (parts[WORD], s.words, s.word_text)):
            learn = train[first:last][text]
            found, counts = np.unique(keys[learn], return_counts=True)
            out.append((found, counts))
            rest = np.unique(keys[~learn])
            out.append((rest, np.zeros(len(rest), np.int64)))
        if len(parts[GRAM]) > 6:
            parts = [[ctw.merge(*map(np.concatenate, zip(*p)))] for p in parts]
    return [ctw.merge(*map(np.concatenate, zip(*p))) if p else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for p in parts]


def _buckets(kind: int, keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """n-grams with the same two nearest bytes share a bucket."""
    own = mix64(keys >> np.uint64(8 * (depth - 1))) if kind == GRAM else keys
    return ((own >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)


def _parts(kind: int, keys: np.ndarray, depth: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of the keys of each bucket, in the order of the keys."""
    bucket = _buckets(kind, keys, depth, buckets)
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def _requests(depth: int, buckets: int):
    def run(batches):
        def chunk_rows(chunk, texts, train):
            tables = _tables(texts, train, depth)
            rows = [(CHECK, 0, chunk, len(texts), b"", b"", int(train.sum()))]
            for kind, (keys, counts) in enumerate(tables):
                for bucket, part in _parts(kind, keys, depth, buckets):
                    rows.append((kind, bucket, chunk, len(part), _sorted_blob(keys[part]), _shrink(counts[part].astype(np.uint64)), 0))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=_schema(_REQUEST))

        held: list[pa.RecordBatch] = []
        for batch in _by_chunk(batches):
            if held and batch.column(0)[0].as_py() != held[0].column(0)[0].as_py():
                yield chunk_rows(*_chunk(pa.Table.from_batches(held)))
                held = []
            held.append(batch)
        if held:
            yield chunk_rows(*_chunk(pa.Table.from_batches(held)))

    return run


def _by_chunk(batches):
    """Batches of (text, ...) cut where a chunk ends, with its number before the other columns: the task's number and a
    running one. A text longer than a chunk is a chunk of its own."""
    number, rows, size = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        first, lengths = 0, pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist()

        def cut(last):
            part = batch.slice(first, last - first)
            return pa.RecordBatch.from_arrays([pa.array(np.full(last - first, number)), *part.columns], ["chunk", *part.schema.names])

        for i, n in enumerate(lengths):
            if rows and (rows >= CHUNK_ROWS or size + n > CHUNK_BYTES):
                if i > first:
                    yield cut(i)
                first, number, rows, size = i, number + 1, 0, 0
            rows, size = rows + 1, size + n
        if len(lengths) > first:
            yield cut(len(lengths))


def _chunk(table: pa.Table):
    texts = table.column("text").cast(pa.large_string()).combine_chunks()  # one array, whatever the bytes
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks or [pa.array([], pa.large_string())])
    return table.column("chunk")[0].as_py(), texts, table.column("train").to_numpy().astype(bool)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with their counts over all lists, taking them in one by one."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for n, keys, counts in zip(table["n"].to_pylist(), table["keys"], table["counts"]):
        held.append((_sorted_keys(keys.as_py(), n), _grow(counts.as_py(), n, np.uint64).astype(np.int64)))
        if len(held) > 16:
            held = [ctw.merge(*map(np.concatenate, zip(*held)))]
    return ctw.merge(*map(np.concatenate, zip(*held)))


def _merged(table: pa.Table) -> pa.Table:
    """The lists of a bucket, or of a share of it, as one row of the model."""
    keys, counts = _summed(table)
    row = (table["kind"][0].as_py(), table["bucket"][0].as_py(), len(keys), _sorted_blob(keys), _shrink(counts.astype(np.uint64)))
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, _schema(_MODEL).types)], schema=_schema(_MODEL))


_TOP = "nearest int, place int, zeros double, ones double, below double"


def _near_root(depth: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key, *sums = ctw.top_sums(ctw.subtree(*_summed(pa.Table.from_batches([batch.slice(i, 1)])), depth, 2))
                yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(8)).astype(np.int32)), pa.array((key & np.uint64(0xFF)).astype(np.int32)), *map(pa.array, sums)], schema=_schema(_TOP))

    return run


def _answers(depth: int, top):
    def run(lists: pa.Table, model: pa.Table) -> pa.Table:
        rows = []
        if lists.num_rows:
            kind, bucket = lists["kind"][0].as_py(), lists["bucket"][0].as_py()
            keys, counts = _summed(model)
            if kind == GRAM:
                deep = ctw.deep_probabilities(keys, ctw.subtree(keys, counts, depth, 2), depth)
                byte = keys & np.uint64(0xFF)
                for at, nodes in zip((1, 0), top.value):
                    context = keys >> np.uint64(8 * depth) if at else np.zeros_like(keys)
                    deep = nodes.mix(context, byte, deep, bottom=False)
                value = LOG10(deep).sum(axis=0).astype(np.float32)
            else:
                value = counts.astype(np.uint64)
            for chunk, n, blob in zip(lists["chunk"].to_pylist(), lists["n"].to_pylist(), lists["keys"]):
                rows.append((kind, bucket, chunk, n, _shrink(value[np.searchsorted(keys, _sorted_keys(blob.as_py(), n))])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, _schema(_ANSWER).types)], schema=_schema(_ANSWER))

    return run


def _word_sums(batches):
    """Tokens and different words of the training texts, of each bucket of words."""
    for batch in batches:
        counts = [_summed(pa.Table.from_batches([batch.slice(i, 1)]))[1] for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c > 0).sum()) for c in counts], pa.int64())], ["trained", "known"])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, score double, n_bytes long"


def _scores(depth: int, buckets: int, end_count: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in _schema(_SCORED).types], schema=_schema(_SCORED))
        _, texts, train = _chunk(left)
        values: dict = {(k, b): (n, v) for k, b, n, v in zip(*(right[c].to_pylist() for c in ("kind", "bucket", "n", "value")))}
        lookups, filled = [], []
        for kind, (keys, _) in enumerate(_tables(texts, train, depth)):
            out = np.zeros(len(keys), np.float64)
            for bucket, part in _parts(kind, keys, depth, buckets):
                n, blob = values.get((kind, bucket), (-1, b""))
                if n != len(part):
                    raise RuntimeError("the rows came in another order the second time; pass a stored table, or repeatable=False")
                out[part] = _grow(blob, n, np.float32 if kind == GRAM else np.uint64)
            lookups.append(ctw.Lookup(keys))
            filled.append(out)
        size = len(texts)
        score, known, tokens, logs = (np.zeros(size) for _ in range(4))
        for first, last in slices(texts):
            s, n = Slice(texts[first:last].to_pylist(), depth), last - first
            score[first:last] = np.bincount(s.gram_text, filled[GRAM][lookups[GRAM](s.grams)], n)
            if len(s.words):
                count = filled[WORD][lookups[WORD](s.words)]
                tokens[first:last] = np.bincount(s.word_text, minlength=n)
                known[first:last] = np.bincount(s.word_text, count > 0, n)
                logs[first:last] = np.bincount(s.word_text, LOG10(count + 0.1), n)
        columns = (left["doc_id"], ~train, tokens + 1, known + (end_count > 0), logs + LOG10(end_count + 0.1), score, pc.fill_null(pc.binary_length(texts), 0))
        types = _schema(_SCORED).types
        return pa.table([c.cast(t) if isinstance(c, (pa.ChunkedArray, pa.Array)) else pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types)], schema=_schema(_SCORED))

    return run


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, repeatable: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row.

    ``score`` is the log10 probability of the lower-cased (A-Z) bytes of the whole text and of its end; a null text is
    empty and has its end alone. The model learns from the documents whose crc32 of the id's text (null: empty) modulo
    FOLDS is not 0. Repeated rows are scored, and learned from, each. An empty table gives an empty result. ``docs`` is
    read twice and must come in the same order both times, as a stored table does; if it may not, ``repeatable=False``
    stores it first.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = base if repeatable else durable(base)
    base = base.select("text", "doc_id", (id_remainder("doc_id", FOLDS) != 0).alias("train"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(4, -(-size // BUCKET_BYTES))

    requests = durable(base.select("text", "train").mapInArrow(_requests(depth, buckets), _REQUEST))
    lists = requests.where(F.col("kind") != CHECK)
    shares = lists.groupBy("kind", "bucket").agg(F.ceil(F.sum("n") / SHARE_ENTRIES).cast("int").alias("shares"))
    several = durable(shares.where("shares > 1"))
    lists = sized_join(lists, several, ["kind", "bucket"], "left").withColumn("share", F.pmod(F.xxhash64("chunk"), F.coalesce("shares", F.lit(1))))
    # A bucket of one share is merged at once; the others are merged share by share first.
    one, many = (lists.where(test).select("kind", "bucket", "share", "n", "keys", "counts") for test in (F.col("shares").isNull(), F.col("shares").isNotNull()))
    merged = many.groupBy("kind", "bucket", "share").applyInArrow(_merged, _MODEL)
    model = durable(one.drop("share").unionByName(merged).groupBy("kind", "bucket").applyInArrow(_merged, _MODEL))

    near = model.where(F.col("kind") == GRAM).mapInArrow(_near_root(depth), _TOP)
    tables = np.zeros((3, 256, 256))
    for r in near.groupBy("nearest", "place").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect():  # at most 256 x 255
        tables[:, r[0], r[1]] = r[2:]
    top = spark.sparkContext.broadcast(ctw.join_top(*tables))

    ends = requests.where(F.col("kind") == CHECK).agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]
    words = model.where(F.col("kind") == WORD).mapInArrow(_word_sums, "trained long, known long")
    tokens, distinct = words.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    tokens, distinct = tokens + ends, distinct + (ends > 0)

    spread = sized_join(model, several, ["kind", "bucket"], "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1)).cast("long") - 1)))
    asked = lists.select("kind", "bucket", F.col("share").cast("long").alias("share"), "chunk", "n", "keys")
    share = ["kind", "bucket", "share"]
    replies = durable(asked.groupBy(share).cogroup(spread.select(*share, "n", "keys", "counts").groupBy(share)).applyInArrow(_answers(depth, top), _ANSWER))
    numbered = base.mapInArrow(_by_chunk, "chunk long, text string, doc_id long, train boolean")
    scored = numbered.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_scores(depth, buckets, ends), _SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") - F.col("n_tokens") * F.lit(float(LOG10(tokens + 0.1 * (distinct + 1))))).alias("base_score"),
        "score", (-F.col("score") / F.lit(float(LOG10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
