"""Sharding by sampled splitters.

Records are put in the order of (key, tie): a hash of the text, then a hash of the id and the row's number, so that equal
texts lie side by side and even one text that fills the whole table can be cut. A sample of these pairs, weighted by size
and by rows, gives quantile boundaries, which cut the order into many fine ranges. The ranges are measured over all rows;
those that came out overfull are sampled again and divided further. A prefix sum over the measured ranges and a running
sum inside each of them place every record on the line of bytes, and the shard follows from its place there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, id_text

#: Law that the shards obey.
LAW = "bytes"
#: Rows that a range should hold, and the least and the most ranges (each boundary is a literal in the plan).
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 2_000_000, 64, 8192
#: Sampled rows for each boundary.
PER_BOUNDARY = 32


def _rank_among(boundaries: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """How many of the sorted boundaries are at or below (key, tie), by binary search."""
    levels = max(1, len(boundaries).bit_length())
    highest = (1 << 63) - 1
    padded = boundaries + [(highest, highest)] * ((1 << levels) - 1 - len(boundaries))
    keys, ties = (F.from_json(F.lit(str([b[i] for b in padded])), "array<bigint>") for i in (0, 1))  # folds into one literal
    widths = F.array(*[F.lit(1 << level) for level in reversed(range(levels))])

    def narrow(found: Column, width: Column) -> Column:
        at = found + width - 1
        below = (keys[at] < key) | ((keys[at] == key) & (ties[at] <= tie))
        return found + F.when(below, width).otherwise(0)

    return F.aggregate(widths, F.lit(0), narrow)


def _boundaries(rows: DataFrame, value: Column, tie: Column, chance: Column, pieces: int) -> list[tuple[int, int]]:
    """Quantiles that cut the rows into ``pieces``, of the rows drawn with probability ``chance`` by a repeatable hash."""
    draw = F.shiftrightunsigned(F.xxhash64(value, tie, F.lit("draw")), 11) / F.lit(float(1 << 53))
    drawn = rows.where(draw < chance).select(value.alias("k"), tie.alias("t"))
    ordered = drawn.agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("s"))  # about PER_BOUNDARY * pieces
    at = F.transform(F.sequence(F.lit(1), F.lit(max(pieces - 1, 1))), lambda i: (i * F.size("s") / F.lit(pieces)).cast("int"))
    found = ordered.select(F.when(F.size("s") > 0, F.array_distinct(F.transform(at, lambda i: F.col("s")[i]))).alias("b")).first()[0]
    return [(b["k"], b["t"]) for b in found or []]


def assign_shards(docs: DataFrame, shards: int = 8, size: str = "size", key: str = "key", tie: str | None = None, ranges: int | None = None) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (its place in the shard, gapless from 0).

    ``size`` is a non-negative long, ``key`` and ``tie`` longs of at most 40 bits for ``tie``; null counts as 0. Records lie
    in the order of key, tie and a hash of the row's number; one belongs to the shard in which its middle lies on the line
    of sizes, so the shards' sums differ by no more than twice the largest record, and the records of a key are cut
    between shards only where a shard ends. If all sizes are 0, each record counts as 1. The samples are expected to hold
    PER_BOUNDARY rows a range, however large the input is, and change no result. An empty table gives an empty result;
    repeated rows are records of their own. Existing columns named ``shard`` or ``slot`` are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    row, span, ahead, number, weighed, before, first = fresh(docs, "_row", "_range", "_ahead", "_number", "_weight", "_before", "_first")
    value = F.coalesce(F.col(key), F.lit(0)).cast("long")
    random = F.xxhash64(F.monotonically_increasing_id())
    last = F.shiftleft(F.coalesce(F.col(tie), F.lit(0)).cast("long"), 23) + F.shiftrightunsigned(random, 41) if tie else F.shiftrightunsigned(random, 1)
    # Stored, as the row's number must not change between the passes.
    base = durable(docs.select(*kept, last.alias(row), F.coalesce(F.col(size), F.lit(0)).cast("long").alias(weighed)))
    total, rows = base.agg(F.coalesce(F.sum(weighed), F.lit(0)), F.count("*")).first()
    weight = F.col(weighed)
    if total == 0:
        weight, total = F.lit(1).cast("long"), max(rows, 1)
    pieces = ranges or min(max(-(-rows // RANGE_ROWS), LEAST_RANGES), MOST_RANGES)

    # Half of the sample is drawn by size, half by rows, so that neither bytes nor small records can crowd a range.
    share = (weight / F.lit(float(total)) + F.lit(1.0 / max(rows, 1))) / 2
    cuts = _boundaries(base, value, F.col(row), share * F.lit(float(PER_BOUNDARY * pieces)), pieces)
    ranged = base.withColumn(span, _rank_among(cuts, value, F.col(row)))
    full = [r[0] for r in ranged.groupBy(span).agg(F.count("*").alias(number)).where(F.col(number) > 2 * rows / pieces).collect()]  # at most half of the ranges
    if full:
        inner = ranged.where(F.col(span).isin(full))
        held = inner.count()
        extra = _boundaries(inner, value, F.col(row), F.lit(min(1.0, PER_BOUNDARY * pieces / held)), pieces)
        cuts = sorted({*cuts, *extra})
        ranged = base.withColumn(span, _rank_among(cuts, value, F.col(row)))

    # Prefix sums over the ranges (at most 2 * MOST_RANGES rows), then inside each range.
    line = Window.orderBy(span)
    starts = ranged.groupBy(span).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    starts = starts.select(span, (F.sum("w").over(line) - F.col("w")).alias(before), (F.sum("n").over(line) - F.col("n")).alias(first))
    inside = Window.partitionBy(span).orderBy(value, row)
    so_far = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - weight
    placed = ranged.withColumns({ahead: so_far, number: F.row_number().over(inside)}).join(F.broadcast(starts), span)
    middle = 2 * (F.col(before) + F.col(ahead)) + weight
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * total)), F.lit(shards - 1)).cast("int")

    # The shard grows along the order, so a record's slot is its number in the whole order less its shard's first number.
    numbered = placed.select(*kept, shard.alias("shard"), (F.col(first) + F.col(number) - 1).alias(number))
    begin = numbered.groupBy("shard").agg(F.min(number).alias(first))
    return numbered.join(F.broadcast(begin), "shard").select(*kept, "shard", (F.col(number) - F.col(first)).cast("long").alias("slot"))  # one row a shard


def _hash_bits(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def _text_key(text: str) -> Column:
    return _hash_bits(F.coalesce(F.col(text), F.lit("")), 15)


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``; a record's size is its text's UTF-8 bytes plus 1."""
    size, key, tie = fresh(docs, "_size", "_key", "_tie")
    sized = docs.withColumns({size: _size(text), key: _text_key(text), tie: _hash_bits(id_text(doc_id), 10)})
    return assign_shards(sized, shards, size, key, tie).drop(size, key, tie)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder for each shard, rows in the order of their slots within each file."""
    sharded.repartition("shard", (F.col("slot") / 100_000).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32 (null for a null text), law, shard, slot, grown_shard (null: the law is not ``key``).

    Null and empty texts have size 1; repeated rows, equal texts and equal ids are records each; an empty table gives an
    empty result. Other columns of ``docs`` are left out, whatever their names.
    """
    thin = docs.select("doc_id", _size("text").alias("size"), F.crc32("text").cast("long").alias("text_crc32"), _text_key("text").alias("key"), _hash_bits(id_text("doc_id"), 10).alias("tie"))
    return assign_shards(thin, shards, tie="tie").select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same shards in DuckDB: one running sum over the whole order, and crc32 byte by byte from its table.
SHARDS_SQL = """
WITH RECURSIVE steps AS (SELECT i AS byte, 0 AS step, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE step < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM steps WHERE step = 8),
texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
coded AS (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM texts, crc),
d AS (SELECT doc_id, text, coalesce(octet_length(encode(text)), 0) + 1 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k,
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10))::BIGINT AS t FROM documents),
p AS (SELECT *, sum(size) OVER (ORDER BY k, t, doc_id ROWS UNBOUNDED PRECEDING) - size AS ahead, row_number() OVER (ORDER BY k, t, doc_id) AS place, sum(size) OVER () AS total FROM d),
s AS (SELECT *, least((2 * ahead + size) * 8 // (2 * total), 7)::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM s LEFT JOIN coded USING (text)
"""
