"""Positions in a long order, and digests over it, without a task that sees all rows."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable

#: Lines, or digests, of which one digest is made; levels of digests.
DIGEST_LINES, LEVELS = 4096, 3


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number from 0 in ``order``, which must tell rows apart.

    The rows are range-partitioned by the order and sorted in place, and written once; each partition's rows are counted, and
    the sums of the counts before it, a number for each partition, are sent to it.
    """
    index = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_index": index}))
    counts = placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row for each partition
    before = [0, *accumulate(r["n"] for r in counts)]
    starts = rows.sparkSession.createDataFrame([(r["_part"], b) for r, b in zip(counts, before)], "_part int, _start long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_index")).drop("_part", "_start", "_index")


def ordered_digest(rows: DataFrame, key: list[str], order: list[Column], line: Column, per: int = DIGEST_LINES) -> DataFrame:
    """``fingerprint`` and ``n`` of each key (of all rows, without keys): a tree of sha256 over the lines in their order.

    A leaf digests ``per`` lines, a node ``per`` digests (64 hex digits and a line end each), and after LEVELS - 1 levels the
    root digests the rest. So no value or task grows with a key's rows but the root's, by a line for each ``per ** 2`` of them.
    Rows of one key must differ in ``order``; an empty table without keys has no row.
    """
    placed = numbered(rows.select(*key, line.alias("_line"), F.struct(*order).alias("_order")), [*map(F.col, key), F.col("_order")], "_at").drop("_order")
    if key:
        own = [F.col(k).alias(f"_key{i}") for i, k in enumerate(key)]
        first = placed.groupBy(*own).agg(F.min("_at").alias("_first"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)])
        placed = placed.join(first, same).withColumn("_at", F.col("_at") - F.col("_first"))
    nodes = placed.select(*key, "_at", "_line", F.lit(1).cast("long").alias("_n"))
    for level in range(LEVELS):
        group = F.floor(F.col("_at") / per) if level < LEVELS - 1 else (F.col("_at") < 0).cast("long")  # the root
        digest = F.expr("sha2(listagg(_line, '') WITHIN GROUP (ORDER BY _at), 256)")
        grouped = nodes.groupBy(*key, group.alias("_group")).agg(digest.alias("_line"), F.sum("_n").alias("_n"))
        nodes = grouped.select(*key, F.col("_group").alias("_at"), F.concat("_line", F.lit("\n")).alias("_line"), "_n")
    return nodes.select(*key, F.rtrim("_line", F.lit("\n")).alias("fingerprint"), F.col("_n").alias("n"))
