"""What the training-data operators share: durable cuts, column names that cannot clash, stable random numbers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import durable, shared_folder  # noqa: F401  (the operators take them from here)

#: Bytes up to which a side of a join may be broadcast, at so many for a row; beyond it the join shuffles.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 100


def freed(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function after which memory that it has freed goes back to the machine: Python workers outlive their tasks, and
    what one stage needed would stay with them through the next ones."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_text(doc_id: str) -> Column:
    """The id as text; a missing id counts as the empty text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``: the fixed split into training and held-out documents."""
    return F.crc32(id_text(doc_id)) % modulus


def sized_join(left: DataFrame, right: DataFrame, on, how: str, rows: int | None = None) -> DataFrame:
    """Join that broadcasts ``right`` only after its counted rows are known to be small, and shuffles otherwise."""
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if rows * ROW_BYTES <= BROADCAST_BYTES else right, on, how)
