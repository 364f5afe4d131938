"""Comparing what is expected with what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, actual: DataFrame, key: str, fields: list[str], codes: dict[str, str] | None = None) -> DataFrame:
    """(key, issue) for keys that are missing, extra, duplicate, or differ in a field; null equals null."""
    codes = {"missing": "missing", "extra": "extra", "mismatch": "mismatch", "duplicate": "duplicate"} | (codes or {})
    twice = actual.groupBy(key).count().where("count > 1").select(key, F.lit(codes["duplicate"]).alias("issue"))
    left = expected.select(key, F.struct(*fields).alias("_e"), F.lit(True).alias("_in"))
    right = actual.groupBy(key).agg(F.min(F.struct(*fields)).alias("_a"), F.lit(True).alias("_there"))
    both = left.join(right, key, "full_outer")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"_e.{f}").eqNullSafe(F.col(f"_a.{f}"))
    issue = F.when(F.col("_there").isNull(), codes["missing"]).when(F.col("_in").isNull(), codes["extra"]).when(~same, codes["mismatch"])
    return both.select(key, issue.alias("issue")).where(F.col("issue").isNotNull()).unionByName(twice)


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``left`` that ``right`` lacks, folding case."""
    folded = lambda df: df.select(F.lower(F.col(column).cast("string")).alias(column)).distinct()
    return folded(left).join(folded(right), column, "left_anti")


def symmetric_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    only = lambda a, b, side: set_difference(a, b, column).withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def distinct_fold(rows: DataFrame, value: Column, order: Column) -> DataFrame:
    """One spelling of each value, folding case: the first by ``order``."""
    return rows.where(value.rlike(r"\S")).groupBy(F.lower(F.trim(value)).alias("folded")).agg(F.min_by(F.trim(value), order).alias("value"))


def outside(ids: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Requested ids that no item has."""
    return ids.join(items.select(key).distinct(), key, "left_anti")
