"""One-pass scan reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_report(rows: DataFrame, duration: Column, time: Column, exportable: Column, size: Column, *more: Column) -> DataFrame:
    """matched, rejected, durations, first and last time, exportable rows and their bytes, and ``more``, in one aggregation."""
    known = duration > 0
    return rows.agg(
        F.count("*").alias("matched"),
        F.coalesce(F.sum(F.when(known, duration)), F.lit(0)).alias("total_duration"),
        F.count_if(known).alias("known_duration"),
        F.greatest(F.count("*") - F.count_if(known), F.lit(0)).alias("unknown_duration"),
        F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        F.count_if(exportable).alias("exportable"),
        F.greatest(F.count("*") - F.count_if(exportable), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.when(exportable, size)), F.lit(0)).alias("payload_bytes"),
        *more,
    )


def counts(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return rows.groupBy(F.lower(F.coalesce(key.cast("string"), F.lit("unknown"))).alias(name)).agg(F.count("*").alias("n"))


def counts_map(rows: DataFrame, key: Column) -> DataFrame:
    """One row with a map from key to count; keys fold case."""
    return counts(rows, key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "n")))).alias("counts"))


def repeated(rows: DataFrame, value: Column) -> DataFrame:
    """How many rows repeat another one's value: the sum of n - 1."""
    return rows.groupBy(value.alias("v")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("suspected_duplicates"))


def exit_code(matched: Column, failures: Column, query_failed: Column) -> Column:
    """0 ok, 1 query failure, 3 some items failed, 4 nothing matched (fixed values)."""
    return F.when(query_failed, 1).when(matched == 0, 4).when(failures == 0, 0).otherwise(3)
