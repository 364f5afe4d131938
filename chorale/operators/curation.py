"""Choosing training items: duplicate groups, filters, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(items: DataFrame, sha: str, item: str, selected: Column) -> DataFrame:
    """Groups of equal hashes (folding case) with more than one item; a representative only if exactly one is selected."""
    chosen = F.min(F.when(selected, F.col(item)))
    grouped = items.groupBy(F.lower(sha).alias("sha")).agg(F.count("*").alias("size"), F.min(item).alias("first_item"), F.max(item).alias("last_item"), F.count_if(selected).alias("n_selected"), chosen.alias("one"))
    grouped = grouped.where(F.col("size") > 1)
    return grouped.select(
        F.concat(F.lit("duplicate-"), F.substring("sha", 1, 16)).alias("group_id"), "sha", "size", "first_item", "last_item", "n_selected",
        F.when(F.col("n_selected") == 1, F.col("one")).alias("representative"),
    )


def several_selected(groups: DataFrame) -> DataFrame:
    """Groups that break the rule of one representative at most."""
    return groups.where(F.col("n_selected") > 1)


def with_group(items: DataFrame, groups: DataFrame, sha: str) -> DataFrame:
    return items.join(groups.select(F.col("sha").alias("_sha"), "group_id", "size", "representative"), F.lower(sha) == F.col("_sha"), "left").drop("_sha")


def passes_filters(duration: Column, size: Column, flags: Column, failed: Column, direction: Column, least: int, most: int, excluded: list[str], directions: list[str], show_unknown: bool, least_bytes: int | None = None, most_bytes: int | None = None) -> Column:
    """Not failed, a wanted direction, duration in range (unknown only if shown), size positive and in range, no excluded flag."""
    clean = ~F.arrays_overlap(F.transform(flags, lambda f: F.lower(f)), F.array(*[F.lit(e.lower()) for e in excluded])) if excluded else F.lit(True)
    known = duration.between(least, most)
    if least_bytes is not None:
        clean = clean & (size >= least_bytes)
    if most_bytes is not None:
        clean = clean & (size <= most_bytes)
    return ~failed & direction.isin(directions) & F.when(duration.isNull(), F.lit(show_unknown)).otherwise(known) & (size > 0) & F.coalesce(clean, F.lit(True))


def eligibility(passes: Column, duration: Column) -> Column:
    return F.when(~F.coalesce(passes, F.lit(False)), "Rejected").when(duration.isNull(), "Unknown").otherwise("Eligible")


def training_eligible(passes: Column, duration: Column, stored: Column) -> Column:
    """At build time an unknown duration is always out, and so is a stored rejection."""
    return F.coalesce(passes, F.lit(False)) & duration.isNotNull() & (F.coalesce(stored, F.lit("")) != "Rejected")


def merged_flags(a: Column, b: Column) -> Column:
    """Both lists' non-blank flags in their first spelling, each once and sorted, folding case."""
    every = F.filter(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lambda f: f.rlike(r"\S"))
    folded = F.transform(every, lambda f: F.upper(f))
    first = F.filter(every, lambda f, i: F.array_position(folded, F.upper(f)) == i + 1)
    return F.transform(F.array_sort(F.transform(first, lambda f: F.struct(F.upper(f).alias("key"), f.alias("flag")))), lambda x: x["flag"])
