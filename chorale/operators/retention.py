"""What to keep: newest rows, recent runs, storage totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, part: list, order: list, name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def newest(rows: DataFrame, part: list, order: list) -> DataFrame:
    return ranked(rows, part, order).where(F.col("rn") == 1).drop("rn")


def all_but_newest(rows: DataFrame, part: list, order: list) -> DataFrame:
    return ranked(rows, part, order).where(F.col("rn") > 1).drop("rn")


def latest_cache_rows(lines: DataFrame, key: list[str], line: str, time: str, usable: Column, keep: int = 100_000) -> DataFrame:
    """Usable lines, the last one per key, of these the newest ``keep``."""
    last = newest(lines.where(usable), [F.col(k) for k in key], [F.desc(line)])
    return last.orderBy(F.desc(time), *key).limit(keep)


def cache_lookup(rows: DataFrame, cache: DataFrame, key: list[str], value: str, known: Column | None = None) -> DataFrame:
    """Rows with ``value`` (their own ``known`` one, else the cached one) and ``hit``: the cache holds a positive value."""
    stored = cache.where(F.col(value) > 0).select(*key, F.col(value).alias("_cached"))
    joined = rows.join(stored, key, "left")
    own = F.coalesce(known, F.col("_cached")) if known is not None else F.col("_cached")
    return joined.withColumns({value: own, "hit": F.col("_cached").isNotNull()}).drop("_cached")


#: Names of what a stopped run leaves behind (fixed patterns): staging folders and temporary payloads.
ORPHANS = r"(?:^|/)(?:\..+\.staging|[^/]+\.input\.silk|[^/]+\.output\.wav|[^/]+\.tmp(?:-[0-9a-f]+)?)$"


def orphans(listing: DataFrame, path: str, modified: Column, cutoff, link: Column | None = None, names: str = ORPHANS) -> DataFrame:
    """What is older than the cutoff and has a known name; links are never taken."""
    stale = F.col(path).rlike(names) & (modified < cutoff)
    return listing.where(stale & ~F.coalesce(link, F.lit(False)) if link is not None else stale)


def deletion_coverage(listed: DataFrame, files: DataFrame, group: list[str], key: str, size: str) -> DataFrame:
    """Per group of listed databases: how many the files cover, with what bytes, and whether they cover every one."""
    there = files.groupBy(F.lower(F.col(key).cast("string")).alias("_key")).agg(F.sum(size).alias("_bytes"))
    both = listed.withColumn("_key", F.lower(F.col(key).cast("string"))).join(there, "_key", "left")
    covered = F.count("_bytes")
    return both.groupBy(*group).agg(F.count("*").alias("listed"), covered.alias("covered"), F.sum("_bytes").alias("covered_bytes"), (F.count("*") == covered).alias("complete"))


def keep_recent(runs: DataFrame, part: list[str], created: str, complete: str, referenced: str, n: int = 5) -> DataFrame:
    """Referenced, then KeepRecent (incomplete, or fewer than ``n`` strictly newer complete runs), else Compactable."""
    newer = F.rank().over(Window.partitionBy(*part, complete).orderBy(F.desc(created))) - 1
    state = F.when(F.col(referenced), "Referenced").when(~F.col(complete), "KeepRecent").when(newer < n, "KeepRecent").otherwise("Compactable")
    return runs.withColumn("disposition", state)


def storage_totals(assets: DataFrame, kind: Column, size: Column, reclaimable: Column) -> DataFrame:
    """Bytes by kind in one row; a recoverable workspace counts as workspace and as recoverable."""
    of = lambda test: F.coalesce(F.sum(F.when(test, size)), F.lit(0))
    return assets.agg(
        of(kind == "snapshot").alias("snapshot_bytes"), of(kind.isin("workspace", "recoverable")).alias("workspace_bytes"), of(kind == "export").alias("export_bytes"),
        of(kind == "dataset").alias("dataset_bytes"), of(kind == "transient").alias("temporary_bytes"), of(kind == "recoverable").alias("recoverable_bytes"), of(reclaimable).alias("reclaimable_bytes"),
    )


def reclaimable(kind: Column, modified: Column, cutoff, force: bool = False) -> Column:
    """Transient always; recoverable if forced or older than the cutoff."""
    return (kind == "transient") | ((kind == "recoverable") & (F.lit(force) | (modified < cutoff)))


def duplicate_snapshots(copies: DataFrame, content: str, size: str, newest_first: list) -> DataFrame:
    """Copies of the same content, newest first, with the group's size and bytes; groups of one are left out."""
    part = Window.partitionBy(content)
    placed = ranked(copies, [content], newest_first, "copy_rank").withColumns({"copies": F.count("*").over(part), "group_bytes": F.sum(size).over(part)})
    return placed.where(F.col("copies") > 1)


#: Paths that a registry keeps (fixed value).
REGISTERED = 100


def registry(paths: DataFrame, part: list[str], path: str, registered_at: str, most: int = REGISTERED) -> DataFrame:
    """Of each part the paths that stay registered: each path once, folding case, as it was last registered, the ``most`` latest."""
    latest = paths.groupBy(*part, F.lower(path).alias("_path")).agg(F.max(F.struct(registered_at, path)).alias("_last")).select(*part, f"_last.{path}", f"_last.{registered_at}")
    place = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc(registered_at), path))
    return latest.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def run_list(runs: DataFrame, created: str, run: str) -> DataFrame:
    """Runs from the oldest on."""
    return runs.orderBy(F.col(created).asc_nulls_first(), run)
