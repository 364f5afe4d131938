"""Caches that survive a session: scans by workspace and query, durations and hashes by payload."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import retention as K

#: Version of the manifest beside a cached scan.
FORMAT = "scan-cache/1"
#: A cache is rewritten from so many bytes, or from so many lines if most are stale, or beyond so many keys; entries live so
#: many days (fixed values).
COMPACT_BYTES, COMPACT_LINES, MOST_ENTRIES, LIFE_DAYS = 8 << 20, 256, 100_000, 180
_MANIFEST = "format string, workspace string, query string, records long, digest string, written_at timestamp"


def digest(rows: DataFrame) -> DataFrame:
    """One row: number of rows and a digest that does not depend on their order, summed where they lie."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")
    again = F.xxhash64(F.lit("again"), *[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")
    total = F.concat_ws("|", F.coalesce(F.sum(hashed), F.lit(0)).cast("string"), F.coalesce(F.sum(again), F.lit(0)).cast("string"), F.count("*").cast("string"))
    return rows.agg(F.count("*").alias("records"), F.sha2(total, 256).alias("digest"))


def _folder(root: str, workspace: str, query: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]*[A-Za-z0-9_-][A-Za-z0-9._-]*", workspace) or not re.fullmatch(r"[0-9a-f]{64}", query):
        raise ValueError("a workspace is a plain name and a query's fingerprint 64 hex digits")
    return f"{root}/workspace={workspace}/query={query}"


def write_scan(root: str, workspace: str, query: str, records: DataFrame, report: DataFrame) -> None:
    """Store a scan: records and report first, then the manifest, which alone makes it visible."""
    folder = _folder(root, workspace, query)
    spark = records.sparkSession
    manifest = spark.createDataFrame([(FORMAT, workspace, query, -1, "", datetime.now(timezone.utc))], _MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")  # from here on, whatever lies there is a miss
    records.write.mode("overwrite").parquet(f"{folder}/records")
    report.write.mode("overwrite").parquet(f"{folder}/report")
    stored = digest(spark.read.parquet(f"{folder}/records"))
    whole = manifest.drop("records", "digest").crossJoin(stored).select("format", "workspace", "query", "records", "digest", "written_at")
    whole.write.mode("overwrite").parquet(f"{folder}/manifest")


def read_scan(spark: SparkSession, root: str, workspace: str, query: str) -> tuple[DataFrame, DataFrame] | None:
    """(records, report) of a stored scan, or None: it is not there, another workspace's or query's, or not what was written.

    The records are verified by one pass over them; nothing of them goes to the driver but their number and digest.
    """
    folder = _folder(root, workspace, query)
    try:
        (m,) = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").collect()
        records, report = spark.read.parquet(f"{folder}/records"), spark.read.parquet(f"{folder}/report")
        found = digest(records).first()
    except (PySparkException, Py4JError, ValueError):  # a file that is missing or torn is a miss, whatever Spark says of it
        return None
    own = (m["format"], m["workspace"], m["query"], m["records"], m["digest"])
    return (records, report) if own == (FORMAT, workspace, query, found["records"], found["digest"]) else None


def usable_line(decoder: Column, wanted: str, value: Column, sha: Column, stored_at: Column, now: Column, source: Column) -> Column:
    """A cache line of this decoder with a positive value, a hash, a known source and not past its life."""
    alive = stored_at >= now - F.expr(f"INTERVAL {LIFE_DAYS} DAYS")
    return F.coalesce((decoder == wanted) & (value > 0) & I.is_sha256(sha) & I.not_blank(source) & alive, F.lit(False))


def should_compact(size: Column, lines: Column, unique: Column, migrate: Column) -> Column:
    return (size >= COMPACT_BYTES) | ((lines >= COMPACT_LINES) & (lines > 2 * unique + 32)) | (unique > MOST_ENTRIES) | migrate


def compaction_state(lines: DataFrame, part: list[str], key: list[str], usable: Column, size: Column) -> DataFrame:
    """Per cache: lines, unusable ones, keys, bytes, and whether it is to be rewritten."""
    told = lines.select(*part, F.struct(*key).alias("_key"), usable.alias("_ok"), size.alias("_size"))
    counted = told.groupBy(*part).agg(F.count("*").alias("lines"), F.count_if(~F.col("_ok")).alias("stale"), F.count_distinct(F.when(F.col("_ok"), F.col("_key"))).alias("keys"), F.sum("_size").alias("bytes"))
    return counted.withColumn("compact", should_compact(F.col("bytes"), F.col("lines"), F.col("keys"), F.col("stale") > 0))


def compact(lines: DataFrame, key: list[str], line: str, time: str, usable: Column) -> DataFrame:
    """What a rewritten cache holds: the last usable line of each key, the newest MOST_ENTRIES of them."""
    return K.latest_cache_rows(lines, key, line, time, usable, MOST_ENTRIES)


def to_append(stored: DataFrame, new: DataFrame, key: list[str], value: str, line: str, usable: Column) -> DataFrame:
    """The lines of ``new`` (one for each key) to append to a cache: those whose value is not that of the key's last usable line."""
    last = stored.where(usable).groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(value, line).alias("_value"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]) & F.col(value).eqNullSafe(F.col("_value"))
    return new.join(last, same, "left_anti")


def payload_key(stable: Column, length: Column, fingerprints: Column) -> Column:
    """Key of a payload's cached hash: the stable key, the length and the databases' fingerprints in their order."""
    return F.sha2(I.joined("|", stable, length, F.array_join(F.transform(fingerprints, lambda f: F.lower(f)), ",")), 256)


def read_spool(spark: SparkSession, path: str, ddl: str, records: int, sha256: str) -> DataFrame:
    """Spooled records (JSON lines), refused unless their number and digest are those that were noted when they were written."""
    rows = spark.read.schema(ddl).json(path)
    found = digest(rows).first()
    if (found["records"], found["digest"]) != (records, sha256):
        raise ValueError("the spool is not what was written")
    return rows
