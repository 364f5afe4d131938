"""Files as tables: journals, CSV, caches, recordings, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import walk
from ..functions import pcm
from ..operators import recovery as V
from ..operators import reconcile as X
from ..operators.manifest import PORTABLE
from ..schemas import DDL, voice_heads


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length and modificationTime of files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", "modificationTime")


def database_files(spark: SparkSession, root: str) -> DataFrame:
    """``.db`` files with their roles and shards by name; links are left out and not followed."""
    files = walk.regular_files(walk.walk(spark, root), r"(?i:.*\.db)")
    role, shard = V.role_of_file(F.element_at(F.split("path", "/"), -1))
    return files.select("path", F.col("bytes").alias("length"), role.alias("role"), shard.alias("shard")).orderBy(F.upper("path"))


def inventory_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that came, went or changed between two listings."""
    return X.reconcile(before, after, "path", ["length", "modificationTime"])


class JournalError(ValueError):
    pass


EVENT = "event string, run_id string, occurred_at_utc string, message_id string, transaction_key string, entry string, failure struct<message_id:string,stage:string,error:string,exception_type:string>, cancelled boolean"


def read_journal(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A run's journal, ``line_no`` growing with its lines: a malformed last line without a line end is left out as torn, any
    other malformed line or a foreign run is an error.

    The file is read line by line, in as many tasks as its size asks for. A text that ends without a line end is known by
    its length, which is then one less than its lines and their ends.
    """
    row = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    text = spark.read.text(path, lineSep="\n").select(row.alias("line_no"), F.rtrim("value", F.lit("\r")).alias("line"), (F.octet_length("value") + 1).cast("long").alias("size"))
    parsed = text.where(F.col("line").rlike(r"\S")).select("line_no", F.from_json("line", EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    bad = [r[0] for r in parsed.where(F.col("e.event").isNull()).select("line_no").limit(2).collect()]
    if bad:
        last, size = text.agg(F.max("line_no"), F.sum("size")).first()
        length = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
        if len(bad) > 1 or bad[0] != last or size == length:
            raise JournalError("a line that is no torn end is malformed")
    events = parsed.where(F.col("e.event").isNotNull()).select("line_no", "e.*")
    if not events.where(~F.col("run_id").eqNullSafe(F.lit(run_id))).isEmpty():
        raise JournalError("an event belongs to another run")
    return events


_FIELDS = ", ".join(f"{c} string" for c in PORTABLE)


def csv_rows(lines: DataFrame, line_no: str, line: str) -> DataFrame:
    """line_no, the eight fields and ``valid`` (whether the line has eight) of CSV lines without line ends in their fields."""
    told = F.from_csv(line, f"{_FIELDS}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"'})
    return _csv_fields(lines.where(F.col(line) != "").select(F.col(line_no).alias("line_no"), told.alias("r")))


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """``csv_rows`` of a file, whose fields may have line ends; the header is a row like the others."""
    reader = spark.read.schema(f"{_FIELDS}, _corrupt string").options(quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return _csv_fields(reader.csv(path).select(F.monotonically_increasing_id().alias("line_no"), F.struct("*").alias("r")))


def _csv_fields(rows: DataFrame) -> DataFrame:
    return rows.select("line_no", *[F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in PORTABLE], F.col("r._corrupt").isNull().alias("valid"))


def read_portable_csv(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"duration_ms": "long", "byte_length": "long"}
    ddl = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in PORTABLE)
    return spark.read.schema(ddl).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_document(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON file that holds one document; nothing is inferred."""
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def read_recordings(spark: SparkSession, root: str) -> DataFrame:
    """WAV files with their metrics, for which their samples are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root)
    return files.select("path", "length", pcm.wav_metrics(F.col("content"), F.lit(None).cast("long")).alias("metrics")).select("path", "length", "metrics.*")


def read_durations(spark: SparkSession, root: str) -> DataFrame:
    """path, length and facts (format, frames, duration) of WAV files by their chunks' heads; bodies are not read."""
    return pcm.file_facts(list_files(spark, root, "*.wav").select("path", "length")).select("path", "length", "facts.*")


def run_ids(listing: DataFrame) -> DataFrame:
    """Run ids in a listing's file names: the part before one of the known suffixes."""
    name = F.element_at(F.split("path", "/"), -1)
    found = F.regexp_extract(name, r"^([^.]+)\.(?:manifest\.json|portable\.json|commit\.json|jsonl)$", 1)
    return listing.select(found.alias("run_id")).where("run_id <> ''").distinct()


def land(tables: dict[str, DataFrame], folder: str) -> None:
    """Write landed tables as Parquet; messages by conversation bucket, so that a conversation reads few files."""
    for name, df in tables.items():
        if name not in DDL:
            raise KeyError(name)
        if name == "voice_info":  # scans read the heads only
            voice_heads(df).write.mode("overwrite").parquet(f"{folder}/voice_heads.parquet")
        if name == "messages":
            df = df.repartition(F.pmod(F.xxhash64("conversation_username"), F.lit(64))).sortWithinPartitions("conversation_username", "create_time")
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
