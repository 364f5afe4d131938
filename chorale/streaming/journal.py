"""Following run journals as a stream. This is an extension: the behaviour it mirrors is batch replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifest as M
from ..sources.files import EVENT


def follow(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    """Events of all journals in a folder as they arrive, those of a transaction key once within the watermark.

    Failures have no transaction key: each is an event of its own, as in the batch replay.
    """
    lines = spark.readStream.schema("value string").text(folder)
    events = lines.select(F.from_json("value", EVENT).alias("e")).where("e.event IS NOT NULL").select("e.*")
    timed = events.withColumn("at", F.to_timestamp("occurred_at_utc")).withWatermark("at", late)
    once = timed.where("transaction_key IS NOT NULL").dropDuplicatesWithinWatermark(["run_id", "event", "transaction_key"])
    return once.unionByName(timed.where("transaction_key IS NULL"))


def failures_by_window(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Committed and failed items per run and time window."""
    return events.groupBy(F.window("at", width), "run_id").agg(
        F.count_if(F.col("event") == "item-committed").alias("committed"), F.count_if(F.col("event") == "item-failed").alias("failed")
    )


def run_states(events: DataFrame) -> DataFrame:
    """Per run the state that a replay of its journal up to now has: the batch's mergeable state, kept by the stream and ordered by
    the events' times. For the update and complete modes; ``manifest.judge_states`` gives the statuses of what is written."""
    return M.journal_states(events, "run_id", "at", "event", F.col("entry"), F.col("failure"))
