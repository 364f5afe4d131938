"""Cutting recordings into segments of a target length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segment_plan(frames: Column, least: int, most: int, target: int) -> Column:
    """Segments of a recording of so many frames: an array of segment, start, length and kept, with the rules of ``plan_segments``."""
    frames = F.coalesce(frames, F.lit(0)).cast("long")
    whole, rest = F.floor(frames / target), frames % target
    n = F.when(frames < least, 1).when((rest < least) & (whole >= 1), whole).otherwise(whole + 1).cast("int")

    def one(i: Column) -> Column:
        start = i.cast("long") * target
        length = F.when(i == n - 1, frames - start).otherwise(F.lit(target).cast("long"))
        return F.struct(i.alias("segment"), start.alias("start"), length.alias("length"), ((length >= least) & (length <= most)).alias("kept"))

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def plan_segments(items: DataFrame, frames: Column, least: int, most: int, target: int, weight: Column | None = None, shortest: int | None = None, supported: Column | None = None, readable: Column | None = None, rate: Column | None = None) -> DataFrame:
    """One row per segment (and per anchor copy): segment, start, length, outcome, copy (and duration_ms, given a ``rate``).

    Segments have ``target`` frames; a remainder shorter than ``least`` is absorbed by the last one, which is rejected
    if it thereby exceeds ``most``, as is a whole recording shorter than ``least``. One row rejects a recording that is not
    ``supported``, not ``readable``, or shorter than ``shortest`` frames (``least``, if not given). Durations are rounded
    half away from zero for kept segments and down for rejected ones.
    """
    shortest = least if shortest is None else shortest
    refused = F.lit(None).cast("string")
    for test, code in ((frames >= shortest, "shorter-than-one-second"), (readable, "invalid-wav"), (supported, "unsupported-format")):
        refused = refused if test is None else F.when(~F.coalesce(test, F.lit(False)), code).otherwise(refused)
    items = items.withColumn("_refused", refused)
    frames = F.coalesce(frames, F.lit(0))
    items = items.withColumn("_f", frames.cast("long"))
    first = F.array(F.struct(F.lit(0).alias("segment"), F.lit(0).cast("long").alias("start"), F.col("_f").alias("length"), F.lit(False).alias("kept")))
    plan = F.when(F.col("_refused").isNotNull(), first).otherwise(segment_plan(F.col("_f"), least, most, target))
    out = items.withColumn("_s", F.explode(plan)).select("*", "_s.segment", "_s.start", "_s.length")
    outcome = F.coalesce(F.col("_refused"), F.when(F.col("_s.kept"), "kept").otherwise("segment-out-of-range"))
    out = out.withColumn("outcome", outcome)
    if rate is not None:
        exact = F.col("length") * 1000 / rate
        out = out.withColumn("duration_ms", F.when(F.col("outcome") == "kept", F.round(exact)).otherwise(F.floor(exact)).cast("long"))
    copies = F.when(F.col("outcome") == "kept", weight).otherwise(1) if weight is not None else F.lit(1)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_f", "_s", "_refused")


def segment_totals(segments: DataFrame, size: Column) -> DataFrame:
    kept = F.col("outcome") == "kept"
    return segments.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"), F.coalesce(F.sum(F.when(kept, F.col("length"))), F.lit(0)).alias("kept_length"), F.coalesce(F.sum(F.when(kept, size)), F.lit(0)).alias("kept_bytes"))
