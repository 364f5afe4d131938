"""Messages, their senders and their media rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = b"#!SILK_V3"
STATES = ("Linked", "Missing", "Empty", "InvalidHeader", "Ambiguous")


def sender_lookup(messages: DataFrame, names: DataFrame, on: Column) -> DataFrame:
    """Left outer join to the dictionary of names; a later null-rejecting filter makes it an inner one by itself."""
    return messages.join(names, on, "left")


def has_voice_header(payload: Column, magic: bytes = MAGIC, lead: bytes = b"\x02") -> Column:
    """The payload starts with the magic, or with the lead byte and then the magic."""
    return F.startswith(payload, F.lit(magic)) | ((F.substring(payload, 1, 1) == F.lit(lead)) & F.startswith(F.substring(payload, 2, len(magic)), F.lit(magic)))


def payload_state(rows: Column, length: Column, valid_header: Column) -> Column:
    """Missing, Ambiguous, Empty, InvalidHeader or Linked, in this order of tests."""
    return (
        F.when(F.coalesce(rows, F.lit(0)) == 0, "Missing").when(rows > 1, "Ambiguous")
        .when(F.coalesce(length, F.lit(0)) == 0, "Empty").when(~F.coalesce(valid_header, F.lit(False)), "InvalidHeader").otherwise("Linked")
    )


def associate(messages: DataFrame, media: DataFrame, keys: list[str], length: str, valid_header: str, row: str | None = None) -> DataFrame:
    """Messages with ``payload_state``, ``payload_length`` and ``media_row`` by the whole composite key.

    The media rows are counted per key before the join, so a message never multiplies; of several rows none is taken,
    and an ambiguous message has length 0.
    """
    one = F.first(F.struct(F.col(length).alias("length"), F.col(valid_header).alias("valid"), (F.col(row) if row else F.lit(None)).alias("row")))
    counted = media.groupBy(*keys).agg(F.count("*").alias("_rows"), one.alias("_one"))
    joined = messages.join(counted, keys, "left")
    state = payload_state(F.col("_rows"), F.col("_one.length"), F.col("_one.valid"))
    return joined.withColumns({
        "payload_state": state,
        "payload_length": F.when(F.col("_rows") == 1, F.col("_one.length")).when(F.col("_rows") > 1, F.lit(0)),
        "media_row": F.when(F.col("_rows") == 1, F.col("_one.row")),
    }).drop("_rows", "_one")


def size_filter(records: DataFrame, least: int | None, most: int | None) -> DataFrame:
    """With any bound, missing media and null lengths go; an ambiguous record counts as length 0."""
    if least is None and most is None:
        return records
    length = F.col("payload_length")
    inside = length.isNotNull() & (F.col("payload_state") != "Missing")
    if least is not None:
        inside = inside & (length >= least)
    if most is not None:
        inside = inside & (length <= most)
    return records.where(inside)


def direction_of(origin: Column, incoming, outgoing) -> Column:
    """``incoming`` or ``outgoing``; any other origin in a selected row is an error."""
    return F.when(origin == incoming, "incoming").when(origin == outgoing, "outgoing").otherwise(F.raise_error(F.concat(F.lit("unknown origin "), origin.cast("string"))))


def direction_filter(rows: DataFrame, direction: str | None, origin: str, sender: str, account, incoming=2, outgoing=5) -> DataFrame:
    """Incoming: known sender other than the account; outgoing: the account; no direction: everything."""
    if direction is None:
        return rows
    if direction == "incoming":
        return rows.where((F.col(origin) == incoming) & F.col(sender).isNotNull() & (F.col(sender) != F.lit(account)))
    return rows.where((F.col(origin) == outgoing) & (F.col(sender) == F.lit(account)))


def time_filter(rows: DataFrame, seconds: Column, first: int | None, last: int | None) -> DataFrame:
    """Inclusive at both ends, in whole seconds."""
    if first is not None:
        rows = rows.where(seconds >= first)
    return rows.where(seconds <= last) if last is not None else rows
