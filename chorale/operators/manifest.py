"""Export manifests: totals, order, portable rows, spreadsheet-safe CSV, artifact index, replay of the journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of the portable CSV, in order (fixed values).
PORTABLE = ("item_id", "relative_audio_path", "sha256", "duration_ms", "byte_length", "quality_flags", "training_eligibility", "selected")


def totals(entries: DataFrame, duration: Column, size: Column, training: Column) -> DataFrame:
    return entries.agg(
        F.count("*").alias("items"),
        F.coalesce(F.sum(F.when(duration > 0, duration)), F.lit(0)).alias("total_duration"),
        F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)).alias("total_bytes"),
        F.count_if(training).alias("training_items"),
        F.coalesce(F.sum(F.when(training & (duration > 0), duration)), F.lit(0)).alias("training_duration"),
    )


def spreadsheet_guard(c: Column) -> Column:
    """A leading ``= + - @`` gets an apostrophe before it."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_field(c: Column) -> Column:
    """Guarded and, only if it holds a comma, a quote or a line end, quoted."""
    guarded = spreadsheet_guard(F.coalesce(c, F.lit("")))
    return F.when(guarded.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def portable_rows(entries: DataFrame, item_id: Column, path: Column, sha: Column, duration: Column, size: Column, flags: Column, eligibility: Column, selected: Column) -> DataFrame:
    """Eight columns and no account, conversation, database or private path."""
    values = (item_id, path, sha, duration, size, F.array_join(flags, "|"), eligibility, F.initcap(selected.cast("string")))
    return entries.select(*[v.alias(n) for n, v in zip(PORTABLE, values)])


def write_portable_csv(rows: DataFrame, path: str) -> None:
    text = rows.select(*[spreadsheet_guard(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in PORTABLE])
    text.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def artifact_index(entries: DataFrame, original: tuple[str, str, str], decoded: tuple[str, str, str]) -> DataFrame:
    """One row per original and per decoded file: (path, sha256, bytes) of each, in one pass over the entries."""
    kinds = [F.struct(F.lit(kind).alias("kind"), F.col(p).alias("path"), F.col(h).alias("sha256"), F.col(n).cast("long").alias("bytes")) for kind, (p, h, n) in (("original", original), ("decoded", decoded))]
    return entries.select(F.explode(F.array(*kinds)).alias("a")).select("a.*").where(F.col("path").isNotNull())


def journal_states(events: DataFrame, run: str, line: str, event: str, entry: Column | None = None, failure: Column | None = None, context: Column | None = None, committed_at: Column | None = None) -> DataFrame:
    """Per run, what a part of its journal says: numbers of entries and failures, the first failure's line, and the last status
    event, context and commit, each with its line. Sums, least and last ones only, so tasks add up their own lines first,
    parts of a journal combine with ``merge_states``, and a stream keeps the same as its state.

    An item counts only with its body (``entry``, ``failure``; without these columns every item does).
    """
    there = lambda c: c.isNotNull() if c is not None else F.lit(True)
    e, at = F.col(event), F.col(line)
    last = lambda c, test: F.max(F.when(test, F.struct(at.alias("line"), c.alias("value"))))
    out = [
        F.count_if(e.isin("item-committed", "item-skipped") & there(entry)).alias("entries"), F.count_if((e == "item-failed") & there(failure)).alias("failures"),
        F.min(F.when((e == "item-failed") & there(failure), at)).alias("first_failure"), last(e, e.isin("run-cancelled", "run-failed", "processing-completed")).alias("last_status"),
    ]
    if context is not None:
        out.append(last(context, context.isNotNull()).alias("last_context"))
    if committed_at is not None:
        out.append(last(committed_at, e == "manifest-committed").alias("last_commit"))
    return events.groupBy(run).agg(*out)


def merge_states(states: DataFrame, run: str) -> DataFrame:
    """The states of whole journals from those of their parts."""
    sums = [F.sum(c).alias(c) for c in ("entries", "failures")]
    return states.groupBy(run).agg(*sums, F.min("first_failure").alias("first_failure"), *[F.max(c).alias(c) for c in ("last_status", "last_context", "last_commit") if c in states.columns])


def judge_states(states: DataFrame, run: str, fallback: str | None = None) -> DataFrame:
    """Per run: entries, failures, the status after its last status event (else ``fallback``), the last context and the time of
    the last commit. ``processing-completed`` is with failures if any item had failed up to that line."""
    told, line = F.col("last_status.value"), F.col("last_status.line")
    status = (
        F.when(told == "run-cancelled", "Cancelled").when(told == "run-failed", "Failed")
        .when((told == "processing-completed") & (F.col("first_failure") < line), "CompletedWithFailures").when(told == "processing-completed", "Completed").otherwise(F.lit(fallback))
    )
    names = {"last_context": "context", "last_commit": "committed_at"}
    return states.select(run, "entries", "failures", status.alias("status"), *[F.col(f"{c}.value").alias(n) for c, n in names.items() if c in states.columns])


def journal_status(events: DataFrame, run: str, line: str, event: str, entry: Column | None = None, failure: Column | None = None, context: Column | None = None, committed_at: Column | None = None, fallback: str | None = None) -> DataFrame:
    """``judge_states`` of whole journals."""
    return judge_states(journal_states(events, run, line, event, entry, failure, context, committed_at), run, fallback)


def running(rows: DataFrame, part: list[str], order: list[str], measures: dict[str, Column]) -> DataFrame:
    """Running counts of the measures after each row."""
    so_far = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({name: F.count_if(test).over(so_far) for name, test in measures.items()})
