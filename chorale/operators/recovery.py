"""States of artifacts, transactions and sources, as ordered tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as I

#: Legal moves of a materialization (fixed values).
MATERIALIZATION = {"Staging": "DatabasesCommitted", "DatabasesCommitted": "WorkspaceCommitted", "WorkspaceCommitted": "Completed"}
#: Legal moves of an export transaction (fixed values).
TRANSACTION = {"Staging": "Prepared", "Prepared": "Publishing", "Publishing": "ArtifactsCommitted", "ArtifactsCommitted": "MetadataCommitted", "MetadataCommitted": "Completed"}


def original_state(present: Column, known_hash: Column, found_hash: Column, known_length: Column, found_length: Column) -> Column:
    """Missing, VerifiedExisting, PendingExisting or Conflict of an original file."""
    length_fits = known_length.isNull() | (known_length == found_length)
    return (
        F.when(~F.coalesce(present, F.lit(False)), "Missing")
        .when(known_hash.isNotNull() & (F.lower(known_hash) == F.lower(found_hash)) & length_fits, "VerifiedExisting")
        .when(known_hash.isNull() & length_fits, "PendingExisting").otherwise("Conflict")
    )


def decoded_state(present: Column, known_hash: Column, found_hash: Column, known_length: Column, found_length: Column, valid: Column) -> Column:
    fits = (known_hash.isNull() | (F.lower(known_hash) == F.lower(found_hash))) & (known_length.isNull() | (known_length == found_length))
    return F.when(~F.coalesce(present, F.lit(False)), "Missing").when(fits & (known_hash.isNotNull() | valid), "VerifiedExisting").otherwise("Conflict")


def pending_resolution(existing: Column, fresh: Column) -> Column:
    """What a pending original is once the source was read: verified if the hashes are equal, else another content."""
    return F.when(F.lower(existing) == F.lower(fresh), "VerifiedExisting").otherwise("source-content-mismatch")


def breaks_expectation(expected_hash: Column, expected_length: Column, found_hash: Column, found_length: Column) -> Column:
    """The written file differs from what its record expects, where it expects anything."""
    wrong_hash = expected_hash.isNotNull() & ~F.lower(expected_hash).eqNullSafe(F.lower(found_hash))
    return wrong_hash | (expected_length.isNotNull() & ~expected_length.eqNullSafe(found_length))


def artifact_decision(policy: Column, original: Column, decoded: Column) -> Column:
    """What to do with an item's files under a policy (Fail, VerifyOnly, Replace, SkipIfHashMatches), given their states:
    an error code, and which of the two files are to be written."""
    there = (original != "Missing") | (decoded != "Missing")
    error = F.when((policy == "Fail") & there, "existing-artifact-conflict").when((policy == "VerifyOnly") & (original == "PendingExisting"), "existing-artifact-needs-hash")
    replace = policy == "Replace"
    write = error.isNull()
    return F.struct(error.alias("error"), (write & (replace | original.isin("Missing", "PendingExisting"))).alias("write_original"), (write & (replace | (decoded == "Missing"))).alias("write_decoded"))


def ready_item(item: dict[str, Column], entry: dict[str, Column]) -> Column:
    """An item whose entry, keys, paths, hash and length are all bound and equal, in a state from which it can be published.

    ``item``: stable_key, transaction_key, original_path, original_sha256, original_bytes, decoded_path, decoded_sha256,
    decoded_bytes, state; ``entry``: stable_key, original_path, original_sha256, original_bytes, decoded_path.
    """
    path = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    equal_paths = lambda a, b: I.not_blank(a) & I.not_blank(b) & (path(a) == path(b))
    decoded = ~I.not_blank(item["decoded_path"]) | (I.not_blank(item["decoded_sha256"]) & item["decoded_bytes"].isNotNull() & equal_paths(entry["decoded_path"], item["decoded_path"]))
    tests = (
        I.not_blank(item["stable_key"]), entry["stable_key"] == item["stable_key"], item["transaction_key"] == I.transaction_key(item["stable_key"]),
        equal_paths(entry["original_path"], item["original_path"]), I.not_blank(item["original_sha256"]), F.lower(entry["original_sha256"]) == F.lower(item["original_sha256"]),
        entry["original_bytes"] == item["original_bytes"], decoded, item["state"].isin("ReadyToPublish", "Publishing", "Published"),
    )
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def reconcile_artifact(state: Column, previous: Column, staged: Column, final: Column, expected: tuple[Column, Column], found: tuple[Column, Column], waiting: tuple[Column, Column], found_link: Column | None = None, waiting_link: Column | None = None) -> Column:
    """Struct of state, resolved and move for one file of an interrupted run.

    ``staged`` and ``final`` are its paths; the pairs are (length, hash) of what is expected, of the final and of the staged
    file, null where there is no file. A staged file moves only where no final one is; then it is what was expected. A link is
    never what was expected, and a final one keeps the staged file from moving.
    """
    plain = lambda link: ~F.coalesce(link, F.lit(False)) if link is not None else F.lit(True)
    there = lambda pair: pair[0].isNotNull()
    fits = lambda pair: F.coalesce(I.not_blank(expected[1]) & (pair[0] == expected[0]) & (F.lower(pair[1]) == F.lower(expected[1])), F.lit(False))
    existing = (state == "Existing") | ((previous == "VerifiedExisting") & ~I.not_blank(staged))
    move = I.not_blank(staged) & there(waiting) & fits(waiting) & plain(waiting_link) & ~there(found) & plain(found_link)
    fits_found = fits(found) & plain(found_link)
    told = (
        F.when(existing, F.when(I.not_blank(final) & fits_found, "Existing").otherwise("Failed"))
        .when(~I.not_blank(final), "NotStarted").when(fits_found, "Committed").when(move, "Committed").otherwise("Failed")
    )
    return F.struct(told.alias("state"), (told != "Failed").alias("resolved"), (~existing & I.not_blank(final) & ~fits_found & move).alias("move"))


def recovery_decision(state: Column, items: Column, resolved: Column, published: Column, journal_commit: Column) -> Column:
    """What to do at start with each transaction, given the counts of its items."""
    return (
        F.when(state == "Completed", "leave").when(state == "RolledBack", "clean-staging")
        .when(state.isin("Staging", "Prepared") & (published == 0), "roll-back")
        .when((state == "FailedRecoverable") & (items == 0) & ~journal_commit, "roll-back")
        .when(items == resolved, "resume-metadata").otherwise("error")
    )


def legal_move(before: Column, after: Column, moves: dict[str, str], failed: str = "FailedRecoverable", end: str = "Completed") -> Column:
    """A move to the next state, or from any unfinished one to failure."""
    test = (after == failed) & (before != end)
    for a, b in moves.items():
        test = test | ((before == a) & (after == b))
    return test


def account_evidence(rows: DataFrame, account: list, is_self: Column) -> DataFrame:
    """Confirmed by exactly one self row, else a candidate."""
    counted = rows.groupBy(*account).agg(F.count_if(is_self).alias("self_rows"))
    return counted.withColumn("evidence", F.when(F.col("self_rows") == 1, "Confirmed").otherwise("Candidate"))


def role_of_file(name: Column) -> tuple[Column, Column]:
    """Role and shard number by a file's name without its extension.

    ``message_N`` and ``media_N`` are such only if all that follows the prefix is a number; any other file is a contact's by
    a word in its name, else unknown, and has the number behind its last underscore.
    """
    low = F.lower(name)
    stem = F.regexp_replace(low, r"\.[^.]*$", "")
    after = lambda prefix: F.regexp_extract(stem, rf"{prefix}_\s*(\+?\d+|-0+)\s*$", 1).try_cast("int")
    message, media = after("^message"), after("^media")
    role = F.when(message.isNotNull(), "message").when(media.isNotNull(), "media").when(F.contains(low, F.lit("contact")) | F.contains(low, F.lit("friend")), "contact").otherwise("unknown")
    return role, F.coalesce(message, media, after(""))


def account_folder(name: Column) -> Column:
    """Account id in a folder's name: ``wxid_`` and, cut off, a suffix of 4 or 16 hex digits; null otherwise."""
    found = F.regexp_extract(name, r"^(wxid_.+)_(?:[0-9a-fA-F]{4}|[0-9a-fA-F]{16})$", 1)
    return F.when(found != "", found)


def redact_accounts(text: Column) -> Column:
    """Account ids, in any case, and words of 32 or more hex digits are masked; a null text is empty."""
    accounts = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)wxid_[a-z0-9_]+", "wxid_***")
    return F.regexp_replace(accounts, r"\b[0-9a-fA-F]{32,}\b", "***")


#: Severities of the issues of a data set (fixed values).
SEVERITY = {
    "incomplete-wal-pair": "warning", "encrypted-or-non-sqlite": "error", "schema-probe-failed": "error", "missing-message-database": "error",
    "missing-media-database": "error", "missing-contact-database": "warning", "unverified-shard-topology": "info", "no-databases": "error",
}


def file_issues(files: DataFrame, wal: Column, shm: Column, plain: Column, readable: Column) -> DataFrame:
    """The files with ``code`` and ``severity`` of each issue of a single database file.

    ``wal`` and ``shm``: its sidecars are there; ``plain``: it starts as SQLite files do; ``readable``: its schema could be read.
    """
    found = F.array_compact(F.array(F.when(wal != shm, "incomplete-wal-pair"), F.when(~plain, "encrypted-or-non-sqlite").when(~readable, "schema-probe-failed")))
    return _with_severity(files.withColumn("code", F.explode(found)))


def _with_severity(issues: DataFrame) -> DataFrame:
    every = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return issues.withColumn("severity", every[F.col("code")])


def topology_issues(artifacts: DataFrame, group: list[str], role: str, shard: str) -> DataFrame:
    """Issue rows per data set by the roles of its files; a row without a role stands for a data set without files.

    Shard sets of messages and media are compared where both have numbers.
    """
    shards = lambda r: F.array_sort(F.collect_set(F.when(F.col(role) == r, F.col(shard))))
    has = lambda r: F.count_if(F.col(role) == r)
    seen = artifacts.groupBy(*group).agg(has("message").alias("m"), has("media").alias("d"), has("contact").alias("c"), F.count(role).alias("n"), shards("message").alias("ms"), shards("media").alias("ds"))
    found = F.array_compact(F.array(
        F.when(F.col("m") == 0, "missing-message-database"), F.when(F.col("d") == 0, "missing-media-database"), F.when(F.col("c") == 0, "missing-contact-database"),
        F.when((F.size("ms") > 0) & (F.size("ds") > 0) & (F.col("ms") != F.col("ds")), "unverified-shard-topology"), F.when(F.col("n") == 0, "no-databases"),
    ))
    return _with_severity(seen.select(*group, F.explode(found).alias("code")))


def ranked_adapters(candidates: DataFrame, group: list[str], adapter: str, score: str, matches: Column) -> DataFrame:
    """Matching adapters of each data set by score, then id; ``choice`` is the first one, or an error code where there is
    none or the two highest scores are equal."""
    order = Window.partitionBy(*group).orderBy(F.desc("_score"), adapter)
    placed = candidates.withColumn("_score", F.when(matches, F.col(score))).withColumn("place", F.row_number().over(order))
    top = F.max(F.when(F.col("place") == 1, F.col("_score"))).over(Window.partitionBy(*group))
    second = F.max(F.when(F.col("place") == 2, F.col("_score"))).over(Window.partitionBy(*group))
    first = F.max(F.when(F.col("place") == 1, F.col(adapter))).over(Window.partitionBy(*group))
    choice = F.when(top.isNull(), "no-matching-adapter").when(top == second, "ambiguous-adapter").otherwise(first)
    return placed.withColumn("choice", choice).where(F.col("_score").isNotNull() | (F.col("place") == 1)).drop("_score")


def recoverable_workspace(state: Column, verified: Column) -> Column:
    """A materialization can be taken up again in two states only, and with a verified manifest."""
    return F.coalesce(state.isin("DatabasesCommitted", "FailedRecoverable") & verified, F.lit(False))


def accepts(artifacts: DataFrame, group: list[str], role: str, matches: Column) -> DataFrame:
    """Data sets with one contact and one media artifact, a message one at least, all of the expected shape."""
    of = lambda r: F.count_if(F.col(role) == r)
    return artifacts.groupBy(*group).agg(((of("contact") == 1) & (of("media") == 1) & (of("message") >= 1) & F.bool_and(matches)).alias("accepted"))


#: What a project's stage is, by what is there (fixed values).
PROJECT_STATES = ("Busy", "ValidReusable", "Stale", "Invalid", "Recoverable", "Missing")


def project_state(document: Column, verifies: Column, account: Column, expected: Column, root: Column, commit_state: Column, recoverable: Column) -> Column:
    """Struct of state, repairable and reusable of a project: whether its workspace document is there and verifies, for which
    account, whether the materialized root is there, in which commit state, and whether that can be recovered.

    A root being staged is busy, whatever the document says. A document that verifies is reusable, but stale if another account
    is expected. One that doesn't verify, or is missing, is invalid and can be repaired over a completed root; without a document,
    a root that can be recovered is. A null counts as false, an expected account of null as any.
    """
    true = lambda c: F.coalesce(c, F.lit(False))
    there, completed = true(root), true(commit_state == "Completed")
    state = (
        F.when(there & true(commit_state == "Staging"), "Busy")
        .when(true(document) & true(verifies), F.when(expected.isNotNull() & ~expected.eqNullSafe(account), "Stale").otherwise("ValidReusable"))
        .when(true(document), "Invalid").when(there & completed, "Invalid").when(there & true(recoverable), "Recoverable").when(there, "Invalid").otherwise("Missing")
    )
    return F.struct(state.alias("state"), ((state == "Invalid") & there & completed).alias("repairable"), (state == "ValidReusable").alias("reusable"))
