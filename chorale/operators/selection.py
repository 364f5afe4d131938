"""Order, limits and eligibility of selected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """Bag union; the order comes from the query, by one range-partitioned sort."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out


def first_rows(rows: DataFrame, order: list, n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def until_eligible(rows: DataFrame, order: list[str], eligible: Column, n: int) -> DataFrame:
    """Every row that is seen, in ``order`` (which must be unique), until ``n`` eligible ones are found.

    The key of the n-th eligible row bounds the scan, so no window runs over the whole input: the bound is a top-n, and
    the rows up to it a filter. With fewer than ``n`` eligible rows, every row is seen.
    """
    key = F.struct(*order)
    found = rows.where(eligible).select(key.alias("k")).orderBy("k").limit(n)
    bound = found.agg(F.max("k").alias("bound"), F.count("*").alias("found")).where(F.col("found") == n).select("bound")
    seen = rows.withColumn("_key", key).join(F.broadcast(bound), F.col("_key") > F.col("bound"), "left_anti")  # one row at most
    return seen.drop("_key")


def in_bounds(value: Column, least=None, most=None) -> Column:
    """A missing value satisfies no bound, and everything where there is none."""
    test = F.lit(True)
    if least is not None:
        test = test & F.coalesce(value >= least, F.lit(False))
    return test & F.coalesce(value <= most, F.lit(False)) if most is not None else test


#: Reasons against an export, in the order of their tests (fixed values).
REASONS = ("payload-state", "payload-empty", "payload-locator", "source-identity", "provenance", "contact-identity", "direction", "speaker")


def reject_reason(tests: dict[str, Column]) -> Column:
    """The first reason whose test fails, or null for an eligible row; ``tests`` hold what must be true."""
    chain = None
    for reason in REASONS:
        if reason in tests:
            fails = ~F.coalesce(tests[reason], F.lit(False))
            chain = F.when(fails, reason) if chain is None else chain.when(fails, reason)
    return chain


#: Fields in which a record must agree with the catalog that it came from, in the order of the test; a record's stable account is
#: the context's account (fixed values).
PROVENANCE, CONTEXT = ("dataset_id", "adapter_id", "adapter_family", "account_stable_id", "snapshot_id", "adapter_version"), {"account_stable_id": "account_id"}


def export_tests(r: dict[str, Column], context: dict[str, Column], guided: bool = True, conversation: Column | None = None, contact: Column | None = None, username: Column | None = None, direction: str | None = None) -> dict[str, Column]:
    """The tests behind REASONS for a record's columns ``r``, against the catalog's context and the selection.

    A guided selection names its contact; only then must the length be known, the provenance be whole and the speaker be the
    expected one: the contact for incoming, the account for outgoing messages.
    """
    same = lambda name: I.not_blank(r[name]) & (r[name] == context[CONTEXT.get(name, name)])
    prints = lambda c: F.transform(c, lambda x: F.lower(x))
    whole = I.not_blank(r["source_database"]) & (F.size(r["fingerprints"]) > 0) & (prints(r["fingerprints"]) == prints(context["fingerprints"])) & I.not_blank(r["message_key"]) & I.not_blank(r["media_key"])
    for name in PROVENANCE:
        whole = whole & same(name)
    whole = whole & I.not_blank(r["account_id"]) & (r["account_id"] == context["account_id"])
    bound = lambda own, wanted: I.not_blank(own) & (own == (wanted if wanted is not None else own))
    expected = F.when(r["direction"] == "incoming", username if username is not None else r["speaker"]).otherwise(context["account_id"])
    return {
        "payload-state": r["payload_state"] == "Linked",
        "payload-empty": (r["payload_length"] > 0) if guided else F.coalesce(r["payload_length"] > 0, F.lit(True)),
        "payload-locator": I.not_blank(r["locator_role"]) & I.not_blank(r["locator_key"]) & F.coalesce(r["locator_shard"] >= 0, F.lit(True)),
        "source-identity": I.not_blank(r["stable_key"]),
        "provenance": whole if guided else F.lit(True),
        "contact-identity": bound(r["conversation_id"], conversation) & bound(r["contact_id"], contact),
        "direction": r["direction"] == direction if direction is not None else F.lit(True),
        "speaker": I.not_blank(expected) & (r["speaker"] == expected) if guided else F.lit(True),
    }


def context_violation(r: dict[str, Column], context: dict[str, Column]) -> Column:
    """The first field of a record that is known and differs from the context's, or null."""
    out = F.lit(None).cast("string")
    prints = lambda c: F.transform(c, lambda x: F.lower(x))
    if "fingerprints" in r:
        out = F.when((F.size(r["fingerprints"]) > 0) & ~prints(r["fingerprints"]).eqNullSafe(prints(context["fingerprints"])), "fingerprints").otherwise(out)
    for name in reversed([n for n in PROVENANCE if n in r]):
        out = F.when(r[name].isNotNull() & ~r[name].eqNullSafe(context[CONTEXT.get(name, name)]), name).otherwise(out)
    return out


def speaker_violations(rows: DataFrame, speaker: str, contact: Column) -> DataFrame:
    """Rows spoken by someone other than the contact; an unknown speaker counts as the contact."""
    return rows.where(F.coalesce(F.col(speaker), contact) != contact)


def require_none(rows: DataFrame, error: Exception) -> None:
    """Raise if there is any row: nothing is returned before the whole selection is known to be sound."""
    if not rows.isEmpty():
        raise error
