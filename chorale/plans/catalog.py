"""The voice catalog: contacts and voice messages of one account, as lazily planned DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import association as A
from ..operators import report as R
from ..operators import selection as S
from ..schemas import require_schema, voice_heads

VOICE_TYPE = 34
#: Origins of received and sent messages (fixed values).
INCOMING, OUTGOING = 2, 5


class QueryError(ValueError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass(frozen=True)
class ContactQuery:
    username: str | None = None
    search: str | None = None
    limit: int | None = None

    def __post_init__(self):
        for name in ("username", "search"):
            if not (getattr(self, name) or "").strip():
                object.__setattr__(self, name, None)
        if self.limit is not None and self.limit <= 0:
            raise QueryError("InvalidRequest", "a limit is positive")


@dataclass(frozen=True)
class VoiceQuery:
    """One contact's voice messages; times in unix seconds, bounds inclusive."""

    contact: str
    direction: str | None = None
    first: int | None = None
    last: int | None = None
    least_bytes: int | None = None
    most_bytes: int | None = None
    least_ms: int | None = None
    most_ms: int | None = None
    limit: int | None = None
    deep: bool = False

    def __post_init__(self):
        if not self.contact.strip() or self.contact.lower().endswith("@chatroom"):
            raise QueryError("GroupChatNotSupported" if self.contact.strip() else "InvalidRequest")
        if self.direction not in (None, "incoming", "outgoing"):
            raise QueryError("InvalidRequest", "direction")
        if self.limit is not None and self.limit <= 0:
            raise QueryError("InvalidRequest", "a limit is positive")
        for low, high in (("first", "last"), ("least_bytes", "most_bytes"), ("least_ms", "most_ms")):
            a, b = getattr(self, low), getattr(self, high)
            if low != "first" and min(x for x in (a, b, 0) if x is not None) < 0:
                raise QueryError("InvalidRequest", "bounds are not negative")
            if a is not None and b is not None and a > b:
                raise QueryError("InvalidRequest", f"{low} is above {high}")

    @property
    def sized(self) -> bool:
        return self.least_bytes is not None or self.most_bytes is not None


@dataclass(frozen=True)
class Context:
    """Who the records belong to: family and account are part of their stable keys, the whole of their provenance."""

    family: str
    account_stable_id: str
    dataset_id: str | None = None
    adapter_id: str | None = None
    adapter_version: str | None = None
    snapshot_id: str | None = None
    source_database: str | None = None
    fingerprints: tuple[str, ...] = ()


class Catalog:
    """Tables are the landed ones of ``chorale.schemas``. Scans read ``voice_heads``, which landing writes beside the payloads;
    without it, the heads are computed from the payloads at each scan."""

    def __init__(self, contact: DataFrame, message_names: DataFrame, messages: DataFrame, media_names: DataFrame, voice_info: DataFrame, account: str | None, context: Context, heads: DataFrame | None = None, media_shard: int | None = None):
        self.tables = {n: require_schema(df, n) for n, df in (("contact", contact), ("message_names", message_names), ("messages", messages), ("media_names", media_names), ("voice_info", voice_info))}
        self.heads = require_schema(heads, "voice_heads") if heads is not None else voice_heads(voice_info)
        self.account, self.context, self.media_shard = account, context, media_shard

    def contacts(self, query: ContactQuery = ContactQuery()) -> DataFrame:
        """Persons only, by username; search folds A-Z."""
        c = self.tables["contact"].where(F.col("username").isNotNull() & (F.col("username") != "") & ~I.fold_ascii(F.col("username")).endswith("@chatroom"))
        if query.username is not None:
            c = c.where(F.col("username") == query.username)
        if query.search is not None:
            term = I.fold_ascii(F.lit(query.search))
            hit = F.lit(False)
            for name in ("username", "alias", "remark", "nick_name"):
                hit = hit | F.coalesce(F.contains(I.fold_ascii(F.col(name)), term), F.lit(False))
            c = c.where(hit)
        shown = I.first_not_blank(*[F.col(n) for n in ("remark", "nick_name", "alias", "username")])
        c = c.select("username", "alias", "remark", "nick_name", shown.alias("display_name")).orderBy("username")
        return c.limit(query.limit) if query.limit is not None else c

    def resolve(self, username: str) -> dict:
        """The one contact of this name, else an error."""
        found = self.contacts(ContactQuery(username=username)).limit(2).collect()
        if len(found) != 1:
            raise QueryError("ContactNotFound")
        return found[0].asDict()

    def evidence(self) -> str:
        """Confirmed if one contact row names itself as the account."""
        own = self.tables["contact"].where((F.col("username") == self.account) & (F.col("encrypt_username") == F.col("username"))).count()
        return "Confirmed" if own == 1 else "Candidate"

    def _rows(self, q: VoiceQuery) -> DataFrame:
        """The conversation's voice messages with their senders; a conversation that has no messages has no rows."""
        if self.account is None:
            raise QueryError("WorkspaceInvalid", "no account")
        m = self.tables["messages"].where((F.col("conversation_username") == q.contact) & (F.col("local_type") == VOICE_TYPE))
        m = A.time_filter(m, F.col("create_time"), q.first, q.last)
        names = self.tables["message_names"].select(F.col("shard_number").alias("_shard"), "row_id", F.col("user_name").alias("sender"))
        rows = A.sender_lookup(m, names, F.col("shard_number").eqNullSafe(F.col("_shard")) & (F.col("real_sender_id") == F.col("row_id")))
        return A.direction_filter(rows.drop("_shard", "row_id"), q.direction, "origin_source", "sender", self.account, INCOMING, OUTGOING)

    ORDER = ("create_time", "shard_number", "local_id", "server_id")

    def voices(self, q: VoiceQuery, unordered: bool = False) -> DataFrame:
        """The records in order (if asked, without it), limited after all filters. Raises before returning if anyone but the
        contact speaks."""
        rows = self._rows(q)
        if q.direction != "outgoing":
            checked = rows if q.limit is None or q.sized else rows.orderBy(*[F.col(c).asc_nulls_first() for c in self.ORDER]).limit(q.limit)
            S.require_none(S.speaker_violations(checked, "sender", F.lit(q.contact)).limit(1), QueryError("GroupChatNotSupported"))
        media = self.heads.join(self.tables["media_names"].where(F.col("user_name") == q.contact).select(F.col("row_id").alias("chat_name_id")), "chat_name_id")
        media = media.select(
            "create_time", "local_id", F.col("svr_id").alias("server_id"), F.col("payload_length").alias("length"), A.has_voice_header(F.col("payload_prefix")).alias("valid"),
            F.struct("row_id", (F.col("payload_sha256") if q.deep else F.lit(None).cast("string")).alias("sha256")).alias("media"),
        )
        if q.sized:
            media = media.where(F.coalesce(S.in_bounds(F.col("length"), q.least_bytes, q.most_bytes), F.lit(False)))
        found = A.associate(rows, media, ["local_id", "server_id", "create_time"], "length", "valid", "media")
        found = A.size_filter(found, q.least_bytes, q.most_bytes)
        linked = F.col("payload_state") == "Linked"
        direction = A.direction_of(F.col("origin_source"), INCOMING, OUTGOING)
        key = I.message_key(F.col("shard_number"), F.col("table_name"), F.col("local_id"), F.col("server_id"))
        media_key = I.media_key(F.col("payload_state"), F.lit(q.contact), F.col("local_id"), F.col("server_id"), F.col("create_time"))
        found = found.select(
            I.message_id(F.col("shard_number"), F.col("local_id"), F.col("server_id")).alias("message_id"), *self.ORDER, F.timestamp_seconds("create_time").alias("occurred_at_utc"),
            direction.alias("direction"), F.coalesce("sender", F.lit(q.contact)).alias("speaker_id"), "payload_state", F.coalesce("payload_length", F.lit(0)).alias("payload_length"),
            F.when(linked, F.struct(F.lit("media").alias("logical_role"), F.lit(self.media_shard).cast("int").alias("shard_number"), F.col("media_row.row_id").cast("string").alias("blob_key"))).alias("payload_locator"),
            F.when(linked, F.col("media_row.sha256")).alias("payload_sha256"), key.alias("message_primary_key"), media_key.alias("media_primary_key"),
            I.stable_key(F.lit(self.context.family), F.lit(self.context.account_stable_id), F.lit(q.contact), key, media_key).alias("source_stable_key"), F.lit(None).cast("long").alias("duration_ms"),
        )
        if unordered:
            return found
        found = found.orderBy(*[F.col(c).asc_nulls_first() for c in self.ORDER])
        return found.limit(q.limit) if q.limit is not None else found

    def payload(self, locator: dict) -> bytes:
        """The payload that a record's ``payload_locator`` names: of the media tables, by row id. Of a landed SQLite table this
        reads the one range that holds the row."""
        role, shard, key = (locator.get(k) for k in ("logical_role", "shard_number", "blob_key"))
        row = int(key) if re.fullmatch("[0-9]{1,19}", str(key or "")) else 0
        if str(role).lower() != "media" or shard != self.media_shard or not 0 < row < 1 << 63:
            raise QueryError("InvalidRequest", "the locator is not of this catalog's media")
        found = self.tables["voice_info"].where(F.col("row_id") == row).select("voice_data").limit(1).collect()
        if not found or found[0][0] is None:
            raise QueryError("PayloadNotFound", "no such payload")
        return bytes(found[0][0])

    def scan(self, q: VoiceQuery, durations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(records seen, one-row report): the limit counts exportable records, the report every record seen.

        ``durations`` gives (message_id, duration_ms); without it durations are unknown and satisfy no bound.
        """
        records = self.voices(replace(q, limit=None), unordered=True)
        if durations is not None:
            records = records.drop("duration_ms").join(durations.select("message_id", "duration_ms"), "message_id", "left")
        records = records.where(S.in_bounds(F.col("payload_length"), q.least_bytes, q.most_bytes) & S.in_bounds(F.col("duration_ms"), q.least_ms, q.most_ms))
        known = self._provenance()
        row = known | {
            "payload_state": F.col("payload_state"), "payload_length": F.col("payload_length"), "locator_role": F.col("payload_locator.logical_role"), "locator_key": F.col("payload_locator.blob_key"),
            "locator_shard": F.col("payload_locator.shard_number"), "stable_key": F.col("source_stable_key"), "message_key": F.col("message_primary_key"), "media_key": F.col("media_primary_key"),
            "conversation_id": F.lit(q.contact), "contact_id": F.lit(q.contact), "direction": F.col("direction"), "speaker": F.col("speaker_id"),
        }
        tests = S.export_tests(row, known, True, F.lit(q.contact), F.lit(q.contact), F.lit(q.contact), q.direction)
        records = records.withColumn("reason_code", S.reject_reason(tests))
        if q.limit is not None:
            ordered = records.withColumn("_shard", F.coalesce("shard_number", F.lit(-1)))
            records = S.until_eligible(ordered, ["create_time", "_shard", "local_id", "server_id"], F.col("reason_code").isNull(), q.limit).drop("_shard")
        states = [F.count_if(F.col("payload_state") == s).alias(s.lower()) for s in A.STATES]
        report = R.scan_report(records, F.col("duration_ms"), F.col("create_time"), F.col("reason_code").isNull(), F.col("payload_length"), *states)
        return records.orderBy(*[F.col(c).asc_nulls_first() for c in self.ORDER]), report

    def _provenance(self) -> dict:
        """What all records of this catalog carry of it."""
        c = self.context
        text = {"dataset_id": c.dataset_id, "adapter_id": c.adapter_id, "adapter_family": c.family, "adapter_version": c.adapter_version, "account_id": self.account, "account_stable_id": self.account, "snapshot_id": c.snapshot_id, "source_database": c.source_database}
        return {k: F.lit(v).cast("string") for k, v in text.items()} | {"fingerprints": F.array(*[F.lit(f) for f in c.fingerprints]).cast("array<string>")}


def eligible_fingerprint(records: DataFrame) -> str:
    """sha256 over the eligible records' keys, states and lengths in their order, streamed row by row, as this hash has to be.

    The driver holds one partition at a time; ``manifest.ordered_digest`` is the form that Spark computes.
    """
    import hashlib

    digest = hashlib.sha256()
    rows = records.where("reason_code IS NULL").orderBy(*[F.col(c).asc_nulls_first() for c in Catalog.ORDER])
    for r in rows.select("source_stable_key", "payload_state", "payload_length").toLocalIterator():
        digest.update(f"{r[0]}\n{r[1]}\n{r[2]}\n".encode())
    return digest.hexdigest()
