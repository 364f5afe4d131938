"""Contacts, messages, media and scans over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import association as A
from ..operators.order import ordered_digest
from ..operators import report as R
from ..operators import selection as S
from ..schemas import schema
from .catalog import Catalog, ContactQuery, Context
from .registry import query

_MEDIA = """m AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, min(l_quantity)::BIGINT AS len, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1),
a AS (SELECT o.*, CASE WHEN n IS NULL THEN 'Missing' WHEN n > 1 THEN 'Ambiguous' WHEN coalesce(len, 0) = 0 THEN 'Empty' WHEN NOT ok THEN 'InvalidHeader' ELSE 'Linked' END AS state,
 CASE WHEN n = 1 THEN len WHEN n > 1 THEN 0 END AS length FROM orders o LEFT JOIN m USING (o_orderkey))"""


def _associated(t):
    media = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("len"), (F.col("l_returnflag") != "R").alias("ok"), "l_partkey")
    return A.associate(t.orders, media, ["o_orderkey"], "len", "ok", "l_partkey")


@query(f"WITH {_MEDIA} SELECT state, count(*) AS n FROM a GROUP BY 1")
def q_association_states(t):
    return _associated(t).groupBy(F.col("payload_state").alias("state")).agg(F.count("*").alias("n"))


@query(f"WITH {_MEDIA} SELECT o_orderkey, state, length FROM a")
def q_association_records(t):
    return _associated(t).select("o_orderkey", F.col("payload_state").alias("state"), F.col("payload_length").alias("length"))


@query(f"WITH {_MEDIA} SELECT o_orderkey, state, length FROM a WHERE state <> 'Missing' AND length BETWEEN 10 AND 40")
def q_association_size_filter(t):
    return A.size_filter(_associated(t), 10, 40).select("o_orderkey", F.col("payload_state").alias("state"), F.col("payload_length").alias("length"))


@query("SELECT o_orderkey, c_name AS sender FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'MACHINERY'")
def q_sender_lookup(t):
    names = t.customer.where(F.col("c_mktsegment") != "MACHINERY").select("c_custkey", F.col("c_name").alias("sender"))
    return A.sender_lookup(t.orders, names, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "sender")


@query("""SELECT o_orderkey, o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'MACHINERY'
WHERE o_orderstatus = 'F' AND c_custkey IS NOT NULL AND c_custkey <> 1 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey = 1""")
def q_direction_sender(t):
    names = t.customer.where(F.col("c_mktsegment") != "MACHINERY").select("c_custkey")
    rows = A.sender_lookup(t.orders, names, F.col("o_custkey") == F.col("c_custkey"))
    incoming = A.direction_filter(rows, "incoming", "o_orderstatus", "c_custkey", 1, "F", "O")
    outgoing = A.direction_filter(rows, "outgoing", "o_orderstatus", "o_custkey", 1, "F", "O")
    return incoming.select("o_orderkey", "o_custkey").unionByName(outgoing.select("o_orderkey", "o_custkey"))


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'incoming' ELSE 'outgoing' END AS direction, count(*) AS n, min(epoch(o_orderdate)::BIGINT) AS first_time FROM orders
WHERE o_orderstatus IN ('F', 'O') AND epoch(o_orderdate)::BIGINT BETWEEN 820454400 AND 852076800 GROUP BY 1""")
def q_direction_time(t):
    rows = A.time_filter(t.orders.where(F.col("o_orderstatus").isin("F", "O")), I.epoch(F.col("o_orderdate")), 820454400, 852076800)
    return rows.groupBy(A.direction_of(F.col("o_orderstatus"), "F", "O").alias("direction")).agg(F.count("*").alias("n"), F.min(I.epoch(F.col("o_orderdate"))).alias("first_time"))


@query("""WITH c AS (SELECT CASE WHEN c_name LIKE '%7' THEN c_name || '@ChatRoom' ELSE c_name END AS username, CASE WHEN c_nationkey % 3 = 2 THEN '  ' END AS alias, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment END AS remark,
CASE WHEN c_nationkey % 3 = 1 THEN ' ' || c_mktsegment END AS nick_name FROM customer)
SELECT username, alias, remark, nick_name, coalesce(remark, nick_name, username) AS display_name FROM c WHERE username NOT LIKE '%@ChatRoom' AND (username ILIKE '%build%' OR alias ILIKE '%build%' OR remark ILIKE '%build%' OR nick_name ILIKE '%build%') ORDER BY username LIMIT 200""")
def q_contact_search(t):
    k = F.col("c_nationkey") % 3
    own = {
        "id": F.col("c_custkey"), "username": F.when(F.col("c_name").endswith("7"), F.concat("c_name", F.lit("@ChatRoom"))).otherwise(F.col("c_name")), "alias": F.when(k == 2, "  "),
        "remark": F.when(k == 0, F.col("c_mktsegment")), "nick_name": F.when(k == 1, F.concat(F.lit(" "), "c_mktsegment")),
    }
    contact = t.customer.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema("contact").fields])
    none = [t.spark.createDataFrame([], schema(name)) for name in ("message_names", "messages", "media_names", "voice_info")]
    return Catalog(contact, *none, None, Context("family", "account")).contacts(ContactQuery(search="BuILD", limit=200))


@query("""SELECT o_orderkey, o_orderkey % 4 AS shard, epoch(o_orderdate)::BIGINT AS sec FROM orders ORDER BY sec, CASE WHEN o_orderkey % 4 = 3 THEN -1 ELSE o_orderkey % 4 END, o_orderkey LIMIT 150""")
def q_shard_merge_topk(t):
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") % 4).alias("shard"), I.epoch(F.col("o_orderdate")).alias("sec"))
    merged = S.merge_shards([rows.where(F.col("shard") == i) for i in range(4)])
    null_first = F.when(F.col("shard") != 3, F.col("shard")).asc_nulls_first()  # shard 3 stands for the shard without a number
    return S.first_rows(merged, ["sec", null_first, "o_orderkey"], 150)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderpriority IS NOT NULL ORDER BY o_orderkey LIMIT 50")
def q_limit_after_filter(t):
    inside = S.in_bounds(F.col("o_totalprice"), 100000, 200000) & S.in_bounds(F.length("o_orderpriority"), 0)
    return S.first_rows(t.orders.where(inside).select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50)


_ELIGIBLE = "(o_orderstatus = 'F' AND o_totalprice > 150000 AND o_orderpriority LIKE '1%')"


@query(f"""WITH e AS (SELECT o_orderkey, {_ELIGIBLE}::INT AS e, sum({_ELIGIBLE}::INT) OVER (ORDER BY epoch(o_orderdate), o_orderkey ROWS UNBOUNDED PRECEDING) AS ce FROM orders)
SELECT o_orderkey, e = 1 AS eligible FROM e WHERE ce - e < 25""")
def q_limit_after_eligibility(t):
    rows = t.orders.select("o_orderkey", I.epoch(F.col("o_orderdate")).alias("sec"), F.expr(_ELIGIBLE).alias("eligible"))
    return S.until_eligible(rows, ["sec", "o_orderkey"], F.col("eligible"), 25).select("o_orderkey", "eligible")


@query(f"""WITH {_MEDIA}, r AS (SELECT *, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS dur, state IN ('Linked', 'Ambiguous') AS ex FROM a)
SELECT count(*) AS matched, coalesce(sum(dur), 0)::BIGINT AS total_duration, count(dur) AS known_duration, count(*) - count(dur) AS unknown_duration, min(epoch(o_orderdate)::BIGINT) AS first_time,
max(epoch(o_orderdate)::BIGINT) AS last_time, count(*) FILTER (WHERE ex) AS exportable, count(*) FILTER (WHERE NOT ex) AS rejected, coalesce(sum(length) FILTER (WHERE ex), 0)::BIGINT AS payload_bytes FROM r""")
def q_scan_report(t):
    duration = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))
    return R.scan_report(_associated(t), duration, I.epoch(F.col("o_orderdate")), F.col("payload_state").isin("Linked", "Ambiguous"), F.col("payload_length"))


@query("SELECT coalesce(CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_orderkey % 5 AS VARCHAR) END, 'unknown') AS shard, count(*) AS n FROM orders GROUP BY 1")
def q_shard_counts(t):
    return R.counts(t.orders, F.when(F.col("o_orderkey") % 5 != 4, F.col("o_orderkey") % 5), "shard")


@query("SELECT lower(o_orderstatus) AS state, count(*) AS n FROM orders GROUP BY 1")
def q_state_counts(t):
    return R.counts(t.orders, F.col("o_orderstatus"), "state")


@query("SELECT list_sort(list(s || '=' || n)) AS entries FROM (SELECT lower(o_orderstatus) AS s, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1)")
def q_state_count_map(t):
    counted = R.counts_map(t.orders, F.col("o_orderstatus"))
    return counted.select(F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))).alias("entries"))


@query("SELECT coalesce(sum(n - 1), 0)::BIGINT AS suspected_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text))")
def q_duplicate_count(t):
    return R.repeated(t.documents, F.sha2("text", 256))


@query("""SELECT doc_id, starts_with(text, 'The') OR starts_with(text, ' The') AS valid, octet_length(encode(text)) AS bytes FROM documents""")
def q_header_check(t):
    raw = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", A.has_voice_header(raw, b"The", b" ").alias("valid"), F.octet_length(raw).cast("long").alias("bytes"))


_KEY = "CASE WHEN o_custkey % 13 <> 0 AND regexp_matches(o_orderstatus, '\\S') THEN concat_ws('|', 'family', CAST(o_custkey AS VARCHAR), o_orderstatus, 'message:' || coalesce(CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderkey % 4 AS VARCHAR) END, '') || ':' || CAST(o_orderkey AS VARCHAR)) END"


def _key():
    account = F.when(F.col("o_custkey") % 13 != 0, F.col("o_custkey").cast("string")).otherwise(" ")
    shard = F.when(F.col("o_orderkey") % 4 != 3, F.col("o_orderkey") % 4)
    return I.stable_key(F.lit("family"), account, F.col("o_orderstatus"), F.concat(F.lit("message:"), I.joined(":", shard, F.col("o_orderkey"))))


@query(f"SELECT o_orderkey, k AS stable_key, sha256(k) AS transaction_key, 'Msg_' || md5(o_orderpriority) AS message_table FROM (SELECT *, {_KEY} AS k FROM orders)")
def q_stable_key(t):
    return t.orders.select("o_orderkey", _key().alias("stable_key"), I.transaction_key(_key()).alias("transaction_key"), I.message_table(F.col("o_orderpriority")).alias("message_table"))


@query(f"SELECT o_orderkey, 'original/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || substr(h, 1, 32) || '.silk' AS path FROM (SELECT o_orderkey, sha256({_KEY}) AS h FROM orders)")
def q_item_path(t):
    return t.orders.select("o_orderkey", I.item_path(_key()).alias("path"))


_PAD = lambda byte: "unhex('" + bytes(b ^ byte for b in b"an example of a key".ljust(64, b"\0")).hex() + "')"


@query(f"SELECT o_orderkey, sha256({_PAD(0x5C)} || unhex(sha256({_PAD(0x36)} || encode(k)))) AS item_id FROM (SELECT o_orderkey, {_KEY} AS k FROM orders)")
def q_item_pseudonym(t):
    return t.orders.select("o_orderkey", I.item_id(_key(), b"an example of a key").alias("item_id"))


@query(f"SELECT o_orderkey, sha256({_PAD(0x5C)} || unhex(sha256({_PAD(0x36)} || encode(k)))) AS item_id FROM (SELECT o_orderkey, {_KEY} AS k FROM orders)")
def q_item_pseudonym_by_column(t):
    return t.orders.select("o_orderkey", I.item_id_by(_key(), F.lit(b"an example of a key".hex())).alias("item_id"))


@query("""WITH l AS (SELECT o_custkey, o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) || chr(10) || o_orderstatus || chr(10) || CAST(o_custkey AS VARCHAR) || chr(10) AS line, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS part FROM orders),
p AS (SELECT o_custkey, part, sha256(string_agg(line, '' ORDER BY o_orderkey)) AS d, count(*) AS n FROM l GROUP BY 1, 2),
q AS (SELECT o_custkey, part // 4 AS part, sha256(string_agg(d || chr(10), '' ORDER BY part)) AS d, sum(n) AS n FROM p GROUP BY 1, 2)
SELECT o_custkey, sha256(string_agg(d || chr(10), '' ORDER BY part)) AS fingerprint, sum(n)::BIGINT AS n FROM q GROUP BY 1""")
def q_result_fingerprint(t):
    line = F.concat(F.sha2(F.col("o_orderkey").cast("string"), 256), F.lit("\n"), "o_orderstatus", F.lit("\n"), F.col("o_custkey").cast("string"), F.lit("\n"))
    return ordered_digest(t.orders, ["o_custkey"], [F.col("o_orderkey")], line, per=4)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE coalesce(CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END, 7) <> 7")
def q_speaker_violations(t):
    rows = t.orders.withColumn("speaker", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")))
    return S.speaker_violations(rows, "speaker", F.lit(7)).select("o_orderkey", "o_custkey")


@query("""SELECT event_id, user_id, sum((event_type = 'purchase')::INT) OVER w AS resolved, count(*) OVER w AS attempted, sum((event_type = 'error')::INT) OVER w AS failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def q_running_progress(t):
    from ..operators.manifest import running

    kind = F.col("event_type")
    told = running(t.events, ["user_id"], ["event_id"], {"resolved": kind == "purchase", "attempted": F.lit(True), "failed": kind == "error"})
    return told.select("event_id", "user_id", "resolved", "attempted", "failed")


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'signup' AND value > 190) THEN 1 WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 THEN 4 WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 0 ELSE 3 END AS code FROM events GROUP BY 1""")
def q_exit_code(t):
    kind = F.col("event_type")
    code = R.exit_code(F.count_if(kind == "purchase"), F.count_if(kind == "error"), F.bool_or((kind == "signup") & (F.col("value") > 190)))
    return t.events.groupBy("user_id").agg(code.alias("code"))
