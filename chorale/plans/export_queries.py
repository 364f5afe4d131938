"""Manifests, journals, curation, reconciliation, retention and recovery over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import pcm
from ..operators import curation as C
from ..operators import manifest as M
from ..operators import reconcile as X
from ..operators import recovery as V
from ..operators import retention as K
from ..operators import segments as G
from .registry import query

_SELECTED = "coalesce(quality, 0) = 1 AND doc_id % 3 = 0"
_ITEMS = f"i AS (SELECT d.*, quality, toxic, sha256(text) AS sha, octet_length(encode(text)) AS bytes, CASE WHEN doc_id % 9 <> 0 THEN n_chars END AS duration, {_SELECTED} AS selected FROM documents d LEFT JOIN labels USING (doc_id))"


def _items(t):
    return t.documents.join(t.labels, "doc_id", "left").withColumns({
        "sha": F.sha2("text", 256), "bytes": F.octet_length("text").cast("long"), "duration": F.when(F.col("doc_id") % 9 != 0, F.col("n_chars")), "selected": F.expr(_SELECTED),
    })


@query(f"""WITH {_ITEMS}, g AS (SELECT sha, count(*) AS size, min(doc_id) AS first_item, max(doc_id) AS last_item, count(*) FILTER (WHERE selected) AS n_selected, min(doc_id) FILTER (WHERE selected) AS one FROM i GROUP BY 1 HAVING count(*) > 1)
SELECT 'duplicate-' || substr(sha, 1, 16) AS group_id, sha, size, first_item, last_item, n_selected, CASE WHEN n_selected = 1 THEN one END AS representative FROM g""")
def q_duplicate_groups(t):
    return C.duplicate_groups(_items(t), "sha", "doc_id", F.col("selected"))


@query(f"WITH {_ITEMS} SELECT sha, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_selected FROM i GROUP BY 1 HAVING count(*) > 1 AND count(*) FILTER (WHERE doc_id % 2 = 0) > 1")
def q_representative_rule(t):
    return C.several_selected(C.duplicate_groups(_items(t), "sha", "doc_id", F.col("doc_id") % 2 == 0)).select("sha", "n_selected")


_PASS = "(NOT coalesce(toxic = 1, false) AND source IN ('src0', 'src1', 'src2', 'src3') AND duration BETWEEN 200 AND 8000 AND bytes > 0 AND lang NOT IN ('fr'))"


def _passes(show):
    return C.passes_filters(
        F.col("duration"), F.col("bytes"), F.array(F.upper("lang")), F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("source"), 200, 8000, ["FR"], ["src0", "src1", "src2", "src3"], show
    )


@query(f"""WITH {_ITEMS}, p AS (SELECT *, {_PASS.replace("duration BETWEEN 200 AND 8000", "(duration IS NULL OR duration BETWEEN 200 AND 8000)")} AS pass FROM i), g AS (SELECT sha, count(*) AS size FROM i GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, CASE WHEN NOT pass THEN 'Rejected' WHEN duration IS NULL THEN 'Unknown' ELSE 'Eligible' END AS eligibility, CASE WHEN size IS NOT NULL THEN 'duplicate-' || substr(p.sha, 1, 16) END AS group_id, size FROM p LEFT JOIN g ON g.sha = p.sha""")
def q_curation_items(t):
    items = _items(t)
    groups = C.duplicate_groups(items, "sha", "doc_id", F.col("selected"))
    return C.with_group(items, groups, "sha").select("doc_id", C.eligibility(_passes(True), F.col("duration")).alias("eligibility"), "group_id", "size")


@query(f"WITH {_ITEMS} SELECT doc_id FROM i WHERE {_PASS} AND duration IS NOT NULL AND coalesce(CASE WHEN quality = 0 THEN 'Rejected' END, '') <> 'Rejected'")
def q_training_eligible(t):
    stored = F.when(F.col("quality") == 0, "Rejected")
    return _items(t).where(C.training_eligible(_passes(False), F.col("duration"), stored)).select("doc_id")


@query("""WITH f AS (SELECT doc_id, [upper(source), 'Src1', 'Ärger', lang, 'zz'] AS f FROM documents), u AS (SELECT doc_id, f, list_sort(list_distinct(list_transform(f, lambda x: upper(x)))) AS u FROM f)
SELECT doc_id, list_transform(u, lambda k: f[list_position(list_transform(f, lambda x: upper(x)), k)]) AS flags FROM u""")
def q_flag_merge(t):
    a, b = F.array(F.upper("source"), F.lit(" "), F.lit("Src1")), F.array(F.lit("Ärger"), F.col("lang"), F.lit("zz"), F.lit("ÄRGER"))
    return t.documents.select("doc_id", C.merged_flags(a, b).alias("flags"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM (SELECT doc_id * 3 AS doc_id FROM documents) r WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def q_requested_ids(t):
    requested = t.documents.select((F.col("doc_id") * 3).alias("doc_id"))
    return X.outside(requested, t.documents, "doc_id").select(F.col("doc_id").cast("string").alias("id"))


@query(f"""WITH {_ITEMS} SELECT count(*) AS items, sum(duration)::BIGINT AS total_duration, sum(bytes)::BIGINT AS total_bytes, count(*) FILTER (WHERE selected) AS training_items, coalesce(sum(duration) FILTER (WHERE selected), 0)::BIGINT AS training_duration FROM i""")
def q_manifest_totals(t):
    return M.totals(_items(t), F.col("duration"), F.col("bytes"), F.col("selected"))


@query("SELECT row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), coalesce(CASE WHEN event_id % 50 <> 0 THEN CAST(event_id AS VARCHAR) END, ''), event_type, event_id) AS place, event_id FROM events")
def q_manifest_order(t):
    message = I.or_empty(F.when(F.col("event_id") % 50 != 0, F.col("event_id")))
    return K.ranked(t.events, ["user_id"], [I.epoch(F.col("ts")), message, "event_type", "event_id"], "place").select("place", "event_id")


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '@' WHEN 2 THEN '' WHEN 3 THEN '-' ELSE '"' END || text AS raw FROM documents), g AS (SELECT doc_id, CASE WHEN regexp_matches(raw, '^[=+\\-@]') THEN '''' || raw ELSE raw END AS guarded FROM f)
SELECT doc_id, CASE WHEN regexp_matches(guarded, '[,"\\r\\n]') THEN '"' || replace(guarded, '"', '""') || '"' ELSE guarded END AS field FROM g""")
def q_csv_guard(t):
    k = F.col("doc_id") % 5
    lead = F.when(k == 0, "=").when(k == 1, "@").when(k == 2, "").when(k == 3, "-").otherwise('"')
    return t.documents.select("doc_id", M.csv_field(F.concat(lead, F.col("text"))).alias("field"))


@query("""WITH p AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS item_id, sha256(text) AS sha256, n_chars AS duration_ms, octet_length(encode(text)) AS byte_length, source || '|' || lang AS quality_flags, lang = 'en' AS s FROM documents)
SELECT item_id, 'audio/' || item_id || '.wav' AS relative_audio_path, sha256, duration_ms, byte_length, quality_flags, 'Eligible' AS training_eligibility, CASE WHEN s THEN 'True' ELSE 'False' END AS selected FROM p""")
def q_portable_entries(t):
    item = I.item_id(F.col("doc_id").cast("string"))
    return M.portable_rows(t.documents, item, F.concat(F.lit("audio/"), item, F.lit(".wav")), F.sha2("text", 256), F.col("n_chars"), F.octet_length("text").cast("long"), F.array("source", "lang"), F.lit("Eligible"), F.col("lang") == "en")


@query("""SELECT 'original' AS kind, 'o/' || doc_id AS path, sha256(text) AS sha256, n_chars AS bytes FROM documents UNION ALL SELECT 'decoded', 'd/' || doc_id, md5(text), n_chars FROM documents WHERE lang <> 'fr'""")
def q_artifact_index(t):
    rows = t.documents.select(F.concat(F.lit("o/"), "doc_id").alias("op"), F.sha2("text", 256).alias("oh"), "n_chars", F.when(F.col("lang") != "fr", F.concat(F.lit("d/"), "doc_id")).alias("dp"), F.md5("text").alias("dh"))
    return M.artifact_index(rows, ("op", "oh", "n_chars"), ("dp", "dh", "n_chars"))


_ACTUAL = """b AS (SELECT doc_id, md5(text) AS h, CASE WHEN doc_id % 17 = 0 THEN n_chars + 1 ELSE n_chars END AS n FROM documents WHERE doc_id % 10 <> 3
UNION ALL SELECT doc_id + 1000000, md5(text), n_chars FROM documents WHERE doc_id % 100 = 5 UNION ALL SELECT doc_id, md5(text), n_chars FROM documents WHERE doc_id % 50 = 7)"""


def _actual(t):
    d = t.documents.select("doc_id", F.md5("text").alias("h"), F.col("n_chars").alias("n"))
    changed = d.where("doc_id % 10 <> 3").withColumn("n", F.when(F.col("doc_id") % 17 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return changed.unionByName(d.where("doc_id % 100 = 5").withColumn("doc_id", F.col("doc_id") + 1000000)).unionByName(d.where("doc_id % 50 = 7"))


@query(f"""WITH e AS (SELECT doc_id, md5(text) AS h, n_chars AS n FROM documents), {_ACTUAL}, u AS (SELECT doc_id, min(h) AS h, min(n) AS n, count(*) AS c FROM b GROUP BY 1)
SELECT doc_id, CASE WHEN u.doc_id IS NULL THEN 'csv-row-missing' WHEN e.doc_id IS NULL THEN 'csv-row-extra' ELSE 'csv-json-mismatch' END AS issue FROM e FULL JOIN u USING (doc_id) WHERE u.doc_id IS NULL OR e.doc_id IS NULL OR e.h <> u.h OR e.n <> u.n
UNION ALL SELECT doc_id, 'duplicate' FROM u WHERE c > 1""")
def q_reconcile(t):
    expected = t.documents.select("doc_id", F.md5("text").alias("h"), F.col("n_chars").alias("n"))
    return X.reconcile(expected, _actual(t), "doc_id", ["h", "n"], {"missing": "csv-row-missing", "extra": "csv-row-extra", "mismatch": "csv-json-mismatch"})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_uniqueness(t):
    return X.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""WITH l AS (SELECT DISTINCT lower(source || '-' || lang) AS v FROM documents WHERE n_chars > 900), r AS (SELECT DISTINCT lower(source || '-' || lang) AS v FROM documents WHERE n_chars < 300)
SELECT v, 'left' AS side FROM (SELECT v FROM l EXCEPT SELECT v FROM r) UNION ALL SELECT v, 'right' FROM (SELECT v FROM r EXCEPT SELECT v FROM l)""")
def q_set_compare(t):
    v = t.documents.select("n_chars", F.upper(F.concat_ws("-", "source", "lang")).alias("v"))
    return X.symmetric_difference(v.where("n_chars > 900"), v.where("n_chars < 300"), "v")


@query("SELECT lower(v) AS folded, arg_min(v, p_partkey) AS value FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type END AS v FROM part) GROUP BY 1")
def q_distinct_ci(t):
    v = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type"))
    return X.distinct_fold(t.part, v, F.col("p_partkey"))


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'item-committed' WHEN 'click' THEN 'item-skipped' WHEN 'error' THEN CASE WHEN user_id % 3 = 0 THEN 'note' WHEN value > 30 THEN 'item-failed' ELSE 'run-cancelled' END WHEN 'signup' THEN 'processing-completed' WHEN 'view' THEN CASE WHEN value > 90 THEN 'manifest-committed' ELSE 'run-started' END ELSE 'note' END AS e, event_id % 7 <> 0 AS entry, event_id % 5 <> 0 AS fail, CASE WHEN event_type = 'view' THEN 'c' || event_id % 11 END AS context FROM events),
f AS (SELECT *, sum((e = 'item-failed' AND fail)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS failed FROM e),
s AS (SELECT *, CASE WHEN e = 'run-cancelled' THEN 'Cancelled' WHEN e = 'processing-completed' AND failed > 0 THEN 'CompletedWithFailures' WHEN e = 'processing-completed' THEN 'Completed' END AS st FROM f)
SELECT user_id, count(*) FILTER (WHERE e IN ('item-committed', 'item-skipped') AND entry) AS entries, count(*) FILTER (WHERE e = 'item-failed' AND fail) AS failures, coalesce(arg_max(st, event_id) FILTER (WHERE st IS NOT NULL), 'Failed') AS status,
arg_max(context, event_id) FILTER (WHERE context IS NOT NULL) AS context, max(event_id) FILTER (WHERE e = 'manifest-committed') AS committed_at FROM s GROUP BY 1""")
def q_journal_status(t):
    kind = F.col("event_type")
    named = (
        F.when(kind == "purchase", "item-committed").when(kind == "click", "item-skipped").when((kind == "error") & (F.col("user_id") % 3 == 0), "note").when((kind == "error") & (F.col("value") > 30), "item-failed")
        .when(kind == "error", "run-cancelled").when(kind == "signup", "processing-completed").when((kind == "view") & (F.col("value") > 90), "manifest-committed").when(kind == "view", "run-started").otherwise("note")
    )
    i = F.col("event_id")
    context = F.when(kind == "view", F.concat(F.lit("c"), (i % 11).cast("string")))
    return M.journal_status(t.events.withColumn("event", named), "user_id", "event_id", "event", F.when(i % 7 != 0, 1), F.when(i % 5 != 0, 1), context, i, "Failed")


@query("SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS failures FROM events")
def q_running_failures(t):
    return M.running(t.events, ["user_id"], ["event_id"], {"failures": F.col("event_type") == "error"}).select("event_id", "failures")


_RUNS = "r AS (SELECT user_id, event_id, date_trunc('hour', ts) AS created, event_type <> 'error' AS complete, event_type = 'signup' AND value > 60 AS referenced FROM events)"


def _runs(t):
    kind = F.col("event_type")
    return t.events.select("user_id", "event_id", F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("created"), (kind != "error").alias("complete"), ((kind == "signup") & (F.col("value") > 60)).alias("referenced"))


@query(f"""WITH {_RUNS}, n AS (SELECT *, rank() OVER (PARTITION BY user_id, complete ORDER BY created DESC) - 1 AS newer FROM r)
SELECT event_id, CASE WHEN referenced THEN 'Referenced' WHEN NOT complete THEN 'KeepRecent' WHEN newer < 5 THEN 'KeepRecent' ELSE 'Compactable' END AS disposition FROM n""")
def q_keep_recent(t):
    return K.keep_recent(_runs(t), ["user_id"], "created", "complete", "referenced", 5).select("event_id", "disposition")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE value > 10 GROUP BY 1, 2 ORDER BY event_id DESC, user_id, event_type LIMIT 100000")
def q_latest_per_key(t):
    return K.latest_cache_rows(t.events, ["user_id", "event_type"], "event_id", "event_id", F.col("value") > 10).select("user_id", "event_type", "event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn > 1")
def q_all_but_newest(t):
    return K.all_but_newest(t.events, ["user_id", "event_type"], [F.desc("ts"), "event_id"]).select("event_id")


@query("SELECT l_key, l_name FROM (SELECT lower(p_brand) AS l_key, p_name AS l_name, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def q_newest_candidate(t):
    return K.newest(t.part, [F.lower("p_brand")], [F.desc("p_retailprice"), "p_partkey"]).select(F.lower("p_brand").alias("l_key"), F.col("p_name").alias("l_name"))


_KIND = "CASE event_type WHEN 'click' THEN 'snapshot' WHEN 'view' THEN 'workspace' WHEN 'error' THEN 'recoverable' WHEN 'signup' THEN 'transient' ELSE 'export' END"


@query(f"""WITH a AS (SELECT {_KIND} AS kind, event_id AS size, epoch(ts) < 1704758400 AS old FROM events), s AS (SELECT *, kind = 'transient' OR (kind = 'recoverable' AND old) AS free FROM a)
SELECT coalesce(sum(size) FILTER (WHERE kind = 'snapshot'), 0)::BIGINT AS snapshot_bytes, coalesce(sum(size) FILTER (WHERE kind IN ('workspace', 'recoverable')), 0)::BIGINT AS workspace_bytes, coalesce(sum(size) FILTER (WHERE kind = 'export'), 0)::BIGINT AS export_bytes,
coalesce(sum(size) FILTER (WHERE kind = 'dataset'), 0)::BIGINT AS dataset_bytes, coalesce(sum(size) FILTER (WHERE kind = 'transient'), 0)::BIGINT AS temporary_bytes, coalesce(sum(size) FILTER (WHERE kind = 'recoverable'), 0)::BIGINT AS recoverable_bytes, coalesce(sum(size) FILTER (WHERE free), 0)::BIGINT AS reclaimable_bytes FROM s""")
def q_storage_totals(t):
    kind = F.expr(_KIND)
    return K.storage_totals(t.events, kind, F.col("event_id"), K.reclaimable(kind, I.epoch(F.col("ts")), 1704758400))


@query(f"SELECT event_id FROM events WHERE {_KIND} = 'transient' OR ({_KIND} = 'recoverable' AND epoch(ts)::BIGINT < 1704758400)")
def q_reclaimable(t):
    return t.events.where(K.reclaimable(F.expr(_KIND), I.epoch(F.col("ts")), 1704758400)).select("event_id")


@query("""SELECT doc_id, copy_rank, copies, group_bytes FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS copy_rank, count(*) OVER (PARTITION BY md5(text)) AS copies, (sum(n_chars) OVER (PARTITION BY md5(text)))::BIGINT AS group_bytes FROM documents) WHERE copies > 1""")
def q_duplicate_snapshots(t):
    rows = t.documents.select("doc_id", F.md5("text").alias("content"), "n_chars")
    return K.duplicate_snapshots(rows, "content", "n_chars", [F.desc("doc_id")]).select("doc_id", "copy_rank", "copies", "group_bytes")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, round(list_max(list_transform(e, lambda x: abs(x))), 6) AS peak, round(sqrt(list_sum(list_transform(e, lambda x: x * x)) / len(e)), 6) AS rms, round(len(list_filter(e, lambda x: abs(x) <= 0.01)) / len(e)::DOUBLE, 6) AS silence_ratio, round(len(list_filter(e, lambda x: abs(x) >= 0.3)) / len(e)::DOUBLE, 6) AS clipping_ratio FROM v""")
def q_pcm_metrics(t):
    m = pcm.frame_metrics(F.col("embedding"), silence=0.01, clipping=0.3)
    return t.embeddings.select("vec_id", m.alias("m")).select("vec_id", *[F.round(f"m.{c}", 6).alias(c) for c in ("peak", "rms", "silence_ratio", "clipping_ratio")])


_SEGMENTS = """s AS (SELECT doc_id, n_chars AS r, CASE WHEN n_chars < 100 THEN 1 WHEN n_chars % 1000 < 100 AND n_chars >= 1000 THEN n_chars // 1000 ELSE n_chars // 1000 + 1 END AS n FROM documents),
x AS (SELECT doc_id, r, n, unnest(range(0, n)) AS segment FROM s),
y AS (SELECT doc_id, segment::INT AS segment, segment * 1000 AS start, CASE WHEN segment = n - 1 THEN r - segment * 1000 ELSE 1000 END AS length, r FROM x),
z AS (SELECT *, CASE WHEN r < 100 THEN 'shorter-than-one-second' WHEN length > 1050 THEN 'segment-out-of-range' ELSE 'kept' END AS outcome FROM y)"""


@query(f"WITH {_SEGMENTS} SELECT doc_id, segment, start, length, outcome, unnest(range(1, CASE WHEN outcome = 'kept' THEN 2 + (doc_id % 2) ELSE 2 END))::INT AS copy FROM z")
def q_segments(t):
    found = G.plan_segments(t.documents.select("doc_id", "n_chars"), F.col("n_chars"), 100, 1050, 1000, 1 + F.col("doc_id") % 2)
    return found.select("doc_id", "segment", "start", "length", "outcome", "copy")


@query(f"WITH {_SEGMENTS} SELECT count(*) FILTER (WHERE outcome = 'kept') AS kept, count(*) FILTER (WHERE outcome <> 'kept') AS rejected, sum(length) FILTER (WHERE outcome = 'kept')::BIGINT AS kept_length, sum(2 * length) FILTER (WHERE outcome = 'kept')::BIGINT AS kept_bytes FROM z")
def q_segment_totals(t):
    found = G.plan_segments(t.documents.select("doc_id", "n_chars"), F.col("n_chars"), 100, 1050, 1000)
    return G.segment_totals(found, 2 * F.col("length"))


@query(f"""WITH {_ACTUAL}, u AS (SELECT doc_id, min(h) AS fh, min(n) AS fn FROM b GROUP BY 1), k AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN upper(md5(text)) END AS kh, CASE WHEN doc_id % 6 <> 0 THEN n_chars END AS kn FROM documents)
SELECT doc_id, CASE WHEN fh IS NULL THEN 'Missing' WHEN kh IS NOT NULL AND lower(kh) = fh AND (kn IS NULL OR kn = fn) THEN 'VerifiedExisting' WHEN kh IS NULL AND (kn IS NULL OR kn = fn) THEN 'PendingExisting' ELSE 'Conflict' END AS original,
CASE WHEN fh IS NULL THEN 'Missing' WHEN (kh IS NULL OR lower(kh) = fh) AND (kn IS NULL OR kn = fn) AND (kh IS NOT NULL OR doc_id % 5 <> 0) THEN 'VerifiedExisting' ELSE 'Conflict' END AS decoded FROM k LEFT JOIN u USING (doc_id)""")
def q_artifact_state(t):
    known = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.upper(F.md5("text"))).alias("kh"), F.when(F.col("doc_id") % 6 != 0, F.col("n_chars")).alias("kn"))
    found = _actual(t).groupBy("doc_id").agg(F.min("h").alias("fh"), F.min("n").alias("fn"))
    both = known.join(found, "doc_id", "left")
    there, columns = F.col("fh").isNotNull(), [F.col(c) for c in ("kh", "fh", "kn", "fn")]
    return both.select("doc_id", V.original_state(there, *columns).alias("original"), V.decoded_state(there, *columns, F.col("doc_id") % 5 != 0).alias("decoded"))


_STATE = "CASE user_id % 6 WHEN 0 THEN 'Completed' WHEN 1 THEN 'RolledBack' WHEN 2 THEN 'Staging' WHEN 3 THEN 'FailedRecoverable' WHEN 4 THEN 'Prepared' ELSE 'Publishing' END"


@query(f"""WITH i AS (SELECT user_id, {_STATE} AS state, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS items, count(*) FILTER (WHERE event_type = 'purchase') AS resolved, count(*) FILTER (WHERE event_type = 'signup') AS published, bool_or(value > 99) AS jc FROM events GROUP BY 1, 2)
SELECT user_id, CASE WHEN state = 'Completed' THEN 'leave' WHEN state = 'RolledBack' THEN 'clean-staging' WHEN state IN ('Staging', 'Prepared') AND published = 0 THEN 'roll-back' WHEN state = 'FailedRecoverable' AND items = 0 AND NOT jc THEN 'roll-back' WHEN items = resolved THEN 'resume-metadata' ELSE 'error' END AS decision FROM i""")
def q_recovery_decision(t):
    kind = F.col("event_type")
    items = t.events.groupBy("user_id", F.expr(_STATE).alias("state")).agg(F.count_if(kind.isin("purchase", "error")).alias("items"), F.count_if(kind == "purchase").alias("resolved"), F.count_if(kind == "signup").alias("published"), F.bool_or(F.col("value") > 99).alias("jc"))
    return items.select("user_id", V.recovery_decision(*[F.col(c) for c in ("state", "items", "resolved", "published", "jc")]).alias("decision"))


@query("""WITH s AS (SELECT event_id, lag(st) OVER (PARTITION BY user_id ORDER BY event_id) AS b, st AS a FROM (SELECT *, CASE event_type WHEN 'view' THEN 'Staging' WHEN 'click' THEN 'DatabasesCommitted' WHEN 'signup' THEN 'WorkspaceCommitted' WHEN 'purchase' THEN 'Completed' ELSE 'FailedRecoverable' END AS st FROM events))
SELECT event_id, (a = 'FailedRecoverable' AND b <> 'Completed') OR (b = 'Staging' AND a = 'DatabasesCommitted') OR (b = 'DatabasesCommitted' AND a = 'WorkspaceCommitted') OR (b = 'WorkspaceCommitted' AND a = 'Completed') AS legal FROM s WHERE b IS NOT NULL""")
def q_legal_moves(t):
    from pyspark.sql import Window

    kind = F.col("event_type")
    state = F.when(kind == "view", "Staging").when(kind == "click", "DatabasesCommitted").when(kind == "signup", "WorkspaceCommitted").when(kind == "purchase", "Completed").otherwise("FailedRecoverable")
    rows = t.events.withColumn("a", state).withColumn("b", F.lag("a").over(Window.partitionBy("user_id").orderBy("event_id"))).where("b IS NOT NULL")
    return rows.select("event_id", V.legal_move(F.col("b"), F.col("a"), V.MATERIALIZATION).alias("legal"))


@query("""WITH e AS (SELECT doc_id, sha256(text) AS h FROM documents), a AS (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN md5(text) ELSE upper(sha256(text)) END AS h FROM documents WHERE doc_id % 30 <> 0)
SELECT doc_id, CASE WHEN a.h IS NULL THEN 'metadata-commit-file-missing' ELSE 'metadata-commit-hash-mismatch' END AS issue FROM e LEFT JOIN a USING (doc_id) WHERE a.h IS NULL OR lower(a.h) <> e.h""")
def q_hash_reconcile(t):
    e = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    a = t.documents.where("doc_id % 30 <> 0").select("doc_id", F.lower(F.when(F.col("doc_id") % 20 == 0, F.md5("text")).otherwise(F.upper(F.sha2("text", 256)))).alias("h"))
    return X.reconcile(e, a, "doc_id", ["h"], {"missing": "metadata-commit-file-missing", "mismatch": "metadata-commit-hash-mismatch"})


@query("SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 9700) AS self_rows, CASE WHEN count(*) FILTER (WHERE c_acctbal > 9700) = 1 THEN 'Confirmed' ELSE 'Candidate' END AS evidence FROM customer GROUP BY 1")
def q_account_evidence(t):
    return V.account_evidence(t.customer, ["c_nationkey"], F.col("c_acctbal") > 9700)


_ROLE = "CASE p_partkey % 4 WHEN 0 THEN 'message' WHEN 1 THEN 'media' WHEN 2 THEN 'contact' ELSE 'message' END"


@query(f"""WITH a AS (SELECT p_brand, p_size, {_ROLE} AS role, p_partkey % 3 AS shard FROM part), g AS (SELECT p_brand, p_size, count(*) FILTER (WHERE role = 'message') AS m, count(*) FILTER (WHERE role = 'media') AS d, count(*) FILTER (WHERE role = 'contact') AS c,
list_sort(coalesce(list(DISTINCT shard) FILTER (WHERE role = 'message'), [])) AS ms, list_sort(coalesce(list(DISTINCT shard) FILTER (WHERE role = 'media'), [])) AS ds FROM a GROUP BY 1, 2)
SELECT p_brand, p_size, 'missing-message-database' AS code, 'error' AS severity FROM g WHERE m = 0 UNION ALL SELECT p_brand, p_size, 'missing-media-database', 'error' FROM g WHERE d = 0 UNION ALL SELECT p_brand, p_size, 'missing-contact-database', 'warning' FROM g WHERE c = 0
UNION ALL SELECT p_brand, p_size, 'unverified-shard-topology', 'info' FROM g WHERE m > 0 AND d > 0 AND ms <> ds""")
def q_topology_issues(t):
    rows = t.part.select("p_brand", "p_size", F.expr(_ROLE).alias("role"), (F.col("p_partkey") % 3).alias("shard"))
    return V.topology_issues(rows, ["p_brand", "p_size"], "role", "shard")


@query(f"""WITH a AS (SELECT p_brand, p_size, {_ROLE} AS role, p_retailprice > 905 AS ok FROM part) SELECT p_brand, p_size, count(*) FILTER (WHERE role = 'contact') = 1 AND count(*) FILTER (WHERE role = 'media') = 1 AND count(*) FILTER (WHERE role = 'message') >= 1 AND bool_and(ok) AS accepted FROM a GROUP BY 1, 2""")
def q_adapter_probe(t):
    rows = t.part.select("p_brand", "p_size", F.expr(_ROLE).alias("role"), (F.col("p_retailprice") > 905).alias("ok"))
    return V.accepts(rows, ["p_brand", "p_size"], "role", F.col("ok"))


_NAME = "CASE page_id % 8 WHEN 0 THEN 'Message_' || page_id || '.db' WHEN 1 THEN 'media_' || page_id || '.db' WHEN 2 THEN 'my_Contact.db' WHEN 3 THEN 'friend_2.db' WHEN 4 THEN 'message_' || page_id || '_fts.db' WHEN 5 THEN 'message_99999999999.db' WHEN 6 THEN 'MEDIA_+7' ELSE 'other_' || page_id || '.x_9' END"


@query(f"""WITH n AS (SELECT page_id, lower({_NAME}) AS f FROM pages) SELECT page_id, CASE WHEN TRY_CAST(nullif(regexp_extract(s, '^message_([0-9+]+)$', 1), '') AS INT) IS NOT NULL THEN 'message' WHEN TRY_CAST(nullif(regexp_extract(s, '^media_([0-9+]+)$', 1), '') AS INT) IS NOT NULL THEN 'media' WHEN f LIKE '%contact%' OR f LIKE '%friend%' THEN 'contact' ELSE 'unknown' END AS role,
TRY_CAST(nullif(regexp_extract(s, '_([0-9+]+)$', 1), '') AS INT) AS shard FROM (SELECT *, regexp_replace(f, '\\.[^.]*$', '') AS s FROM n)""")
def q_role_from_name(t):
    role, shard = V.role_of_file(F.expr(_NAME))
    return t.pages.select("page_id", role.alias("role"), shard.alias("shard"))


_FOLDER = "CASE page_id % 3 WHEN 0 THEN 'wxid_u' || page_id || '_' || substr(md5(url), 1, 4) WHEN 1 THEN 'wxid_u' || page_id || '_' || substr(md5(url), 1, 16) ELSE 'wxid_u' || page_id || '_' || substr(md5(url), 1, 7) END"


@query(f"SELECT page_id, nullif(regexp_extract({_FOLDER}, '^(wxid_.+)_([0-9a-fA-F]{{4}}|[0-9a-fA-F]{{16}})$', 1), '') AS account, regexp_replace(regexp_replace('user WX' || substr({_FOLDER}, 3) || '-a seen ' || md5(url) || ' x' || md5(url) || ' ' || substr(md5(url), 1, 20), '(?i)wxid_[a-z0-9_]+', 'wxid_***', 'g'), '\\b[0-9a-fA-F]{{32,}}\\b', '***', 'g') AS redacted FROM pages")
def q_account_folder(t):
    name = F.expr(_FOLDER)
    return t.pages.select("page_id", V.account_folder(name).alias("account"), V.redact_accounts(F.concat(F.lit("user WX"), F.substring(name, 3, 1000), F.lit("-a seen "), F.md5("url"), F.lit(" x"), F.md5("url"), F.lit(" "), F.substring(F.md5("url"), 1, 20))).alias("redacted"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 4 = 0 THEN o_custkey END, c.d, 0)::BIGINT AS duration, c.d IS NOT NULL AS hit FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity)::BIGINT AS d FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING max(l_quantity) > 10) c ON l_orderkey = o_orderkey""")
def q_cache_lookup(t):
    cache = t.lineitem.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.max("l_quantity").cast("long")).alias("duration"))
    cache = cache.withColumn("duration", F.when(F.col("duration") > 10, F.col("duration")).otherwise(0))
    found = K.cache_lookup(t.orders, cache, ["o_orderkey"], "duration", F.when(F.col("o_custkey") % 4 == 0, F.col("o_custkey")))
    return found.select("o_orderkey", F.coalesce("duration", F.lit(0)).cast("long").alias("duration"), "hit")


@query("""SELECT p_brand, count(*) AS listed, count(s) AS covered, (sum(p_partkey) FILTER (WHERE s IS NOT NULL))::BIGINT AS covered_bytes, count(*) = count(s) AS complete FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS s FROM lineitem WHERE l_quantity > 20) ON s = p_partkey GROUP BY 1""")
def q_deletion_coverage(t):
    there = t.lineitem.where("l_quantity > 20").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return K.deletion_coverage(t.part, there.withColumn("size", F.col("p_partkey")), ["p_brand"], "p_partkey", "size")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 5 <> 0 AND n_chars < 500")
def q_orphan_sweep(t):
    i = F.col("doc_id")
    name = F.when(i % 4 == 0, F.concat(F.lit("a/."), "source", F.lit(".staging"))).when(i % 4 == 1, F.concat("source", F.lit(".input.silk"))).when(i % 4 == 2, F.concat("lang", F.lit(".tmp-0a"))).otherwise(F.concat("lang", F.lit(".wav")))
    return K.orphans(t.documents.withColumn("path", name), "path", F.col("n_chars"), 500, i % 5 == 0).select("doc_id")


@query("SELECT doc_id, sha256(concat_ws('|', source, coalesce(lang, ''), CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) ELSE '' END)) AS fingerprint, regexp_matches(md5(text) || md5(text), '^[0-9a-fA-F]{64}$') AND n_chars > 0 AS valid FROM documents")
def q_group_fingerprint(t):
    fp = I.group_fingerprint(F.col("source"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")))
    return t.documents.select("doc_id", fp.alias("fingerprint"), (I.is_sha256(F.concat(F.md5("text"), F.md5("text"))) & (F.col("n_chars") > 0)).alias("valid"))
