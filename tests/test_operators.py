import hmac
import json
import sqlite3
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chorale.functions import identity as I
from chorale.functions import pcm
from chorale.operators import curation, manifest, retention, segments, selection
from chorale.sources import caches, files, sqlite
from chorale.streaming import journal


def test_identities(spark):
    df = spark.createDataFrame([("a", None, 5), ("a", " ", 5), ("ä", "b", 6)], "x string, y string, n int")
    rows = df.select(I.stable_key(F.col("x"), F.col("y"), F.col("n")).alias("k"), I.message_id(F.lit(None).cast("int"), F.col("n"), F.col("n")).alias("m"), I.fold_ascii(F.lit("ÄB")).alias("f"), I.message_table(F.lit("wxid_peer")).alias("t")).collect()
    assert [r["k"] for r in rows] == [None, None, "ä|b|6"] and rows[0]["m"] == ":5:5" and rows[0]["f"] == "Äb"
    assert rows[0]["t"] == "Msg_8e2d788ee4868fd1dcab95e1044c446b"
    key = b"sixteen bytes or"
    (got,) = df.limit(1).select(I.item_id(F.lit("k"), key).alias("i")).collect()
    assert got["i"] == hmac.new(key, b"k", sha256).hexdigest()
    with pytest.raises(ValueError):
        I.item_id(F.lit("k"), b"short")
    assert I.fields_fingerprint([("a", "b:"), ("c", None)]) != I.fields_fingerprint([("a", "b"), (":c", None)])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.booleans(), max_size=30), st.integers(1, 6))
def test_until_eligible(spark, flags, n):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "i int, ok boolean")
    seen, found = [], 0
    for i, f in enumerate(flags):
        if found == n:
            break
        seen.append(i)
        found += f
    assert sorted(r["i"] for r in selection.until_eligible(df, ["i"], F.col("ok"), n).collect()) == seen


def greedy(frames, least, most, target):
    if frames < least:
        return [(0, frames, "shorter-than-one-second")]
    out, at = [], 0
    while at < frames:
        length = min(target, frames - at)
        if 0 < frames - at - length < least:
            length = frames - at
        out.append((at, length, "kept" if length <= most else "segment-out-of-range"))
        at += length
    return out


def test_segments_equal_the_greedy_cut(spark):
    for least, target, most in ((1, 10, 30), (4, 9, 11), (5, 5, 9)):
        items = spark.range(0, 60).select(F.col("id").alias("frames"))
        got: dict = {}
        for r in segments.plan_segments(items, F.col("frames"), least, most, target).orderBy("frames", "segment").collect():
            got.setdefault(r["frames"], []).append((r["start"], r["length"], r["outcome"]))
        assert got == {f: greedy(f, least, most, target) for f in range(60)}


def test_segment_totals_and_weights(spark):
    items = spark.createDataFrame([(4800,), (35 * 48000,)], "frames long")
    r = segments.segment_totals(segments.plan_segments(items, F.col("frames"), 48000, 30 * 48000, 10 * 48000), 2 * F.col("length")).first()
    assert (r["kept"], r["rejected"]) == (4, 1)
    one = spark.createDataFrame([(48000, 1), (48000, 2)], "frames long, w int")
    assert segments.plan_segments(one, F.col("frames"), 48000, 30 * 48000, 480000, F.col("w")).count() == 3


def wav(samples, rate=24000):
    return pcm.wav_bytes(np.asarray(samples), rate)


I24 = np.arange(24000)


@pytest.mark.parametrize("samples, expected, has, lacks", [
    (np.sin(I24 / 20) * 8000, None, [], ["quality-silent", "quality-clipping", "quality-empty-audio"]),
    (np.where(I24 % 2, 1, -1), None, ["quality-silent"], []),
    (np.full(24000, -32768), None, ["quality-clipping"], []),
    (np.full(24000, 32767), None, [], ["quality-clipping"]),
    (np.sin(I24 / 20) * 10, None, ["quality-low-level"], []),
    (np.sin(I24 / 20) * 8000, 10_000, ["quality-duration-mismatch"], []),
])
def test_pcm(samples, expected, has, lacks):
    m = pcm.analyze(wav(samples), expected)
    assert m["decoded"] and m["duration_ms"] == 1000 and set(has) <= set(m["flags"]) and not set(lacks) & set(m["flags"])


def test_pcm_defects_stereo_and_spark(spark):
    for bad in (b"text", None, wav(np.zeros(0))):
        assert pcm.analyze(bad)["flags"] == ["quality-decode-failed"]
    body = np.stack([np.sin(I24 / 20) * 8000, np.zeros(24000)], axis=1).astype("<i2").tobytes()
    head = bytearray(wav(np.zeros(1))[:44])
    head[22:24], head[28:32], head[32:34], head[40:44] = (2).to_bytes(2, "little"), (96000).to_bytes(4, "little"), (4).to_bytes(2, "little"), len(body).to_bytes(4, "little")
    stereo = pcm.analyze(bytes(head) + body)
    assert stereo["channels"] == 2 and "quality-silent" not in stereo["flags"]
    assert pcm.mono(np.array([[1, 2], [-1, -2]]) / 32768, 16).tolist() == [1, -1]
    df = spark.createDataFrame([(bytearray(wav(np.sin(I24 / 20) * 8000)),), (bytearray(b"x"),)], "wav binary")
    assert [r[0] for r in df.select(pcm.wav_duration_ms(F.col("wav"))).collect()] == [1000, None]


def test_curation(spark):
    rows = [("one", "a" * 64, 100, 3, "incoming", True), ("two", "A" * 64, None, 4, "incoming", False), ("three", "b" * 64, 200, 5, "outgoing", False)]
    df = spark.createDataFrame(rows, "id string, sha string, ms long, bytes long, direction string, selected boolean")
    (g,) = curation.duplicate_groups(df, "sha", "id", F.col("selected")).collect()
    assert (g["size"], g["representative"]) == (2, "one")
    assert curation.several_selected(curation.duplicate_groups(df, "sha", "id", F.lit(True))).count() == 1
    flags = F.array(F.lit("Quality-Silent"))
    passes = curation.passes_filters(F.col("ms"), F.col("bytes"), flags, F.lit(False), F.col("direction"), 0, 10**6, [], ["incoming"], False)
    got = {r["id"]: r["e"] for r in df.select("id", curation.eligibility(passes, F.col("ms")).alias("e")).collect()}
    assert got == {"one": "Eligible", "two": "Rejected", "three": "Rejected"}
    shown = curation.passes_filters(F.col("ms"), F.col("bytes"), flags, F.lit(False), F.col("direction"), 0, 10**6, [], ["incoming"], True)
    assert {r["id"]: r["e"] for r in df.select("id", curation.eligibility(shown, F.col("ms")).alias("e")).collect()}["two"] == "Unknown"
    out = curation.passes_filters(F.col("ms"), F.col("bytes"), flags, F.lit(False), F.col("direction"), 0, 10**6, ["quality-silent"], ["incoming"], True)
    assert df.where(out).count() == 0


def test_keep_recent_keeps_ties(spark):
    rows = [(i, 10 - i // 2, True, i == 9) for i in range(10)] + [(20, 0, False, False)]
    df = spark.createDataFrame(rows, "run int, created int, complete boolean, referenced boolean").withColumn("p", F.lit(0))
    got = {r["run"]: r["disposition"] for r in retention.keep_recent(df, ["p"], "created", "complete", "referenced", 3).collect()}
    assert [k for k, v in got.items() if v == "KeepRecent"] == [0, 1, 2, 3, 20] or set(k for k, v in got.items() if v == "KeepRecent") == {0, 1, 2, 3, 20}
    assert got[9] == "Referenced" and got[5] == "Compactable"


def test_csv(spark, tmp_path):
    fields = ["=1", 'a"b', "x,y", "plain", "", None, "-1"]
    df = spark.createDataFrame([(f,) for f in fields], "f string")
    assert [r[0] for r in df.select(manifest.csv_field(F.col("f"))).collect()] == ["'=1", '"a""b"', '"x,y"', "plain", "", "", "'-1"]
    rows = manifest.portable_rows(df.where("f is not null").limit(2), F.col("f"), F.lit("p"), F.lit("h"), F.lit(None).cast("long"), F.lit(3).cast("long"), F.array(F.lit("a"), F.lit("b")), F.lit("Eligible"), F.lit(True))
    manifest.write_portable_csv(rows, str(tmp_path / "csv"))
    back = files.read_portable_csv(spark, str(tmp_path / "csv")).collect()
    assert {r["item_id"] for r in back} == {"'=1", 'a"b'} and back[0]["quality_flags"] == "a|b" and back[0]["selected"] == "True" and back[0]["duration_ms"] is None


def lines(*events, run="r"):
    return [json.dumps({"event": e, "run_id": run, "occurred_at_utc": f"2024-01-01T00:00:0{i}", "transaction_key": f"k{i}"}) for i, e in enumerate(events)]


@pytest.mark.parametrize("events, expected", [
    (("run-started", "item-committed", "item-committed", "item-failed", "processing-completed"), (2, 1, "CompletedWithFailures")),
    (("run-started", "item-committed", "item-committed", "processing-completed"), (2, 0, "Completed")),
    (("run-started", "processing-completed", "item-failed"), (0, 1, "Completed")),
    (("run-started", "item-committed", "processing-completed", "run-cancelled"), (1, 0, "Cancelled")),
])
@pytest.mark.parametrize("torn", ["", '{"event": "item-comm'])
def test_journal(spark, tmp_path, events, expected, torn):
    (tmp_path / "j.jsonl").write_text("\n".join(lines(*events)) + "\n" + torn)
    r = manifest.journal_status(files.read_journal(spark, str(tmp_path / "j.jsonl"), "r"), "run_id", "line_no", "event").first()
    assert (r["entries"], r["failures"], r["status"]) == expected


def test_journal_errors(spark, tmp_path):
    for i, text in enumerate((["{bad", *lines("run-started")], lines("run-started", run="other"))):
        (tmp_path / f"{i}.jsonl").write_text("\n".join(text) + "\n")
        with pytest.raises(files.JournalError):
            files.read_journal(spark, str(tmp_path / f"{i}.jsonl"), "r")


def test_sqlite_and_listing(spark, tmp_path):
    path = tmp_path / "message_0.db"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE Name2Id (user_name TEXT, is_session INTEGER)")
    db.execute(f"CREATE TABLE Msg_{'a' * 32} (local_id INTEGER PRIMARY KEY)")
    db.execute("INSERT INTO Name2Id VALUES ('wxid_owner', 1), ('wxid_peer', 1)")
    db.commit()
    db.close()
    got = sqlite.read_sqlite(spark, str(path), "message_names", "Name2Id", {"shard_number": "0"}, rowid="row_id").collect()
    assert [(r["row_id"], r["user_name"]) for r in got] == [(1, "wxid_owner"), (2, "wxid_peer")]
    assert sqlite.conversation_tables(str(path)) == [f"Msg_{'a' * 32}"]
    assert [o["name"] for o in sqlite.sqlite_schema(str(path))] == [f"Msg_{'a' * 32}", "Name2Id"]
    (r,) = files.database_files(spark, str(tmp_path)).collect()
    assert (r["role"], r["shard"]) == ("message", 0)
    same = files.list_files(spark, str(tmp_path))
    assert files.inventory_changes(same, same).count() == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([*lines("item-committed", "item-failed"), *lines("item-committed")]) + "\n")
    found = journal.follow(spark, str(tmp_path / "in"))
    q = found.writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["event"] for r in spark.table("followed").collect()) == ["item-committed", "item-failed"]


def test_stream_counts_every_failure(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = lambda kind, second, **more: json.dumps({"event": kind, "run_id": "r", "occurred_at_utc": f"2024-01-01T00:00:{second:02}Z"} | more)
    fail = lambda second, item: event("item-failed", second, message_id=item, failure={"message_id": item, "stage": "decode", "error": "decode"})
    commit = event("item-committed", 4, transaction_key="k")
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([fail(1, "m1"), fail(2, "m2"), fail(2, "m2"), commit, commit]) + "\n")
    (tmp_path / "in" / "b.jsonl").write_text(json.dumps({"event": "run-started", "run_id": "s", "occurred_at_utc": "2024-01-01T02:00:00Z"}) + "\n")
    found = journal.failures_by_window(journal.follow(spark, str(tmp_path / "in")))
    q = found.writeStream.format("memory").queryName("failed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["run_id"], r["committed"], r["failed"]) for r in spark.table("failed").collect()] == [("r", 1, 3)]


def test_stream_keeps_the_states_of_a_replay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = lambda kind, run, second, **more: json.dumps({"event": kind, "run_id": run, "occurred_at_utc": f"2024-01-01T00:00:{second:02}Z"} | more)
    item, failed = {"entry": "{}"}, {"failure": {"message_id": "m", "stage": "s", "error": "e"}}
    parts = [[event("item-committed", "r", 1, **item), event("processing-completed", "r", 3), event("item-failed", "s", 1, **failed)], [event("item-failed", "r", 4, **failed), event("item-committed", "r", 5), event("processing-completed", "s", 9)], [event("run-cancelled", "t", 2)]]
    states = journal.run_states(journal.follow(spark, str(tmp_path / "in")))
    q = states.writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    for i, part in enumerate(parts):
        (tmp_path / "in" / f"{i}.jsonl").write_text("\n".join(part) + "\n")
        q.processAllAvailable()
    q.stop()
    got = {r["run_id"]: (r["entries"], r["failures"], r["status"]) for r in manifest.judge_states(spark.table("states"), "run_id", "Failed").collect()}
    assert got == {"r": (1, 1, "Completed"), "s": (0, 1, "CompletedWithFailures"), "t": (0, 0, "Cancelled")}


def test_a_bad_last_line_with_a_line_end_is_corruption(spark, tmp_path):
    good = "\n".join(lines("run-started", "item-committed"))
    for i, (text, torn) in enumerate(((good + '\n{"event": "it', True), (good + '\n{"event": "it\n', False), (good + '\n{"event": "it\n\n', False), ("{x\n" + good + '\n{"event": "it', False), (good.replace("\n", "\r\n") + "\r\n{", True))):
        path = tmp_path / f"{i}.jsonl"
        path.write_bytes(text.encode())
        if torn:
            found = files.read_journal(spark, str(path), "r").orderBy("line_no").collect()
            assert [r["event"] for r in found] == ["run-started", "item-committed"]
        else:
            with pytest.raises(files.JournalError):
                files.read_journal(spark, str(path), "r")


def test_journal_lines_keep_their_order_over_many_tasks(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text("\n".join(json.dumps({"event": "note", "run_id": "r", "message_id": str(i)}) for i in range(3000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = files.read_journal(spark, str(tmp_path / "j.jsonl"), "r")
        assert found.rdd.getNumPartitions() > 3
        assert [r["message_id"] for r in found.orderBy("line_no").collect()] == [str(i) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_wav_sizes_beyond_the_file_and_torn_frames():
    whole = wav(np.sin(I24 / 20) * 8000)
    assert pcm.read_wav(whole[:-10]) is None
    longer = bytearray(whole)
    longer[40:44] = (len(whole)).to_bytes(4, "little")
    assert pcm.read_wav(bytes(longer)) is None
    odd = bytearray(whole) + b"\x01\x00"
    odd[40:44], odd[4:8] = (len(whole) - 44 + 1).to_bytes(4, "little"), (len(odd) - 8).to_bytes(4, "little")
    assert len(pcm.read_wav(bytes(odd))[3]) == 24000


def test_flags_keep_their_first_spelling(spark):
    merged = curation.merged_flags(F.array(F.lit("b-Flag"), F.lit(" "), F.lit("A")), F.array(F.lit("B-FLAG"), F.lit("a"), F.lit("c")))
    assert spark.range(1).select(merged).first()[0] == ["A", "b-Flag", "c"]


def test_byte_bounds_of_the_curation_filter(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "n long")
    inside = curation.passes_filters(F.lit(1), F.col("n"), F.array(F.lit("x")), F.lit(False), F.lit("incoming"), 0, 9, [], ["incoming"], True, 2, 8)
    assert [r["n"] for r in df.where(inside).collect()] == [5]


def test_scan_cache(spark, tmp_path):
    from chorale.sources import caches

    root, fp = str(tmp_path), "a" * 64
    records = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "id long, name string")
    report = spark.createDataFrame([(3,)], "matched long")
    assert caches.read_scan(spark, root, "ws", fp) is None
    caches.write_scan(root, "ws", fp, records, report)
    found, told = caches.read_scan(spark, root, "ws", fp)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, records.collect()), key=repr) and told.first()[0] == 3
    assert caches.read_scan(spark, root, "other", fp) is None and caches.read_scan(spark, root, "ws", "b" * 64) is None
    records.limit(2).write.mode("overwrite").parquet(f"{root}/workspace=ws/query={fp}/records")  # not what the manifest says
    assert caches.read_scan(spark, root, "ws", fp) is None
    caches.write_scan(root, "ws", fp, records, report)
    assert caches.read_scan(spark, root, "ws", fp) is not None
    for part in (tmp_path / "workspace=ws" / f"query={fp}" / "records").glob("*.parquet"):
        part.write_bytes(b"torn")
    assert caches.read_scan(spark, root, "ws", fp) is None
    for bad in (("../ws", fp), ("ws", "short"), ("", fp)):
        with pytest.raises(ValueError):
            caches.read_scan(spark, root, *bad)


def test_cache_compaction_and_spool(spark, tmp_path):
    from chorale.sources import caches

    df = spark.createDataFrame([(8 << 20, 1, 1, False), (1, 300, 100, False), (1, 300, 200, False), (1, 1, 100_001, False), (1, 1, 1, True), (1, 1, 1, False)], "b long, l long, u long, m boolean")
    assert [r[0] for r in df.select(caches.should_compact(*[F.col(c) for c in "blum"])).collect()] == [True, True, False, True, True, False]
    rows = spark.createDataFrame([("k", 1, 5, 10), ("k", 2, 6, 11), ("j", 3, 0, 12)], "k string, line int, v int, at int")
    assert [(r["k"], r["v"]) for r in caches.compact(rows, ["k"], "line", "at", F.col("v") > 0).collect()] == [("k", 6)]
    rows.write.json(str(tmp_path / "spool"))
    ddl = "k string, line int, v int, at int"
    n, digest = caches.digest(spark.read.schema(ddl).json(str(tmp_path / "spool"))).first()
    assert caches.read_spool(spark, str(tmp_path / "spool"), ddl, n, digest).count() == 3
    with pytest.raises(ValueError):
        caches.read_spool(spark, str(tmp_path / "spool"), ddl, n, "other")


def test_sqlite_is_landed_in_ranges(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "media_1.db")
    db.execute("CREATE TABLE n (user_name TEXT, other INTEGER REFERENCES o (x))")
    db.execute("CREATE INDEX i ON n (user_name, other)")
    db.execute("CREATE TRIGGER t AFTER INSERT ON n BEGIN SELECT 1; END")
    db.executemany("INSERT INTO n (user_name) VALUES (?)", [(f"u{i}",) for i in range(25)])
    db.commit()
    db.close()
    landed = sqlite.read_sqlite(spark, str(tmp_path / "media_1.db"), "media_names", "n", rowid="row_id", rows=10)
    assert landed.rdd.getNumPartitions() == 3
    files.land({"media_names": landed}, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "media_names.parquet")).collect()) == sorted((i + 1, f"u{i}") for i in range(25))
    (table,) = sqlite.sqlite_schema(str(tmp_path / "media_1.db"))
    assert table["indexes"] == [{"name": "i", "unique": False, "columns": ["user_name", "other"]}] and table["triggers"] == ["t"] and table["foreign_keys"][0]["table"] == "o"
    assert sqlite.sqlite_pragmas(str(tmp_path / "media_1.db"))["encoding"] == "UTF-8"


def test_duplicate_representative_needs_no_list(spark):
    df = spark.createDataFrame([("a", i, i == 7) for i in range(50)], "sha string, id int, chosen boolean")
    (g,) = curation.duplicate_groups(df, "sha", "id", F.col("chosen")).collect()
    assert (g["size"], g["representative"]) == (50, 7)


def test_dataset_metadata(spark):
    from chorale.operators import dataset

    rows = [("b", "audio/b.wav", "h", 5, 10, "x", "Eligible", "False", True), ("a", "audio/a.wav", "g", None, 20, "x", "Eligible", "False", True), ("c", "p", "i", 9, 9, "x", "Rejected", "False", False)]
    items = spark.createDataFrame(rows, "item_id string, relative_audio_path string, sha256 string, duration_ms long, byte_length long, quality_flags string, training_eligibility string, selected string, keep boolean")
    built = dataset.build_items(items, F.col("keep"), F.array(F.lit("A"), F.lit("b")))
    assert tuple(dataset.build_summary(built).first()) == (2, 5, 30) and {(r["quality_flags"], r["selected"]) for r in built.collect()} == {("A|b", "True")}
    assert dataset.reusable(dataset.item_issues(built, built, built.select("item_id"), built.select(F.col("relative_audio_path").alias("path"), "sha256", F.col("byte_length").alias("bytes")))).first()["reusable"]


def selected(spark, ids, more=(), **fields):
    from chorale.operators import dataset

    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    return dataset.selection_fingerprint(dataset.Selection(**{"manifest_sha256": "AB", "profile_version": "p"} | fields), frame(ids), "id", frame(more) if more else None).first()


def test_selection_fingerprint_binds_its_fields(spark):
    one = selected(spark, ["A", " b"])
    assert one == selected(spark, ["b", "a", "B", " ", None], manifest_sha256="ab") and one["n"] == 14
    others = [selected(spark, ["a", "b"], **more) for more in ({"manifest_sha256": "ac"}, {"profile_version": "q"}, {"least_ms": 0}, {"most_ms": 0}, {"least_bytes": 0}, {"most_bytes": 0}, {"unknown_duration": True}, {"incoming_only": True}, {"excluded_flags": ("x",)}, {"excluded_flags": ("x", "y")}, {"excluded_flags": ("y", "x")})]
    others += [selected(spark, ["a"]), selected(spark, ["a", "b"], ["a"]), selected(spark, ["a"], ["b"]), selected(spark, [])]
    assert len({r["fingerprint"] for r in [one, *others]}) == len(others) + 1
    with pytest.raises(ValueError):
        selected(spark, ["a"], manifest_sha256=" ")


def brute_tree(lines, per):
    for _ in range(2):
        lines = [sha256("".join(lines[i : i + per]).encode()).hexdigest() + "\n" for i in range(0, len(lines), per)]
    return sha256("".join(lines).encode()).hexdigest()


def test_digest_tree(spark):
    from chorale.operators import order

    rows = [(k, i, f"{k}{i}") for k, n in (("a", 700), ("b", 1), (None, 30), ("c", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v string").repartition(7)
    got = {r["k"]: (r["fingerprint"], r["n"]) for r in order.ordered_digest(df, ["k"], [F.col("i")], F.col("v"), per=3).collect()}
    assert got == {k: (brute_tree([v for key, _, v in rows if key == k], 3), n) for k, n in (("a", 700), ("b", 1), (None, 30), ("c", 9))}
    (whole,) = order.ordered_digest(df.where("k = 'a'"), [], [F.col("i")], F.col("v"), per=5).collect()
    assert whole["fingerprint"] == brute_tree([v for key, _, v in rows if key == "a"], 5)
    assert order.ordered_digest(df.where("false"), [], [F.col("i")], F.col("v")).count() == 0


def test_numbers_follow_the_order_without_one_task(spark):
    from chorale.operators import order

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        got = order.numbered(df, [F.col("x").desc()], "at")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString() and got.rdd.getNumPartitions() > 1
    assert got.where("at <> 4999 - x").count() == 0 and got.count() == 5000
    digest = order.ordered_digest(df, [], [F.col("x")], F.col("x").cast("string"))
    assert "SinglePartition" not in digest._jdf.queryExecution().executedPlan().toString() and "Window" not in digest._jdf.queryExecution().executedPlan().toString()


def test_journal_states_merge(spark):
    events = ["run-started", "item-committed", "processing-completed", "item-failed", "note", "item-skipped", "processing-completed", "manifest-committed", "item-failed", "run-cancelled", "note"]
    for cut in range(len(events) + 1):
        rows = [("r", i, e, f"c{i}" if e == "note" else None) for i, e in enumerate(events[:cut])]
        df = spark.createDataFrame(rows, "run string, line int, e string, context string")
        whole = manifest.journal_status(df, "run", "line", "e", context=F.col("context"), committed_at=F.col("line"), fallback="Failed")
        parts = [manifest.journal_states(df.where(F.col("line") % 3 == k), "run", "line", "e", context=F.col("context"), committed_at=F.col("line")) for k in range(3)]
        merged = manifest.judge_states(manifest.merge_states(parts[0].unionByName(parts[1]).unionByName(parts[2]), "run"), "run", "Failed")
        assert whole.collect() == merged.collect()
        last = [(i, e) for i, e in enumerate(events[:cut]) if e in ("processing-completed", "run-cancelled")]
        if rows:
            expected = "Failed" if not last else "Cancelled" if last[-1][1] == "run-cancelled" else "CompletedWithFailures" if "item-failed" in events[: last[-1][0]] else "Completed"
            assert whole.first()["status"] == expected
    assert "Window" not in whole._jdf.queryExecution().executedPlan().toString()


def test_project_states(spark):
    from chorale.operators import recovery

    rows = [
        ("busy", True, True, "a", "a", True, "Staging", False, "Busy", False), ("good", True, True, "a", "a", True, "Completed", False, "ValidReusable", False), ("any", True, True, "a", None, False, None, None, "ValidReusable", False),
        ("stale", True, True, "a", "b", True, "Completed", False, "Stale", False), ("broken", True, False, None, "a", True, "Completed", True, "Invalid", True), ("broken-alone", True, None, None, None, False, None, None, "Invalid", False),
        ("lost", False, None, None, None, True, "Completed", True, "Invalid", True), ("open", False, None, None, None, True, "DatabasesCommitted", True, "Recoverable", False), ("dead", None, None, None, None, True, None, None, "Invalid", False), ("none", False, None, None, None, False, "Staging", True, "Missing", False),
    ]
    df = spark.createDataFrame(rows, "n string, doc boolean, ok boolean, account string, wanted string, root boolean, state string, can boolean, expected string, repair boolean")
    told = df.select("n", "expected", "repair", recovery.project_state(*map(F.col, ("doc", "ok", "account", "wanted", "root", "state", "can"))).alias("p")).collect()
    assert all((r["p"]["state"], r["p"]["repairable"], r["p"]["reusable"]) == (r["expected"], r["repair"], r["expected"] == "ValidReusable") for r in told)


def test_links_are_never_what_was_expected(spark):
    from chorale.operators import recovery

    def told(final, staged, final_link=False, staged_link=False):
        pair = lambda x: (F.lit(1 if x else None).cast("long"), F.lit("h" if x else None).cast("string"))
        c = recovery.reconcile_artifact(F.lit("Staged"), F.lit("Missing"), F.lit("s"), F.lit("f"), (F.lit(1), F.lit("h")), pair(final), pair(staged), F.lit(final_link), F.lit(staged_link))
        return tuple(spark.range(1).select(c.alias("c")).first()["c"])

    assert told(True, False) == ("Committed", True, False) and told(True, False, final_link=True) == ("Failed", False, False)
    assert told(False, True) == ("Committed", True, True) and told(False, True, staged_link=True) == ("Failed", False, False) and told(False, True, final_link=True) == ("Failed", False, False)


def test_datasets_compare_flags_and_orders(spark):
    from chorale.operators import dataset

    rows = spark.createDataFrame([("A", "p", "h", 1, 2, "True"), ("b", "q", "g", 1, 2, "False")], "item_id string, relative_audio_path string, sha256 string, byte_length long, duration_ms long, selected string")
    audio = rows.select(F.col("relative_audio_path").alias("path"), "sha256", F.col("byte_length").alias("bytes"))
    assert [tuple(r) for r in dataset.item_issues(rows.drop("selected"), rows, rows.select("item_id"), audio).collect()] == [("b", "item-unselected")]
    order = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, at int")
    assert dataset.order_issues(order(["A", "b"]), order(["a", "B"]), "id", "at").count() == 0
    assert dataset.order_issues(order(["a", "b"]), order(["b", "a", "c"]), "id", "at").count() == 3


def test_caches_append_only_news(spark):
    stored = spark.createDataFrame([("k", 1, 0, True), ("k", 2, 1, True), ("k", 3, 2, False), ("m", 5, 3, True), (None, 7, 4, True)], "key string, value int, line int, ok boolean")
    new = spark.createDataFrame([("k", 2), ("m", 6), ("n", 1), (None, 7)], "key string, value int")
    assert sorted(tuple(r) for r in caches.to_append(stored, new, ["key"], "value", "line", F.col("ok")).collect()) == [("m", 6), ("n", 1)]


def test_registries_and_run_lists(spark):
    paths = spark.createDataFrame([("p", f"x{i}", i) for i in range(150)] + [("p", "X3", 500), ("q", "y", 1)], "part string, path string, at int")
    got = retention.registry(paths, ["part"], "path", "at").where("part = 'p'").collect()
    assert len(got) == 100 and {r["path"] for r in got} == {"X3"} | {f"x{i}" for i in range(51, 150)}
    runs = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1), ("d", None)], "run string, created int")
    assert [r["run"] for r in retention.run_list(runs, "created", "run").collect()] == ["d", "c", "a", "b"]


def test_item_ids_by_a_key_column(spark):
    keys = ["00" * 16, "ab" * 64, "cd" * 65, "EF" * 20, "00" * 15, "zz" * 16, None]
    df = spark.createDataFrame([(i, k, f"stabil-é-{i}") for i, k in enumerate(keys)], "i int, k string, s string")
    got = [r["id"] for r in df.select("i", I.item_id_by(F.col("s"), F.col("k")).alias("id")).orderBy("i").collect()]
    assert got == [hmac.new(bytes.fromhex(k), f"stabil-é-{i}".encode(), sha256).hexdigest() if i < 4 else None for i, k in enumerate(keys)]
