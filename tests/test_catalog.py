import hashlib

import pytest

from chorale.plans.catalog import Catalog, ContactQuery, Context, QueryError, VoiceQuery, eligible_fingerprint
from chorale.schemas import UnsupportedSchema, require_schema, schema

TABLE = "Msg_8e2d788ee4868fd1dcab95e1044c446b"
T0 = 1700000000


def message(shard, local, server, sender, time, origin=2, kind=34):
    return (shard, "wxid_peer", TABLE, local, server, kind, local, sender, time, 3, 0, 0, 0, origin, None, None, None, None, 0, 0)


FIRST = [message(0, 10, 100, 2, T0), message(0, 11, 101, 1, T0 + 60, 5), message(0, 12, 102, 2, T0 + 120), message(0, 13, 103, 2, T0 + 180, kind=1), message(0, 14, 104, 2, T0 + 240), message(0, 15, 105, 2, T0 + 300)]
SECOND = [message(1, 20, 200, 2, T0 + 30), message(1, 21, 201, 2, T0 + 80), message(1, 22, 202, 2, T0 + 140)]
MEDIA = [(1, 1, T0, 10, 100, b"#!SILK_V3\n", "0"), (2, 1, T0 + 60, 11, 101, b"#!SILK_V3\nout", "0"), (3, 1, T0 + 120, 12, 999, b"#!SILK_V3\nwrong", "0"), (4, 1, T0 + 240, 14, 104, b"", "0"), (5, 1, T0 + 300, 15, 105, b"not-silk", "0")]


def person(i, name, alias, remark, nick, encrypt=None):
    row = [i, name, 0, alias, encrypt, 0, 0, 0, remark, None, None, nick, None, None, None, None, None, 0, 0, None, None, 0]
    return tuple(row)


def catalog(spark, messages=FIRST, media=MEDIA, account="wxid_owner", names=(), contacts=(), context=Context("family", "acct", "d", "a", "1", "s", "db", ("f",))):
    people = [person(1, "wxid_owner", "owner_alias", "", "Owner"), person(2, "wxid_peer", "peer_alias", "Peer Remark", "Peer Nick"), person(3, "room@ChatRoom", "", "Remark", ""), *contacts]
    dictionary = [(s, i, n, 1) for s in (0, 1) for i, n in ((1, "wxid_owner"), (2, "wxid_peer"))] + list(names)
    frame = lambda rows, name: spark.createDataFrame(rows, schema(name))
    return Catalog(frame(people, "contact"), frame(dictionary, "message_names"), frame(messages, "messages"), frame([(1, "wxid_peer")], "media_names"), frame(media, "voice_info"), account, context)


def incoming(**more):
    return VoiceQuery("wxid_peer", "incoming", **more)


def states(df):
    return {r["local_id"]: r["payload_state"] for r in df.collect()}


def test_incoming_states_and_keys(spark):
    rows = {r["local_id"]: r for r in catalog(spark).voices(incoming()).collect()}
    assert {k: r["payload_state"] for k, r in rows.items()} == {10: "Linked", 12: "Missing", 14: "Empty", 15: "InvalidHeader"}
    assert rows[10]["payload_length"] == 10 and rows[10]["speaker_id"] == "wxid_peer" and rows[10]["message_id"] == "0:10:100"
    assert rows[12]["payload_locator"] is None and rows[12]["source_stable_key"] is None
    assert rows[14]["payload_locator"] is None and rows[14]["source_stable_key"] is not None
    assert rows[10]["payload_sha256"] is None


def test_deep_scan_has_hash(spark):
    rows = {r["local_id"]: r for r in catalog(spark).voices(incoming(deep=True)).collect()}
    assert rows[10]["payload_sha256"] == hashlib.sha256(b"#!SILK_V3\n").hexdigest()


def test_scan_report(spark):
    _, report = catalog(spark).scan(incoming())
    r = report.first()
    assert (r["matched"], r["missing"], r["empty"], r["invalidheader"], r["linked"], r["exportable"], r["payload_bytes"]) == (4, 1, 1, 1, 1, 1, 10)


def test_outgoing(spark):
    (r,) = catalog(spark).voices(VoiceQuery("wxid_peer", "outgoing")).collect()
    assert (r["local_id"], r["payload_state"], r["speaker_id"], r["create_time"]) == (11, "Linked", "wxid_owner", T0 + 60)


def test_contacts(spark):
    c = catalog(spark)
    assert c.resolve("wxid_peer")["display_name"] == "Peer Remark"
    assert [r["alias"] for r in c.contacts(ContactQuery(search="rEmArK")).collect()] == ["peer_alias"]
    assert [r["username"] for r in c.contacts(ContactQuery(limit=1)).collect()] == ["wxid_owner"]
    with pytest.raises(QueryError, match="ContactNotFound"):
        c.resolve("nobody")


def test_size_before_limit(spark):
    c = catalog(spark, [*FIRST, message(0, 16, 106, 2, T0 + 360)], [*MEDIA, (6, 1, T0 + 360, 16, 106, b"#!SILK_V3\nabc", "0")])
    assert states(c.voices(incoming(limit=1, least_bytes=11, most_bytes=13))) == {16: "Linked"}


def test_own_message_with_incoming_origin(spark):
    extra = [*FIRST, message(0, 16, 106, 1, T0 + 360)]
    assert sorted(states(catalog(spark, extra).voices(incoming()))) == [10, 12, 14, 15]
    with pytest.raises(QueryError, match="GroupChatNotSupported"):
        catalog(spark, extra).voices(VoiceQuery("wxid_peer"))


def test_no_account_is_refused(spark):
    with pytest.raises(QueryError):
        catalog(spark, account=None).voices(incoming())


def test_evidence(spark):
    assert catalog(spark).evidence() == "Candidate"
    assert catalog(spark, contacts=[person(9, "wxid_me", "", "", "", "wxid_me")], account="wxid_me").evidence() == "Confirmed"


def test_shards_merge_in_order_with_limit(spark):
    rows = catalog(spark, FIRST + SECOND).voices(incoming(limit=3)).collect()
    assert [(r["create_time"] - T0, r["shard_number"]) for r in rows] == [(0, 0), (30, 1), (80, 1)]


def test_late_foreign_speaker_yields_nothing(spark):
    foreign = [message(1, 20, 200, 3, T0 + 30), *SECOND[1:]]
    with pytest.raises(QueryError, match="GroupChatNotSupported"):
        catalog(spark, FIRST + foreign, names=[(1, 3, "wxid_other", 1)]).voices(incoming())


def test_ambiguous_counts_as_length_zero(spark):
    c = catalog(spark, media=[*MEDIA, (7, 1, T0, 10, 100, b"#!SILK_V3\nagain", "1")])
    assert states(c.voices(incoming()))[10] == "Ambiguous"
    assert 10 not in states(c.voices(incoming(least_bytes=1)))
    assert states(c.voices(incoming(most_bytes=100)))[10] == "Ambiguous"


def test_limit_counts_exportable_only(spark):
    records, report = catalog(spark, FIRST + [message(0, 16, 106, 2, T0 + 360)], [*MEDIA, (6, 1, T0 + 360, 16, 106, b"#!SILK_V3\nabc", "0")]).scan(incoming(limit=2))
    r = report.first()
    assert (r["matched"], r["exportable"], r["payload_bytes"]) == (5, 2, 23)
    assert len(eligible_fingerprint(records)) == 64


def test_durations(spark):
    durations = spark.createDataFrame([("0:10:100", 1500)], "message_id string, duration_ms long")
    _, report = catalog(spark).scan(incoming(), durations)
    r = report.first()
    assert (r["known_duration"], r["total_duration"], r["unknown_duration"]) == (1, 1500, 3)
    records, _ = catalog(spark).scan(incoming(least_ms=1000), durations)
    assert [x["local_id"] for x in records.collect()] == [10]


def test_absent_conversation_is_empty(spark):
    assert catalog(spark).voices(VoiceQuery("wxid_nobody", "incoming")).count() == 0


def test_payload_lookup(spark):
    c = catalog(spark)
    assert c.payload({"logical_role": "Media", "blob_key": "5"}) == b"not-silk"
    for role, shard, key in (("media", None, "0"), ("media", None, "-5"), ("media", None, "5 "), ("media", 0, "5"), ("message", None, "5"), (None, None, "5"), ("media", None, None), ("media", None, "9" * 19)):
        with pytest.raises(QueryError, match="InvalidRequest"):
            c.payload({"logical_role": role, "shard_number": shard, "blob_key": key})
    with pytest.raises(QueryError, match="PayloadNotFound"):
        c.payload({"logical_role": "media", "blob_key": "99"})
    (linked,) = [r for r in c.voices(incoming()).collect() if r["payload_state"] == "Linked"]
    assert c.payload(linked["payload_locator"].asDict()) == b"#!SILK_V3\n"


def test_payload_lookup_reads_one_range_of_the_file(spark, tmp_path):
    import sqlite3

    from chorale.sources import sqlite

    db = sqlite3.connect(tmp_path / "media_0.db")
    db.execute("CREATE TABLE VoiceInfo (chat_name_id INTEGER, create_time INTEGER, local_id INTEGER, svr_id INTEGER, voice_data BLOB, data_index TEXT)")
    db.executemany("INSERT INTO VoiceInfo (rowid, chat_name_id, create_time, local_id, svr_id, voice_data, data_index) VALUES (?, ?, ?, ?, ?, ?, ?)", MEDIA)
    db.commit()
    db.close()
    info = sqlite.read_sqlite(spark, str(tmp_path / "media_0.db"), "voice_info", "VoiceInfo", rowid="row_id", rows=2)
    c = catalog(spark)
    own = Catalog(*[c.tables[n] for n in ("contact", "message_names", "messages", "media_names")], info, "wxid_owner", c.context, media_shard=0)
    assert own.payload({"logical_role": "media", "shard_number": 0, "blob_key": "5"}) == b"not-silk"
    with pytest.raises(QueryError):
        own.payload({"logical_role": "media", "shard_number": 1, "blob_key": "5"})
    assert states(own.voices(incoming())) == states(c.voices(incoming())) and info.rdd.getNumPartitions() == 3
    assert info.where("row_id = 5").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("bad", [dict(limit=0), dict(first=5, last=4), dict(least_bytes=-1), dict(least_ms=5, most_ms=4), dict(direction="sideways")])
def test_validation(bad):
    with pytest.raises(QueryError):
        VoiceQuery("wxid_peer", **bad)


def test_schema_contract(spark):
    wrong = spark.createDataFrame([(1, "a")], "row_id int, user_name string")
    with pytest.raises(UnsupportedSchema):
        require_schema(wrong, "media_names")


def test_scans_read_heads_not_payloads(spark, tmp_path):
    from chorale.sources import files

    frame = lambda rows, name: spark.createDataFrame(rows, schema(name))
    files.land({"voice_info": frame(MEDIA, "voice_info")}, str(tmp_path))
    info, heads = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("voice_info", "voice_heads"))
    c = catalog(spark)
    landed = Catalog(*[c.tables[n] for n in ("contact", "message_names", "messages", "media_names")], info, "wxid_owner", c.context, heads)
    for query in (incoming(), incoming(deep=True)):
        records, report = landed.scan(query)
        plans = records._jdf.queryExecution().toString() + report._jdf.queryExecution().toString()
        assert "voice_data" not in plans and "payload_prefix" in plans
        expected, _ = c.scan(query)
        assert sorted(map(tuple, records.collect())) == sorted(map(tuple, expected.collect()))
    assert landed.payload({"logical_role": "media", "blob_key": "5"}) == b"not-silk"


def test_incomplete_provenance_rejects(spark):
    records, report = catalog(spark, context=Context("family", "acct")).scan(incoming())
    assert {r["local_id"]: r["reason_code"] for r in records.collect()}[10] == "provenance" and report.first()["exportable"] == 0


def test_each_direction_has_its_speaker(spark):
    both, _ = catalog(spark).scan(VoiceQuery("wxid_peer", "outgoing"))
    assert [(r["speaker_id"], r["reason_code"]) for r in both.collect()] == [("wxid_owner", None)]
