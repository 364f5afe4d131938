"""Enumeration with links, WAV heads, segments cut in one pass, CSV rows and documents in canonical form."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.functions import pcm
from chorale.operators import segments
from chorale.operators import verification as W
from chorale.operators.manifest import PORTABLE
from chorale.sources import files, walk


def test_walk_tells_links_and_does_not_follow(spark, tmp_path):
    for name in ("a/b/c/deep.db", "a/x.DB", "top.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    os.symlink(tmp_path / "a", tmp_path / "a" / "loop")
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling.db")
    os.link(tmp_path / "top.txt", tmp_path / "a" / "again.txt")
    (tmp_path / "empty").mkdir()
    for root in (str(tmp_path), f"file://{tmp_path}"):
        found = {r["path"]: r for r in walk.walk(spark, root).collect()}
        kinds = {k: r["kind"] for k, r in found.items()}
        assert kinds == {"a": "directory", "a/b": "directory", "a/b/c": "directory", "empty": "directory", "a/b/c/deep.db": "file", "a/x.DB": "file", "top.txt": "file", "a/again.txt": "file", "a/loop": "link", "dangling.db": "link"}
        assert found["top.txt"]["file_id"] == found["a/again.txt"]["file_id"] and found["top.txt"]["bytes"] == 7 and found["a/loop"]["is_link"]
    assert [(r["names"], r["first"]) for r in walk.shared_files(walk.walk(spark, root)).collect()] == [(2, "a/again.txt")]
    assert [r["path"] for r in files.database_files(spark, str(tmp_path)).collect()] == ["a/b/c/deep.db", "a/x.DB"]
    assert [r["kind"] for r in walk.walk(spark, str(tmp_path / "absent")).collect()] == ["unreadable"]


def chunk(name, body):
    return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)


def riff(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def form(kind=1, channels=1, rate=1000, align=2, bits=16, more=b""):
    return chunk(b"fmt ", b"".join(x.to_bytes(n, "little") for x, n in ((kind, 2), (channels, 2), (rate, 4), (rate * align, 4), (align, 2), (bits, 2))) + more)


@pytest.mark.parametrize("data, duration", [
    (riff(form(), chunk(b"data", bytes(2000))), 1000), (riff(form(), chunk(b"data", bytes(2000)), chunk(b"LIST", b"odd"), chunk(b"data", bytes(1001))), 1500),
    (riff(form(align=3, bits=16), chunk(b"data", bytes(3000))), 1000), (riff(chunk(b"data", bytes(8)), form(more=b"xx")), 4), (riff(form(kind=3), chunk(b"data", bytes(8))), None),
    (riff(form(align=0), chunk(b"data", bytes(8))), None), (riff(form(bits=12), chunk(b"data", bytes(8))), None), (riff(form()), None), (riff(chunk(b"data", bytes(8))), None), (riff(form(), chunk(b"data", b"")), None),
    (riff(form(), chunk(b"data", bytes(8)))[:-2], None), (riff(form(), b"data\xff\xff\xff\x7f"), None), (b"", None), (b"RIFFxxxxWAVX", None), (riff(form(), chunk(b"data", bytes(2000)), b"abc"), 1000),
])
def test_durations_by_chunks(data, duration):
    facts = pcm.header_facts(io.BytesIO(data), len(data))
    assert (facts and facts["duration_ms"]) == duration


def test_header_walk_reads_no_bodies(spark, tmp_path):
    read = []

    class Counting(io.BytesIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    data = riff(form(), chunk(b"junk", bytes(500_000)), chunk(b"data", bytes(2_000_000)), chunk(b"data", bytes(10)))
    assert pcm.header_facts(Counting(data), len(data))["data_bytes"] == 2_000_010 and sum(read) < 100 and min(read) > 0
    for i in range(3):
        (tmp_path / f"{i}.wav").write_bytes(data if i else b"x")
    got = {r["path"][-5:]: r["duration_ms"] for r in files.read_durations(spark, str(tmp_path)).collect()}
    assert got == {"0.wav": None, "1.wav": 1_000_005, "2.wav": 1_000_005}
    plan = files.read_durations(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    df = spark.createDataFrame([(bytearray(data),), (None,)], "wav binary")
    assert [r[0] for r in df.select(pcm.wav_duration_ms(F.col("wav"))).collect()] == [1_000_005, None]


def test_a_recording_is_decoded_once_for_all_its_segments(spark, monkeypatch):
    sound = pcm.wav_bytes(np.arange(2500) % 100, 1000)
    rows = [(1, bytearray(sound)), (2, bytearray(b"bad")), (3, None)]
    recordings = spark.createDataFrame(rows, "item int, wav binary")
    facts = recordings.withColumn("frames", F.coalesce(pcm.wav_facts(F.col("wav"))["frames"], F.lit(2000)))
    got = pcm.cut_segments(facts, "wav", segments.segment_plan(F.col("frames"), 300, 1200, 1000))
    assert got.columns == ["item", "frames", "segment", "segment_wav"]
    cut = {(r["item"], r["segment"]): r["segment_wav"] for r in got.collect()}
    assert set(cut) == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (3, 1)} and cut[2, 0] is None is cut[3, 1]
    assert [len(pcm.read_wav(bytes(cut[1, i]))[3]) for i in range(3)] == [1000, 1000, 500]
    assert b"".join(bytes(cut[1, i])[44:] for i in range(3)) == sound[44:]
    calls, plain = [], pcm.read_wav
    monkeypatch.setattr(pcm, "read_wav", lambda data: calls.append(1) or plain(data))
    assert len(list(pcm.SegmentCutter().eval(sound, [{"segment": i, "start": i * 10, "length": 10} for i in range(50)]))) == 50 and len(calls) == 1


ROWS = [("i1", "original/a", "AB", "10", "5", "x|y", "Eligible", "True"), ("i2", "original/b", "cd", "", "6", "", "Rejected", "False")]


def codes(spark, lines, tmp_path=None):
    manifest = spark.createDataFrame([("I1", "original/a", "ab", 10, 5, "x|y", "Eligible", "True"), ("i2", "original/b", "CD", None, 6, "", "Rejected", "false")], "item_id string, relative_audio_path string, sha256 string, duration_ms long, byte_length long, quality_flags string, training_eligibility string, selected string")
    if tmp_path is not None:
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.csv"
        path.write_text("\r\n".join(lines))
        rows = files.read_csv_rows(spark, str(path))
    else:
        rows = files.csv_rows(spark.createDataFrame(list(enumerate(lines)), "n long, l string"), "n", "l")
    return sorted(r["code"] for r in W.csv_issues(rows, manifest, "dataset.csv").collect())


def test_csv_findings(spark, tmp_path):
    head, (a, b) = ",".join(PORTABLE), (",".join(r) for r in ROWS)
    for where in (None, tmp_path):
        assert codes(spark, [head, a, b], where) == []
        assert codes(spark, [head.replace("item_id", "Item_id"), a], where) == ["csv-header-invalid"] == codes(spark, [head + ",more", a, b], where)
        assert codes(spark, [head, a, a.replace("i1", "I1"), "x,y", b + ",z", b], where) == ["csv-row-invalid"] * 3
        assert codes(spark, [head, a.replace("original/a", '"original/""a"""')], where) == ["csv-json-mismatch", "csv-row-missing"]
        assert codes(spark, [head, a, b, b.replace("i2", "i3"), b.replace("i2", "i4")], where) == ["csv-row-extra"]
        assert codes(spark, [head], where) == ["csv-row-missing"] * 2
    assert codes(spark, [head, a, b.replace("original/b", '"or\nb"')], tmp_path) == ["csv-json-mismatch"]
    assert codes(spark, [], tmp_path) == ["csv-header-invalid"]


def test_documents_in_canonical_form(spark):
    texts = ['{"b": [1, {"y": null, "x": "\\u00e9"}], "a": {"k": 2, "j": 1.50}, "z": null, "n": "key"}', '{"a":{"j":1.50,"k":2},"b":[1,{"x":"é","y":null}]}', '{"a":{"j":1.5,"k":3},"b":[1]}', "[1]", "{", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(W.canonical(F.col("t"), ("n",))).collect()]
    assert got[0] == got[1] != got[2] and got[0] is not None and got[3:] == [None] * 3


def test_document_findings(spark):
    manifest = '{"runId": "r", "items": [1, 2], "datasetNamespaceKey": "k"}'
    rows = [("m", "manifest", manifest), ("a", "alias", '{"items":[1,2],"runId":"r"}'), ("b", "alias", '{"items":[2,1],"runId":"r"}'), ("c", "alias", "nope"), ("d", "alias", None)]
    docs = lambda rows: spark.createDataFrame(rows, "path string, role string, text string")
    found = lambda rows, journal: sorted(tuple(r) for r in W.document_issues(docs(rows), "m", F.lit(journal).cast("string")).collect())
    aliases = [("b", "manifest-alias-mismatch"), ("c", "manifest-alias-invalid"), ("d", "manifest-alias-missing")]
    assert found(rows, '{"items": [1,2], "runId": "r"}') == aliases
    assert found(rows, '{"items": [1], "runId": "r"}') == [*aliases, ("m", "journal-manifest-mismatch")]
    assert found([("m", "manifest", "[")], None) == [("m", "manifest-invalid")] and found([("m", "manifest", None)], None) == [("m", "manifest-missing")]
    assert found([("m", "manifest", '{"datasetNamespaceKey": " "}')], None) == [("m", "portable-id-namespace-missing")]


def test_commit_event_findings(spark):
    rows = [("ok", True, "D", "d", "m", None), ("none", False, "d", "d", "m", "m"), ("gone", True, None, "d", "m", "m"), ("other", True, "e", "d", "m", "m"), ("old", True, None, " ", "M", "m"), ("old-bad", True, None, None, "x", "m"), ("null", None, "d", "d", "m", "m")]
    df = spark.createDataFrame(rows, "path string, commits boolean, descriptor string, told string, manifest string, told_manifest string")
    got = {r["path"]: r["code"] for r in W.commit_event_issues(*map(F.col, ("path", "commits", "descriptor", "told", "manifest", "told_manifest")), df).collect()}
    assert got == {"none": "journal-not-committed", "gone": "metadata-descriptor-missing", "other": "metadata-descriptor-hash-mismatch", "old-bad": "manifest-hash-mismatch", "null": "journal-not-committed"}
