"""Publishing as one unit: crashes after each step, two publishers, files that nobody bound; payloads copied and verified."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from chorale.sinks import payloads as P
from chorale.sinks import publish as S


class Crash(Exception):
    pass


@pytest.fixture
def outputs(spark):
    return lambda n: {"rows": spark.range(0, n, 1, 1).withColumn("v", F.col("id") * 2), "csv": spark.createDataFrame([(str(n), "a,\"b")], "n string, x string").coalesce(1)}


FORMATS = {"csv": ("csv", {"header": "true", "escape": '"'})}


def seen(spark, root):
    """What readers of the latest run find: nothing, or two outputs of one run."""
    try:
        rows, text = (S.read_run(spark, root, name, verify=True) for name in ("rows", "csv"))
    except S.PublishError as error:
        assert error.code == "metadata-commit-missing"
        return None
    (told,), found = text.collect(), rows.collect()
    assert str(len(found)) == told["n"] and told["x"] == 'a,"b' and all(r["v"] == 2 * r["id"] for r in found)
    return len(found)


def test_publish_and_read(spark, outputs, tmp_path):
    root = f"file://{tmp_path}/x"
    assert seen(spark, root) is None
    S.Run(spark, root, "r1").publish(outputs(5), FORMATS)
    assert seen(spark, root) == 5
    with pytest.raises(S.PublishError, match="run-committed"):
        S.Run(spark, root, "r1").publish(outputs(6), FORMATS)
    S.Run(spark, root, "r2").publish(outputs(7), FORMATS)
    assert seen(spark, root) == 7 and S.read_run(spark, root, "rows", "r1").count() == 5
    spark.range(3).write.mode("append").parquet(f"{root}/{S.Store(spark, root).read('runs/r2.commit.json')['data']}/rows")
    assert seen(spark, root) == 7  # a file that no descriptor lists is not seen
    for bad in ("", "a/b", ".x"):
        with pytest.raises(S.PublishError):
            S.Run(spark, root, bad)


@pytest.mark.parametrize("whole", [True, False])
def test_a_crash_at_each_step_leaves_all_or_nothing(spark, outputs, tmp_path, monkeypatch, whole):
    """Before (or after) the k-th change of the store the publisher dies; readers see the old run or the new one, recovery ends it."""
    root = f"file://{tmp_path}/x"
    S.Run(spark, root, "old").publish(outputs(3), FORMATS)
    plain = {name: getattr(S.Store, name) for name in ("write", "move")}
    crashes = 0
    for step in range(40):
        count = [0]

        def dying(name):
            def call(self, *args, **more):
                count[0] += 1
                if count[0] > step:
                    if count[0] == step + 1 and whole:
                        plain[name](self, *args, **more)
                    raise Crash
                return plain[name](self, *args, **more)

            return call

        run = S.Run(spark, root, f"new{step}")
        before = seen(spark, root)
        with monkeypatch.context() as m:
            for name in plain:
                m.setattr(S.Store, name, dying(name))
            try:
                run.publish(outputs(step + 10), FORMATS)
            except Crash:
                crashes += 1
        assert seen(spark, root) in (before, step + 10)
        state = run.recover()
        if state == "Missing":
            assert seen(spark, root) == before and not [n for n in S.Store(spark, root).names("staging") if n.startswith(f"new{step}-")]
            run.publish(outputs(step + 10), FORMATS)
        assert seen(spark, root) == step + 10 and run.recover() == "Completed"
        if not count[0] > step:
            break
    assert crashes >= 8


def test_recovery_refuses_changed_files(spark, outputs, tmp_path):
    root = f"file://{tmp_path}/x"
    run = S.Run(spark, root, "r")
    document = run.stage(outputs(4), FORMATS)
    (part,) = [p for p in (tmp_path / "x" / document["staging"] / "csv").iterdir() if p.name.startswith("part")]
    part.write_text("n,x\n5,y\n")
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(S.PublishError, match="staged-files-invalid"):
        run.recover()
    assert seen(spark, root) is None and run.store.read(run.transaction)["state"] == S.FAILED


def test_one_of_two_publishers_moves_the_pointer(spark, outputs, tmp_path):
    root = f"file://{tmp_path}/x"
    store = S.Store(spark, root)
    for name in ("a", "b"):
        S.Run(spark, root, name).publish(outputs(2), FORMATS, latest=False)
    assert S.latest_run(store) == (0, None) and S.point_to(store, "a", seen=0) == 1
    with pytest.raises(S.PublishError, match="latest-moved"):
        S.point_to(store, "b", seen=0)
    assert S.point_to(store, "a") == 1 and S.point_to(store, "b", seen=1) == 2 and S.latest_run(store) == (2, "b")
    with pytest.raises(S.PublishError, match="metadata-commit-missing"):
        S.point_to(store, "nobody")
    store.write("runs/bad.commit.json", {"x": 1})
    (tmp_path / "x" / "runs" / "torn.commit.json").write_text("{")
    with pytest.raises(S.PublishError, match="document-invalid"):
        S.read_run(spark, root, "rows", "torn")


def payload(i):
    return bytes([i % 256]) * (i * 1000)


def test_payloads_are_copied_and_verified(spark, tmp_path, monkeypatch):
    source, root = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    for i in (3, 4):
        (source / str(i)).write_bytes(payload(i))
    digest = lambda i: sha256(payload(i)).hexdigest()
    rows = [
        ("a", "x/1", None, bytearray(payload(1)), 1000, digest(1).upper()), ("b", "x/2", None, bytearray(payload(2)), None, None), ("c", "y/3", f"file://{source}/3", None, None, digest(3)),
        ("d", "y/4", f"file://{source}/4", None, 5, None), ("e", "y/5", f"file://{source}/5", None, None, None), ("f", "z/0", None, bytearray(b""), 0, None),
    ]
    ddl = "item string, target string, source string, payload binary, bytes long, sha256 string"
    items = spark.createDataFrame(rows, ddl)
    got = {r["item"]: r for r in P.copy_payloads(items, root).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"a": "Written", "b": "Written", "c": "Written", "d": "SourceMismatch", "e": "SourceMissing", "f": "Written"}
    assert got["c"]["sha256"] == digest(3) and got["b"]["bytes"] == 2000 and (tmp_path / "out/x/1").read_bytes() == payload(1)
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["0", "1", "2", "3"]  # no drafts are left
    again = {r["item"]: r["outcome"] for r in P.copy_payloads(items.where("item IN ('a', 'b', 'c')"), root).collect()}
    assert again == {"a": "VerifiedExisting", "b": "Written", "c": "VerifiedExisting"}
    (tmp_path / "out/x/1").write_bytes(b"other")
    assert P.copy_payloads(items.where("item = 'a'"), root).first()["outcome"] == "Conflict" and (tmp_path / "out/x/1").read_bytes() == b"other"
    for target, code in (("../x", "outside-root"), ("X\\1", "duplicate")):
        with pytest.raises(S.PublishError, match=code):
            P.copy_payloads(spark.createDataFrame([("a", "x/1", "u"), ("b", target, "u")], "item string, target string, source string"), root)


def test_datasets_are_built_and_repaired(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/set"
    items = spark.createDataFrame([(f"i{i}", f"audio/{i}.wav", bytearray(payload(i))) for i in range(5)], "item string, target string, payload binary")
    outputs = lambda copied: {"dataset": copied.select("item", "target", "bytes", "sha256"), "build": copied.agg(F.sum("bytes").alias("bytes"))}
    P.build_dataset(S.Run(spark, root, "one"), items, root, outputs)
    built = S.read_run(spark, root, "dataset", verify=True)
    assert built.count() == 5 and S.read_run(spark, root, "build").first()["bytes"] == 10_000
    made = {"dataset": built, "build": built.agg(F.sum("bytes").alias("bytes"))}
    audio = spark.createDataFrame([(f"audio/{i}.wav",) for i in range(5)], "target string")
    run = S.Run(spark, root, "two")
    plain = S.Store.write

    def dying(self, name, *args, **more):
        if name.endswith("two.commit.json"):
            raise Crash
        return plain(self, name, *args, **more)

    with monkeypatch.context() as m:
        m.setattr(S.Store, "write", dying)
        with pytest.raises(Crash):
            P.repair_dataset(run, built, root, made, audio)
    assert run.store.read(run.transaction)["state"] == S.FAILED and S.latest_run(run.store)[1] == "one"
    assert P.repair_dataset(run, built, root, made, audio) == "Completed" and S.latest_run(run.store)[1] == "two"
    (tmp_path / "set/audio/3.wav").write_bytes(b"x")
    with pytest.raises(S.PublishError, match="i3: audio-differs"):
        P.repair_dataset(S.Run(spark, root, "three"), built, root, made)
    with pytest.raises(S.PublishError, match="not expected"):
        P.repair_dataset(S.Run(spark, root, "three"), built.where("item <> 'i3'"), root, made, audio)


def test_profiles_come_back_as_they_were_saved(spark, tmp_path):
    from chorale.operators.dataset import Selection
    from chorale.sinks import profiles

    root = f"file://{tmp_path}/profiles"
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "item_id string")
    selection = Selection("ABC", "v1", least_ms=5, excluded_flags=("x", "y"))
    saved = profiles.save_profile(S.Run(spark, root, "p1"), selection, ids(["I2", " i1 ", "i2"]), "item_id", ids(["I1"]))
    loaded, items, representatives, fingerprint = profiles.load_profile(spark, root)
    assert loaded == selection and fingerprint == saved and sorted(r["id"] for r in items.collect()) == ["i1", "i2"] and [r["id"] for r in representatives.collect()] == ["i1"]
    assert profiles.profile_fits(loaded, items, "abc", ids(["I1", "i2"])).count() == 0
    assert sorted(tuple(r) for r in profiles.profile_fits(loaded, items, "abd", ids(["I1"])).collect()) == [("i2", "profile-item-unknown"), ("manifest", "profile-manifest-mismatch")]
    run = S.Run(spark, root, "p2")
    head = spark.createDataFrame([('{"manifest_sha256": "abc", "profile_version": "v1", "excluded_flags": []}', fingerprint)], "selection string, fingerprint string")
    run.publish({"selection": head, "items": items, "representatives": representatives})
    with pytest.raises(S.PublishError, match="profile-invalid"):
        profiles.load_profile(spark, root)
    assert profiles.load_profile(spark, root, "p1")[3] == saved
