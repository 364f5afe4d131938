"""Artifact verification against a plain walk over the entries, chains of names included."""

import random

import pytest
from pyspark.sql import functions as F

from chorale.operators import verification as W

ENTRY = "n int, op string, oh string, ob long, dp string, dh string"
FILE = "path string, bytes long, sha256 string, is_link boolean"


def walk(entries, files):
    """Issues and expected keys as one pass over the entries in order finds them."""
    there = {p.lower(): (size, sha, link) for p, size, sha, link in files}
    safe = lambda p: bool(p.strip()) and not p.startswith("/") and ".." not in p.replace("\\", "/").split("/")
    expected, issues, accepted = set(), [], []
    for n, op, oh, ob, dp, dh in entries:
        if not safe(op):
            issues.append((op, "artifact-path-outside-root"))
            continue
        path = op.replace("\\", "/")
        if path.lower() in expected:
            issues.append((path, "artifact-duplicate"))
            continue
        expected.add(path.lower())
        accepted.append(n)
        found = there.get(path.lower())
        if found is None:
            issues.append((path, "artifact-missing"))
        elif found[2]:
            issues.append((path, "artifact-reparse-point"))
        elif found[0] != ob or found[1].lower() != oh.lower():
            issues.append((path, "artifact-hash-mismatch"))
        if dp is not None:
            path = dp.replace("\\", "/")
            if not safe(dp):
                issues.append((dp, "artifact-path-outside-root"))
                continue
            if path.lower() in expected:
                issues.append((path, "artifact-duplicate"))
            expected.add(path.lower())
            found = there.get(path.lower())
            if dh is not None and found is None:
                issues.append((path, "decoded-missing"))
            elif dh is not None and found[1].lower() != dh.lower():
                issues.append((path, "decoded-hash-mismatch"))
    for p, _, _, link in files:
        if p.lower().startswith(("original/", "decoded/")):
            if link:
                issues.append((p, "artifact-reparse-point"))
            elif p.lower() not in expected:
                issues.append((p, "artifact-extra"))
    return sorted(issues), expected, accepted


def check(spark, entries, files):
    refs = W.references(spark.createDataFrame(entries, ENTRY), "n", ("op", "oh", "ob"), ("dp", "dh"))
    there = spark.createDataFrame(files, FILE)
    issues, expected, accepted = walk(entries, files)
    assert sorted(r["order"] for r in W.accepted_entries(refs).collect()) == accepted
    assert sorted(tuple(r) for r in W.artifact_issues(refs, there).collect()) == issues
    assert {r["key"] for r in W.expected_files(refs).collect()} == expected
    return issues


def test_a_refused_entry_expects_no_decoded_file(spark):
    entries = [(1, "original/a", "H", 1, "decoded/a", "h"), (2, "Original\\A", "h", 1, "decoded/b", "h"), (3, "../c", "h", 1, "decoded/c", "h"), (4, "original/d", "h", 1, "decoded\\a", "x")]
    files = [("original/a", 1, "h", False), ("decoded/a", 1, "h", False), ("decoded/b", 1, "h", False), ("decoded/c", 1, "h", False), ("original/d", 1, "h", False)]
    assert check(spark, entries, files) == sorted([
        ("Original/A", "artifact-duplicate"), ("../c", "artifact-path-outside-root"), ("decoded/a", "artifact-duplicate"), ("decoded/a", "decoded-hash-mismatch"), ("decoded/b", "artifact-extra"), ("decoded/c", "artifact-extra"),
    ])


def test_chains_of_names(spark):
    """Each entry's decoded file has the name of the next one's original: every other entry is refused."""
    entries = [(i, f"original/{i}", "h", 1, f"original/{i + 1}", None) for i in range(9)]
    check(spark, entries, [(f"original/{i}", 1, "h", i == 4) for i in range(12)])


@pytest.mark.parametrize("seed", range(3))
def test_random_names(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice(["original/", "Decoded\\", "decoded/", "../"] * 3 + [" "]) + rng.choice("abcdefg")
    entries = [(i, name(), rng.choice("hH"), rng.choice([1, 1, 2]), rng.choice([None, name(), name()]), rng.choice([None, "h", "x"])) for i in range(40)]
    files = [(f"{d}/{c}", rng.choice([1, 1, 2]), rng.choice("hHx"), rng.random() < 0.2) for d in ("original", "decoded", "notes") for c in "abcdefgh" if rng.random() < 0.7]
    check(spark, entries, files)


def test_repair_gate(spark):
    entries = [(1, "original/a", "h", 1, "decoded/a", "h")]
    refs = W.references(spark.createDataFrame(entries, ENTRY), "n", ("op", "oh", "ob"), ("dp", "dh"))
    sound = [("original/a", 1, "h", False), ("decoded/a", 9, "H", False)]
    for files, commits, allowed in ((sound, True, True), (sound, False, False), (sound, None, False), (sound[:1], True, False), ([*sound, ("decoded/b", 1, "h", False)], True, False)):
        assert W.repair_gate(F.lit(commits).cast("boolean"), W.artifact_issues(refs, spark.createDataFrame(files, FILE))).first()["allowed"] == allowed


def test_aliases_are_compared_as_bags(spark):
    derived = [("x", 1), ("x", 1), (None, 2)]
    stored = {"same": derived[::-1], "fewer": derived[1:], "more": [*derived, ("y", 1)], "other": [("x", 1), ("x", 2), (None, 2)], "often": [*derived, derived[2]]}
    frame = spark.createDataFrame([(k, *r) for k, rows in stored.items() for r in rows], "alias string, a string, b int")
    names = spark.createDataFrame([(k,) for k in [*stored, "absent"]], "alias string")
    got = {r["path"]: r["code"] for r in W.alias_issues(frame, spark.createDataFrame(derived, "a string, b int"), names).collect()}
    assert got == {"absent": "manifest-alias-missing"} | {k: "manifest-alias-mismatch" for k in ("fewer", "more", "other", "often")}
