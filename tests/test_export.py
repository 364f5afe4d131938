"""An export folder made sound, then spoiled in one way after another: every finding is told."""

import hashlib
import hmac
import json
import shutil

import pytest

from chorale.operators.manifest import PORTABLE
from chorale.plans.export import Export

KEY = "00112233445566778899aabbccddeeff"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def build(root, run="r1", status="completed"):
    """A sound export of three items, one of which has a decoded file."""
    for folder in ("original", "decoded", "runs"):
        (root / folder).mkdir(parents=True)
    entries, index = [], []
    for i in range(3):
        body = bytes([i]) * (10 + i)
        (root / f"original/{i}.silk").write_bytes(body)
        entry = {"messageId": f"m{i}", "sourceStableKey": f"k{i}", "originalPath": f"original/{i}.silk", "originalSha256": sha(body), "originalByteLength": len(body), "qualityFlags": ["a", "b"][:i], "trainingEligibility": "eligible", "userSelectionState": "selected" if i else "notSelected"}
        index.append((entry["originalPath"], len(body), sha(body)))
        if i == 1:
            (root / "decoded/1.wav").write_bytes(b"wav")
            entry |= {"decodedPath": "decoded/1.wav", "wavSha256": sha(b"wav"), "durationMs": 1500}
            index.append(("decoded/1.wav", 3, sha(b"wav")))
        entries.append(entry)
    item = lambda e: hmac.new(bytes.fromhex(KEY), e["sourceStableKey"].encode(), hashlib.sha256).hexdigest()
    manifest = {"generatedAtUtc": "2024-01-01T00:00:00Z", "runId": run, "runStatus": status, "datasetNamespaceKey": KEY, "entries": entries, "failures": []}
    portable = {"runId": run, "items": [{"itemId": item(e), "relativeAudioPath": e["originalPath"], "sha256": e["originalSha256"], "byteLength": e["originalByteLength"], "durationMs": e.get("durationMs"), "qualityFlags": e["qualityFlags"], "trainingEligibility": "eligible", "selected": e["userSelectionState"] == "selected"} for e in entries]}
    csv = [",".join(PORTABLE)] + [",".join([item(e), e["originalPath"], e["originalSha256"], str(e.get("durationMs", "")), str(e["originalByteLength"]), "|".join(e["qualityFlags"]), "Eligible", str(e["userSelectionState"] == "selected")]) for e in entries]
    texts = [json.dumps(manifest, indent=1), json.dumps(portable), "\r\n".join(csv) + "\r\n", "\n".join(json.dumps({"relativePath": p, "fileId": "f", "length": n, "sha256": h}) for p, n, h in index) + "\n"]
    for text, suffix, name in zip(texts, (".manifest.private.json", ".dataset.manifest.json", ".dataset.csv", ".artifact-index.jsonl"), ("manifest.private.json", "dataset.manifest.json", "dataset.csv", "artifact-index.jsonl")):
        (root / f"runs/{run}{suffix}").write_bytes(text.encode())
        (root / name).write_bytes(text.encode())
    descriptor = json.dumps({"runId": run, **{k: sha(t.encode()) for k, t in zip(("privateManifestSha256", "portableManifestSha256", "datasetCsvSha256", "artifactIndexSha256"), texts)}})
    (root / f"runs/{run}.metadata-commit.json").write_text(descriptor)
    (root / "latest.metadata-commit.json").write_text(descriptor)
    events = [{"event": "run-started", "runId": run}] + [{"event": "item-committed", "runId": run, "entry": e} for e in entries] + [{"event": "processing-completed", "runId": run}, {"event": "manifest-committed", "runId": run, "metadataCommitDescriptorSha256": sha(descriptor.encode()).upper()}]
    (root / f"runs/{run}.jsonl").write_text("\n".join(map(json.dumps, events)) + "\n")


@pytest.fixture(scope="module")
def sound(tmp_path_factory):
    root = tmp_path_factory.mktemp("export") / "sound"
    build(root)
    return root


def found(spark, root, run=None):
    return sorted((r["path"] or "", r["code"]) for r in Export(spark, f"file://{root}").verify(run).collect())


def test_a_sound_export_has_no_findings(spark, sound):
    assert found(spark, sound) == [] == found(spark, sound, "r1") and Export(spark, f"file://{sound}").may_repair()


def edited(path, change):
    path.write_text(json.dumps(change(json.loads(path.read_text()))))


SPOILT = {
    "manifest-missing": lambda r: (r / "manifest.private.json").unlink(),
    "manifest-invalid": lambda r: (r / "manifest.private.json").write_text("{"),
    "portable-id-namespace-missing": lambda r: edited(r / "manifest.private.json", lambda d: d | {"datasetNamespaceKey": " "}),
    "manifest-alias-missing": lambda r: (r / "runs/r1.manifest.private.json").unlink(),
    "manifest-alias-invalid": lambda r: (r / "runs/r1.manifest.private.json").write_text("[]"),
    "manifest-alias-mismatch": lambda r: edited(r / "runs/r1.dataset.manifest.json", lambda d: d | {"items": d["items"][:2]}),
    "journal-not-committed": lambda r: (r / "runs/r1.jsonl").write_text("".join((r / "runs/r1.jsonl").read_text().splitlines(True)[:-1])),
    "journal-invalid": lambda r: (r / "runs/r1.jsonl").write_text("{bad\n" + (r / "runs/r1.jsonl").read_text()),
    "journal-manifest-mismatch": lambda r: (r / "runs/r1.jsonl").write_text("".join(x for x in (r / "runs/r1.jsonl").read_text().splitlines(True) if '"m1"' not in x)),
    "metadata-descriptor-missing": lambda r: (r / "runs/r1.metadata-commit.json").unlink(),
    "metadata-descriptor-hash-mismatch": lambda r: edited(r / "runs/r1.metadata-commit.json", lambda d: d | {"more": 1}),
    "metadata-commit-run-mismatch": lambda r: edited(r / "runs/r1.metadata-commit.json", lambda d: d | {"runId": "other"}),
    "metadata-commit-invalid": lambda r: (r / "runs/r1.metadata-commit.json").write_text("nope"),
    "metadata-commit-file-missing": lambda r: (r / "runs/r1.dataset.csv").unlink(),
    "metadata-commit-hash-mismatch": lambda r: (r / "runs/r1.dataset.csv").write_text((r / "runs/r1.dataset.csv").read_text() + "x\r\n"),
    "metadata-latest-missing": lambda r: (r / "latest.metadata-commit.json").unlink(),
    "metadata-latest-invalid": lambda r: (r / "latest.metadata-commit.json").write_text("nope"),
    "metadata-latest-mismatch": lambda r: edited(r / "latest.metadata-commit.json", lambda d: d | {"runId": "r0"}),
    "metadata-latest-file-missing": lambda r: (r / "dataset.csv").unlink(),
    "metadata-latest-file-mismatch": lambda r: (r / "artifact-index.jsonl").write_text((r / "artifact-index.jsonl").read_text() + "\n"),
    "artifact-missing": lambda r: (r / "original/0.silk").unlink(),
    "artifact-hash-mismatch": lambda r: (r / "original/0.silk").write_bytes(b"x"),
    "artifact-reparse-point": lambda r: (r / "decoded/link").symlink_to(r / "original/0.silk"),
    "artifact-extra": lambda r: (r / "original/9.silk").write_bytes(b"x"),
    "decoded-missing": lambda r: (r / "decoded/1.wav").unlink(),
    "decoded-hash-mismatch": lambda r: (r / "decoded/1.wav").write_bytes(b"abc"),
    "artifact-index-missing": lambda r: (r / "artifact-index.jsonl").unlink(),
    "artifact-index-invalid": lambda r: (r / "artifact-index.jsonl").write_text("{\n" + (r / "artifact-index.jsonl").read_text()),
    "artifact-index-duplicate": lambda r: (r / "artifact-index.jsonl").write_text((r / "artifact-index.jsonl").read_text() * 2),
    "artifact-index-mismatch": lambda r: (r / "artifact-index.jsonl").write_text("".join((r / "artifact-index.jsonl").read_text().splitlines(True)[1:])),
    "csv-missing": lambda r: (r / "dataset.csv").unlink(),
    "csv-header-invalid": lambda r: (r / "dataset.csv").write_text((r / "dataset.csv").read_text().replace("item_id", "item")),
    "csv-row-invalid": lambda r: (r / "dataset.csv").write_text((r / "dataset.csv").read_text() + "x,y\r\n"),
    "csv-row-missing": lambda r: (r / "dataset.csv").write_text("".join((r / "dataset.csv").read_text().splitlines(True)[:-1])),
    "csv-json-mismatch": lambda r: (r / "dataset.csv").write_text((r / "dataset.csv").read_text().replace("1500", "1501")),
    "csv-row-extra": lambda r: (r / "dataset.csv").write_text((r / "dataset.csv").read_text() + "new,p,h,,1,,Eligible,True\r\n"),
}


#: Faults that don't hide each other, spoilt and found together.
TOGETHER = [
    ["manifest-missing"], ["manifest-invalid"],
    ["portable-id-namespace-missing", "manifest-alias-missing", "journal-not-committed", "metadata-commit-run-mismatch", "metadata-latest-missing", "artifact-missing", "decoded-missing", "artifact-index-missing", "csv-missing", "metadata-latest-file-missing"],
    ["manifest-alias-invalid", "journal-invalid", "metadata-descriptor-hash-mismatch", "metadata-latest-invalid", "artifact-hash-mismatch", "decoded-hash-mismatch", "artifact-index-invalid", "csv-header-invalid", "metadata-commit-file-missing"],
    ["manifest-alias-mismatch", "journal-manifest-mismatch", "metadata-descriptor-missing", "artifact-reparse-point", "artifact-extra", "artifact-index-duplicate", "csv-row-invalid"],
    ["metadata-commit-invalid", "csv-row-missing", "artifact-index-mismatch"], ["metadata-commit-hash-mismatch", "metadata-latest-mismatch", "metadata-latest-file-mismatch", "csv-json-mismatch", "csv-row-extra"],
]


def test_every_fault_is_tried():
    assert sorted(c for codes in TOGETHER for c in codes) == sorted(SPOILT)


@pytest.mark.parametrize("codes", TOGETHER, ids=lambda c: c[0])
def test_faults_are_found(spark, sound, tmp_path, codes):
    shutil.copytree(sound, tmp_path / "x", symlinks=True)
    for code in codes:
        if not (code == "csv-missing" and not (tmp_path / "x/dataset.csv").exists()) and not (code == "metadata-latest-file-missing" and "csv-missing" in codes):
            SPOILT[code](tmp_path / "x")
    told = {c for _, c in found(spark, tmp_path / "x")}
    assert set(codes) <= told
    if "manifest-missing" not in told and "manifest-invalid" not in told:
        assert Export(spark, f"file://{tmp_path}/x").may_repair() == (not told & {"journal-not-committed", "journal-invalid", "artifact-missing", "artifact-hash-mismatch", "artifact-reparse-point", "artifact-extra", "decoded-missing", "decoded-hash-mismatch"})
