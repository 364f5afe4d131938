"""Copying payloads to a shared file system, hashed while they are written, and repairing a dataset's metadata over them."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from .publish import PublishError, Run

#: Bytes that are read, hashed and written at a time.
CHUNK = 1 << 20
_DONE = "item string, target string, bytes long, sha256 string, outcome string"


def digest_of(files: fs.FileSystem, path: str) -> tuple[int, str]:
    """Length and sha256 of a file, read in chunks."""
    size, digest = 0, sha256()
    with files.open_input_stream(path) as stream:
        while chunk := stream.read(CHUNK):
            size += len(chunk)
            digest.update(chunk)
    return size, digest.hexdigest()


def _chunks(source: str | None, payload) -> Iterator[bytes]:
    if payload is not None:
        for start in range(0, len(payload), CHUNK):
            yield payload[start : start + CHUNK]
        return
    files, path = fs.FileSystem.from_uri(source)
    with files.open_input_stream(path) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


def _copy(root: str, target: str, source: str | None, payload, size: int | None, sha: str | None) -> tuple[int | None, str | None, str]:
    """Length, hash and outcome of one payload. The bytes go to a draft of this attempt's own name, and only a draft that is
    as expected gets the final name, so attempts that run twice or at once leave the same file."""
    files, base = fs.FileSystem.from_uri(root)
    path = f"{base}/{target}"
    there = files.get_file_info(path)
    if there.type == fs.FileType.File and sha is not None:
        found = digest_of(files, path)
        same = found[1] == sha.lower() and size in (None, found[0])
        return *found, "VerifiedExisting" if same else "Conflict"
    files.create_dir(path.rpartition("/")[0], recursive=True)
    draft, done, digest = f"{path}.{uuid4().hex}.draft", 0, sha256()
    try:
        with files.open_output_stream(draft) as out:
            for chunk in _chunks(source, payload):
                out.write(chunk)
                digest.update(chunk)
                done += len(chunk)
        found = digest.hexdigest()
        if (sha is not None and found != sha.lower()) or size not in (None, done):
            return done, found, "SourceMismatch"
        if there.type == fs.FileType.File and digest_of(files, path)[1] != found:
            return done, found, "Conflict"
        files.move(draft, path)
        return done, found, "Written"
    except FileNotFoundError:
        return None, None, "SourceMissing"
    finally:
        if files.get_file_info(draft).type == fs.FileType.File:
            files.delete_file(draft)


def copy_payloads(items: DataFrame, root: str) -> DataFrame:
    """item, target, bytes, sha256 and outcome of every row of ``items``: item, target (a path below ``root``), source (a URI) or
    payload (bytes; it wins), and perhaps the expected bytes and sha256.

    Outcomes: Written, VerifiedExisting (the target was there and is as expected), Conflict (it is there and differs; it stays),
    SourceMismatch and SourceMissing (nothing is written). The rows are computed once. A target that leaves the root, or that two
    rows have, is an error before anything is written.
    """
    from ..operators.verification import path_key, safe_path

    names = {c: t for c, t in (("item", "string"), ("target", "string"), ("source", "string"), ("payload", "binary"), ("bytes", "long"), ("sha256", "string"))}
    rows = items.select(*[(F.col(c) if c in items.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()])
    if not rows.where(~F.coalesce(safe_path(F.col("target")), F.lit(False))).isEmpty():
        raise PublishError("artifact-path-outside-root")
    if not rows.groupBy(path_key(F.col("target"))).count().where("count > 1").isEmpty():
        raise PublishError("artifact-duplicate")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a payload may be large
                item, target, source, payload, size, sha = (batch[c][i] for c in names)
                data = payload.as_buffer() if payload.is_valid else None
                size, sha, outcome = _copy(root, target.as_py().replace("\\", "/"), source.as_py(), data, size.as_py(), sha.as_py())
                yield pa.RecordBatch.from_pylist([{"item": item.as_py(), "target": target.as_py(), "bytes": size, "sha256": sha, "outcome": outcome}], pa.schema([("item", pa.string()), ("target", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("outcome", pa.string())]))

    return durable(rows.mapInArrow(copy, _DONE))


def verified(copied: DataFrame) -> DataFrame:
    """The copied rows, if every one of them was written or verified."""
    wrong = copied.where(~F.col("outcome").isin("Written", "VerifiedExisting")).select("item", "outcome").first()
    if wrong is not None:
        raise PublishError("artifact-unreadable" if wrong["outcome"] == "SourceMissing" else "artifact-hash-mismatch", wrong["item"])
    return copied


def check_in_place(items: DataFrame, root: str) -> DataFrame:
    """(item, code) of items (item, target, bytes, sha256) whose file below ``root`` is missing or differs; read in chunks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                path = f"{base}/{row['target']}"
                if files.get_file_info(path).type != fs.FileType.File:
                    out.append((row["item"], "audio-missing"))
                elif digest_of(files, path) != (row["bytes"], (row["sha256"] or "").lower()):
                    out.append((row["item"], "audio-differs"))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["item", "code"])

    return items.select(F.col("item").cast("string"), "target", F.col("bytes").cast("long"), "sha256").mapInArrow(check, "item string, code string")


def build_dataset(run: Run, items: DataFrame, root: str, outputs) -> dict:
    """Copy the items' audio, verify it, and publish what ``outputs`` (a function of the copied rows) makes of it: all or nothing."""
    copied = verified(copy_payloads(items, root))
    return run.publish(outputs(copied))


def repair_dataset(run: Run, items: DataFrame, root: str, outputs: dict[str, DataFrame], present: DataFrame | None = None) -> str:
    """Publish a dataset's metadata anew over audio that is verified in place and never touched; an interrupted repair goes on
    from its prepared transaction. ``present`` (target) are the audio files that are there: none may be unexpected."""
    if run.store.read(run.transaction) is not None:
        state = run.recover()
        if run.store.exists(run.descriptor):
            return state
    wrong = check_in_place(items, root).first()
    if wrong is not None:
        raise PublishError("dataset-audio-set-invalid", f"{wrong['item']}: {wrong['code']}")
    if present is not None and not present.join(items, "target", "left_anti").isEmpty():
        raise PublishError("dataset-audio-set-invalid", "a file is not expected")
    run.publish(outputs)
    return "Completed"
