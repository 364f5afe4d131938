"""An export folder as a whole: every rule of its verification over the files that are there."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import manifest as M
from ..operators import verification as W
from ..sinks.payloads import digest_of
from ..sources import files, walk
from ..storage import durable

#: Fields of the documents that the rules read (fixed values).
ENTRY = "messageId string, sourceStableKey string, originalPath string, originalSha256 string, originalByteLength long, decodedPath string, wavSha256 string, durationMs long, qualityFlags array<string>, trainingEligibility string, userSelectionState string"
MANIFEST = f"runId string, runStatus string, datasetNamespaceKey string, entries array<struct<{', '.join(':'.join(f.split(' ', 1)) for f in ENTRY.split(', '))}>>"
PORTABLE = "runId string, items array<struct<itemId:string,relativeAudioPath:string,sha256:string,byteLength:long,durationMs:long,qualityFlags:array<string>,trainingEligibility:string,selected:boolean>>"
DESCRIPTOR = ("privateManifestSha256", "portableManifestSha256", "datasetCsvSha256", "artifactIndexSha256")
INDEX = "relativePath string, fileId string, length long, sha256 string"
#: A run's files and the latest ones, in the descriptor's order (fixed values).
RUN_FILES, LATEST_FILES = (".manifest.private.json", ".dataset.manifest.json", ".dataset.csv", ".artifact-index.jsonl"), ("manifest.private.json", "dataset.manifest.json", "dataset.csv", "artifact-index.jsonl")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256 and is_link of all files and links below a folder; files are hashed in chunks by the executors."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            found = [digest_of(store, f"{base}/{p}") if k == "file" else (None, None) for p, k in zip(batch["path"].to_pylist(), batch["kind"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), batch["is_link"]], ["path", "bytes", "sha256", "is_link"])

    found = walk.walk(spark, root).where("kind IN ('file', 'link')").select("path", "kind", "is_link")
    return durable(found.repartition("path").mapInArrow(hashed, "path string, bytes long, sha256 string, is_link boolean"))


def _code(spark: SparkSession, path: str | None, code: str) -> DataFrame:
    return spark.createDataFrame([(path, code)], "path string, code string")


def _shown(c: Column) -> Column:
    """An enumeration's value as the CSV has it."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))


class Export:
    """An export's folder, a URI of a file system that Spark and Arrow open."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _text(self, path: str) -> str:
        rows = self.spark.read.text(f"{self.root}/{path}", wholetext=True).limit(1).collect()
        return rows[0][0] if rows else ""

    def portable(self, entries: DataFrame, namespace: str | None) -> DataFrame:
        """The rows of the portable CSV and manifest that the private entries give."""
        stable = F.coalesce("sourceStableKey", F.concat_ws("\n", "messageId", "originalSha256"))
        item = I.item_id(stable, bytes.fromhex(namespace) if (namespace or "").strip() else None)
        return M.portable_rows(entries, item, F.col("originalPath"), F.col("originalSha256"), F.col("durationMs"), F.col("originalByteLength"), F.coalesce("qualityFlags", F.array().cast("array<string>")), _shown(F.col("trainingEligibility")), F.col("userSelectionState") == "selected")

    def verify(self, run_id: str | None = None) -> DataFrame:
        """(path, code) of everything that is wrong with a run, by default the latest; nothing of a sound export.

        Documents are single JSON files: one task parses one of them, and only their head fields come to the driver; entries,
        journal lines, index lines, CSV rows and files are rows.
        """
        spark, there = self.spark, inventory(self.spark, self.root)
        documents = {r["path"]: r["sha256"] for r in there.where("(path LIKE 'runs/%' OR path NOT LIKE '%/%') AND NOT is_link").select("path", "sha256").collect()}  # a few of each run
        latest = not run_id
        candidates = ["manifest.private.json", "latest.manifest.json"] if latest else [f"runs/{run_id}.manifest.private.json", f"runs/{run_id}.manifest.json"]
        path = next((c for c in candidates if c in documents), None)
        if path is None:
            return _code(spark, None, "manifest-missing")
        text = spark.createDataFrame([(self._text(path),)], "text string")
        head = text.select(W.canonical(F.col("text")).isNotNull().alias("good"), F.from_json("text", MANIFEST).alias("m")).select("good", "m.runId", "m.runStatus", "m.datasetNamespaceKey").first()
        if not head["good"] or not (head["runId"] or "").strip():
            return _code(spark, path, "manifest-invalid")
        run, namespace = run_id or head["runId"], head["datasetNamespaceKey"]
        named = [f"runs/{run}{suffix}" for suffix in RUN_FILES] + (list(LATEST_FILES) if latest else [])
        entries = text.select(F.posexplode_outer(F.from_json("text", MANIFEST)["entries"]).alias("place", "e")).where("e IS NOT NULL").select("place", "e.*")
        entries = durable(entries)
        portable = self.portable(entries, namespace)
        out = [self._aliases(path, named, documents, portable, head), self._journal(head, path, entries, documents), self._descriptor(run, latest, documents)]
        refs = W.references(entries, "place", ("originalPath", "originalSha256", "originalByteLength"), ("decodedPath", "wavSha256"))
        out.append(W.artifact_issues(refs, there))
        for csv in [n for n in named if n.endswith(".csv")]:
            out.append(W.csv_issues(files.read_csv_rows(spark, f"{self.root}/{csv}"), portable, csv) if csv in documents else _code(spark, csv, "csv-missing"))
        index = "artifact-index.jsonl" if latest else f"runs/{run}.artifact-index.jsonl"
        out.append(W.index_issues(self._index(index), W.expected_files(refs), there) if index in documents else _code(spark, index, "artifact-index-missing"))
        return reduce(DataFrame.unionByName, out)

    def _index(self, path: str) -> DataFrame:
        lines = self.spark.read.text(f"{self.root}/{path}").where(F.col("value").rlike(r"\S")).withColumn("line", F.monotonically_increasing_id())
        e = lines.select("line", F.from_json("value", INDEX).alias("e"))
        return e.select("line", F.col("e.relativePath").alias("path"), F.col("e.length").alias("bytes"), F.col("e.sha256").alias("sha256"), F.col("e.fileId").alias("file_id"))

    def _aliases(self, manifest: str, named: list[str], documents: dict, portable: DataFrame, head) -> DataFrame:
        spark = self.spark
        private = [n for n in named if n.endswith("manifest.private.json")]
        rows = [(manifest, "manifest", self._text(manifest))] + [(n, "alias", self._text(n) if n in documents else None) for n in private]
        out = [W.document_issues(spark.createDataFrame(rows, "path string, role string, text string"), manifest, F.lit(None).cast("string"))]
        wanted = portable.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in M.PORTABLE])
        for name in [n for n in named if n.endswith("dataset.manifest.json")]:
            if name not in documents:
                out.append(_code(spark, name, "manifest-alias-missing"))
                continue
            text = spark.createDataFrame([(self._text(name),)], "text string").select(W.canonical(F.col("text")).isNotNull().alias("good"), F.from_json("text", PORTABLE).alias("m"))
            told = text.select("good", "m.runId").first()
            items = text.select(F.explode("m.items").alias("i")).select("i.*")
            found = M.portable_rows(items, F.col("itemId"), F.col("relativeAudioPath"), F.col("sha256"), F.col("durationMs"), F.col("byteLength"), F.coalesce("qualityFlags", F.array().cast("array<string>")), _shown(F.col("trainingEligibility")), F.col("selected"))
            found = found.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in M.PORTABLE])
            if not told["good"]:
                out.append(_code(spark, name, "manifest-alias-invalid"))
            elif told["runId"] != head["runId"] or not wanted.exceptAll(found).isEmpty() or not found.exceptAll(wanted).isEmpty():
                out.append(_code(spark, name, "manifest-alias-mismatch"))
        return reduce(DataFrame.unionByName, out)

    def _events(self, path: str) -> DataFrame:
        kind = f"event string, runId string, manifestSha256 string, metadataCommitDescriptorSha256 string, entry struct<{', '.join(':'.join(f.split(' ', 1)) for f in ENTRY.split(', '))}>, failure struct<messageId:string,stage:string,error:string>"
        lines = self.spark.read.text(f"{self.root}/{path}").where(F.col("value").rlike(r"\S")).withColumn("line", F.monotonically_increasing_id())
        return lines.select("line", W.canonical(F.col("value")).isNotNull().alias("good"), F.from_json("value", kind).alias("e"))

    def _journal(self, head, manifest: str, entries: DataFrame, documents: dict) -> DataFrame:
        spark, path, run = self.spark, f"runs/{head['runId']}.jsonl", head["runId"]
        out, told = [], None
        if path in documents:
            events = durable(self._events(path))
            out.append(events.where(~F.col("good")).select(F.lit(path).alias("path"), F.lit("journal-invalid").alias("code")))
            sound = events.where("good").select("line", "e.*")
            told = sound.where("event = 'manifest-committed'").orderBy(F.desc("line")).limit(1).select("manifestSha256", "metadataCommitDescriptorSha256").first()
            fields = [f.split(" ")[0] for f in ENTRY.split(", ")]
            stored = sound.where("event IN ('item-committed', 'item-skipped') AND entry IS NOT NULL").select("entry.*").select(*fields)
            own = entries.select(*fields)
            status = M.journal_status(sound.withColumn("run", F.lit(run)), "run", "line", "event", F.col("entry"), F.col("failure"), fallback="Failed").first()
            same = stored.exceptAll(own).isEmpty() and own.exceptAll(stored).isEmpty() and (head["runStatus"] is None or (status and status["status"] or "Failed").lower() == head["runStatus"].lower())
            if not same:
                out.append(_code(spark, path, "journal-manifest-mismatch"))
        one = spark.createDataFrame([(told is not None, documents.get(f"runs/{run}.metadata-commit.json"), told and told[1], documents[manifest], told and told[0])], "commits boolean, descriptor string, told_descriptor string, manifest string, told_manifest string")
        out.append(W.commit_event_issues(F.lit(path), *map(F.col, ("commits", "descriptor", "told_descriptor", "manifest", "told_manifest")), one))
        return reduce(DataFrame.unionByName, out)

    def _descriptor(self, run: str, latest: bool, documents: dict) -> DataFrame:
        spark, path = self.spark, f"runs/{run}.metadata-commit.json"
        rows = []
        parse = lambda name: spark.createDataFrame([(self._text(name),)], "t string").select(W.canonical(F.col("t")).alias("form"), F.from_json("t", "runId string, " + ", ".join(f"{f} string" for f in DESCRIPTOR)).alias("d")).select("form", "d.*").first()
        if path not in documents:
            return _code(spark, path, "metadata-commit-missing")
        told = parse(path)
        if told["form"] is None:
            return _code(spark, path, "metadata-commit-invalid")
        if told["runId"] != run:
            rows.append((path, "metadata-commit-run-mismatch"))
        lists = [("commit", "hash-mismatch", [f"runs/{run}{s}" for s in RUN_FILES])] + ([("latest", "file-mismatch", list(LATEST_FILES))] if latest else [])
        for kind, mismatch, names in lists:
            for name, field in zip(names, DESCRIPTOR):
                if name not in documents:
                    rows.append((name, f"metadata-{kind}-file-missing"))
                elif documents[name].lower() != (told[field] or "").lower():
                    rows.append((name, f"metadata-{kind}-{mismatch}"))
        if latest:
            pointer = "latest.metadata-commit.json"
            form = parse(pointer)["form"] if pointer in documents else None
            if form != told["form"]:
                rows.append((pointer, "metadata-latest-missing" if pointer not in documents else "metadata-latest-invalid" if form is None else "metadata-latest-mismatch"))
        return spark.createDataFrame(rows, "path string, code string")

    def may_repair(self, run_id: str | None = None) -> bool:
        """Whether derived metadata may be rebuilt: the run's journal is committed and its artifacts are sound."""
        found = self.verify(run_id)
        blocking = found.where(F.col("code").isin("journal-not-committed", "journal-invalid", "manifest-missing", "manifest-invalid") | (F.col("code").rlike("^(?:artifact|decoded)-") & ~F.col("code").startswith("artifact-index-")))
        return W.repair_gate(F.lit(True), blocking).first()["allowed"]
