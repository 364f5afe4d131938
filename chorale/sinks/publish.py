"""Publishing the outputs of a run as one unit.

Spark writes the outputs beside each other into a staging folder and hashes their files on the executors. A transaction
document then binds them, the folder moves to its final name, and the run's descriptor appears last: it is the commit.
Readers open only files that a descriptor lists. The latest pointer is a numbered document that can be created once, so
of two publishers that saw the same number one wins and the other is told. ``recover`` finishes or clears what a crash left.
"""

from __future__ import annotations

import json
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: States of a transaction, in order; any but the last may also become FAILED, from which recovery goes on (fixed values).
PREPARED, PUBLISHING, COMPLETED, FAILED = "Prepared", "Publishing", "Completed", "FailedRecoverable"


class PublishError(ValueError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


class Store:
    """Small documents and folders below a root of any of Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, jvm = spark, root.rstrip("/"), spark._jvm
        self.Path, conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self.fs = self.Path(self.root).getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename

    def path(self, name: str):
        return self.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> dict | None:
        """A document; None if there is none, an error if it is no JSON object."""
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError as error:
            raise PublishError("document-invalid", name) from error
        finally:
            stream.close()
        if not isinstance(found, dict):
            raise PublishError("document-invalid", name)
        return found

    def move(self, source: str, target: str, replace: bool = False) -> bool:
        """Rename; False if the target is there and must not be replaced."""
        options = self.spark._sc._gateway.new_array(self._rename, 1)
        options[0] = self._rename.OVERWRITE if replace else self._rename.NONE
        try:
            self.context.rename(self.path(source), self.path(target), options)
        except Py4JJavaError as error:
            if not replace and "FileAlreadyExistsException" in str(error.java_exception.toString()):
                return False
            raise
        return True

    def write(self, name: str, document: dict, replace: bool = False) -> bool:
        """A whole document under its name at once; False if there is one that must not be replaced."""
        draft = f"{name}.{uuid4().hex}.draft"
        self.fs.mkdirs(self.path(name).getParent())
        stream = self.fs.create(self.path(draft), True)
        stream.write(bytearray(json.dumps(document, sort_keys=True, indent=1).encode()))
        stream.close()
        if self.move(draft, name, replace):
            return True
        self.drop(draft)
        return False

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """file (its path below the folder), bytes and sha256 of the files below a folder, hashed on the executors. Files of
    2 GB or more can't be hashed so; Spark's writers make smaller ones when told so (``maxRecordsPerFile``)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _facts(store: Store, folder: str, outputs) -> dict[str, list]:
    """Of each output its files' facts; their number is that of the tasks that wrote them."""
    return {name: [list(r) for r in file_facts(store.spark, f"{store.root}/{folder}/{name}").orderBy("file").collect()] for name in outputs}


class Run:
    """One run's way to its commit; each step can be repeated after a crash."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        if not run_id or "/" in run_id or run_id.startswith("."):
            raise PublishError("run-id-invalid", run_id)
        self.store, self.run_id = Store(spark, root), run_id
        self.transaction, self.descriptor = f"runs/{run_id}.transaction.json", f"runs/{run_id}.commit.json"

    def stage(self, outputs: dict[str, DataFrame], formats: dict[str, tuple[str, dict]] | None = None) -> dict:
        """Write and hash all outputs, then bind them: the transaction is prepared, and nothing of it is visible."""
        attempt = uuid4().hex
        folder, described = f"staging/{self.run_id}-{attempt}", {}
        for name, df in outputs.items():
            kind, options = (formats or {}).get(name, ("parquet", {}))
            df.write.format(kind).options(**options).save(f"{self.store.root}/{folder}/{name}")
            described[name] = {"format": kind, "options": options, "schema": df.schema.jsonValue()}
        for name, files in _facts(self.store, folder, outputs).items():
            described[name]["files"] = files
        document = {"state": PREPARED, "staging": folder, "descriptor": {"run_id": self.run_id, "data": f"data/{self.run_id}-{attempt}", "outputs": described}}
        self.store.write(self.transaction, document, replace=True)
        return document

    def _to(self, document: dict, state: str) -> dict:
        document = document | {"state": state}
        self.store.write(self.transaction, document, replace=True)
        return document

    def commit(self, document: dict, latest: bool = True) -> dict:
        """From a prepared transaction to the committed descriptor and the latest pointer."""
        store, descriptor = self.store, document["descriptor"]
        try:
            document = self._to(document, PUBLISHING)
            if store.exists(document["staging"]):
                store.fs.mkdirs(store.path("data"))
                store.move(document["staging"], descriptor["data"])
            if not store.write(self.descriptor, descriptor) and store.read(self.descriptor) != descriptor:
                raise PublishError("run-committed", "the run has another commit")
            if latest:
                point_to(store, self.run_id)
        except BaseException:
            self._to(document, FAILED)
            raise
        self._to(document, COMPLETED)
        return descriptor

    def publish(self, outputs: dict[str, DataFrame], formats: dict[str, tuple[str, dict]] | None = None, latest: bool = True) -> dict:
        """All outputs as one unit; a run is committed once."""
        if self.store.exists(self.descriptor):
            raise PublishError("run-committed")
        return self.commit(self.stage(outputs, formats), latest)

    def recover(self, latest: bool = True) -> str:
        """Finish a bound transaction whose files are whole, or clear what no transaction binds; ``Missing``, ``Completed`` or
        an error. No other publisher of this run may be at work."""
        store, document = self.store, self.store.read(self.transaction)
        bound = set() if document is None else {document["staging"], document["descriptor"]["data"]}
        for parent in ("staging", "data"):
            for name in store.names(parent):
                if name.rpartition("-")[0] == self.run_id and f"{parent}/{name}" not in bound:
                    store.drop(f"{parent}/{name}")
        if document is None:
            return "Missing"
        descriptor = document["descriptor"]
        folder = document["staging"] if store.exists(document["staging"]) else descriptor["data"]
        if issues(store, descriptor, folder):
            self._to(document, FAILED)
            raise PublishError("staged-files-invalid", self.run_id)
        if document["state"] != COMPLETED:
            self.commit(document, latest)
        return COMPLETED


def issues(store: Store, descriptor: dict, folder: str | None = None) -> list[tuple[str, str]]:
    """(file, code) of a descriptor's files that are missing or differ, by length and hash."""
    folder, out = folder or descriptor["data"], []
    for name, output in descriptor["outputs"].items():
        there = {f: (size, sha) for f, size, sha in _facts(store, folder, [name])[name]} if store.exists(f"{folder}/{name}") else {}
        for f, size, sha in output["files"]:
            if f not in there:
                out.append((f"{name}/{f}", "metadata-commit-file-missing"))
            elif there[f] != (size, sha):
                out.append((f"{name}/{f}", "metadata-commit-hash-mismatch"))
    return out


def latest_run(store: Store) -> tuple[int, str | None]:
    """Number and run of the latest pointer; 0 and None if there is none."""
    numbers = [int(n[:-5]) for n in store.names("latest") if n.endswith(".json") and n[:-5].isdigit()]
    return (max(numbers), store.read(f"latest/{max(numbers):09}.json")["run_id"]) if numbers else (0, None)


def point_to(store: Store, run_id: str, seen: int | None = None) -> int:
    """Make a committed run the latest, if the pointer still has the number ``seen`` (by default, whatever it has now)."""
    if not store.exists(f"runs/{run_id}.commit.json"):
        raise PublishError("metadata-commit-missing", run_id)
    number, current = latest_run(store)
    if current == run_id:
        return number
    seen = number if seen is None else seen
    if seen != number or not store.write(f"latest/{seen + 1:09}.json", {"run_id": run_id}):
        raise PublishError("latest-moved", f"the pointer is no longer at {seen}")
    return seen + 1


def read_run(spark: SparkSession, root: str, output: str, run_id: str | None = None, verify: bool = False) -> DataFrame:
    """An output of a committed run, by default the latest: exactly the files that its descriptor lists."""
    store = Store(spark, root)
    run_id = run_id or latest_run(store)[1]
    descriptor = store.read(f"runs/{run_id}.commit.json") if run_id else None
    if descriptor is None:
        raise PublishError("metadata-commit-missing", str(run_id))
    if verify and (found := issues(store, descriptor)):
        raise PublishError(found[0][1], found[0][0])
    told = descriptor["outputs"][output]
    schema, files = StructType.fromJson(told["schema"]), [f"{store.root}/{descriptor['data']}/{output}/{f}" for f, _, _ in told["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.format(told["format"]).options(**told["options"]).schema(schema).load(files)
