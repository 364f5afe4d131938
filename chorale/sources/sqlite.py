"""SQLite tables as a Spark data source: ranges of row ids, read on the executors from a file opened read-only.

The driver asks a file for its least and largest row id only. Tasks open the file by its path, so it must be in a folder
that all of them see as a local one.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import schema as contract

#: Row ids of a range, ranges at most (of more row ids each has more), and rows that a task holds at once.
RANGE, RANGES, FETCH = 100_000, 10_000, 512
FORMAT = "sqlite_table"


def opened(path: str) -> closing:
    """A connection that neither writes nor locks; closed at the end of its ``with``."""
    return closing(sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Rows(D.InputPartition):
    """Rows of ids from ``first`` to ``last``; all rows, of a table without row ids."""

    first: int | None = None
    last: int | None = None

    def __post_init__(self):
        super().__init__((self.first, self.last))


#: Comparisons that SQLite makes as Spark does, given bytewise collation.
_COMPARED = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


class SqliteReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.kinds = options["path"], quoted(options["table"]), to_arrow_schema(schema)
        own = json.loads(options.get("columns") or "{}")
        self.columns = {f.name: own.get(f.name, quoted(f.name)) for f in schema.fields}
        self.rowid = options.get("rowid")
        if self.rowid:
            self.columns[self.rowid] = "rowid"
        self.range = int(options.get("range", RANGE))
        self.low, self.high = -(1 << 63), (1 << 63) - 1
        self.tests: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Row ids narrow the ranges, other plain comparisons are SQLite's; Spark makes all of them again."""
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            column = self.columns.get(name)
            plain = isinstance(value, (int, str)) and not isinstance(value, bool)
            if column == "rowid" and type(f) in _COMPARED and isinstance(value, int):
                if not isinstance(f, (D.LessThan, D.LessThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, D.GreaterThan))
                if not isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, D.LessThan))
            elif column and type(f) in _COMPARED and plain:
                self.tests.append((f"{column} COLLATE BINARY {_COMPARED[type(f)]} ?", [value]))
            elif column and isinstance(f, D.In) and all(isinstance(v, (int, str)) and not isinstance(v, bool) for v in value) and len(value) <= 500:
                self.tests.append((f"{column} COLLATE BINARY IN ({', '.join('?' * len(value))})", list(value)))
            elif column and isinstance(f, (D.IsNull, D.IsNotNull)):
                self.tests.append((f"{column} IS {'NOT ' * isinstance(f, D.IsNotNull)}NULL", []))
            yield f

    def partitions(self) -> list[Rows]:
        with opened(self.path) as db:
            try:
                first, last = db.execute(f"SELECT (SELECT min(rowid) FROM {self.table}), (SELECT max(rowid) FROM {self.table})").fetchone()
            except sqlite3.OperationalError as error:
                if "no such column" not in str(error):
                    raise
                return [Rows()]
            if first is None and db.execute(f"SELECT 1 FROM {self.table} LIMIT 1").fetchone():
                return [Rows()]  # a view's row ids are null
        if first is None or max(first, self.low) > min(last, self.high):
            return [Rows(1, 0)]
        first, last = max(first, self.low), min(last, self.high)
        step = max(self.range, -(-(last - first + 1) // RANGES))
        return [Rows(a, min(a + step - 1, last)) for a in range(first, last + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        tests = list(self.tests)
        if partition.first is not None:
            tests.append(("rowid BETWEEN ? AND ?", [partition.first, partition.last]))
        where = f" WHERE {' AND '.join(f'({t})' for t, _ in tests)}" if tests else ""
        with opened(self.path) as db:
            found = db.execute(f"SELECT {', '.join(self.columns.values()) or '1'} FROM {self.table}{where}", [v for _, own in tests for v in own])
            while rows := found.fetchmany(FETCH):
                yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), self.kinds.types)], schema=self.kinds)


class SqliteTable(D.DataSource):
    """Options: path, table, columns (JSON: SQL of schema columns that aren't named like the table's), rowid (the schema column
    that is the row id), range (row ids of a task)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("give the schema of the table")

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)


def read_table(spark: SparkSession, path: str, table: str, schema: StructType | str, columns: dict[str, str] | None = None, rowid: str | None = None, rows: int = RANGE) -> DataFrame:
    """A table of an SQLite file. Values must be of the schema's types or null; an empty table has no rows.

    Filters on the row id make for fewer ranges, so a lookup by it reads one row.
    """
    spark.dataSource.register(SqliteTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses a reader that takes filters
    reader = spark.read.format(FORMAT).schema(schema).option("path", path).option("table", table).option("range", str(rows))
    if columns:
        reader = reader.option("columns", json.dumps(columns))
    return (reader.option("rowid", rowid) if rowid else reader).load()


def read_sqlite(spark: SparkSession, path: str, name: str, table: str, columns: dict[str, str] | None = None, rowid: str | None = None, rows: int = RANGE) -> DataFrame:
    """One table of an SQLite file with the columns that the contract has for ``name``."""
    return read_table(spark, path, table, contract(name), columns, rowid, rows)


def conversation_tables(path: str) -> list[str]:
    """Message tables of an SQLite file: ``Msg_`` and 32 hex digits."""
    import re

    with opened(path) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name COLLATE NOCASE")]
    return [n for n in names if re.fullmatch(r"Msg_[0-9a-f]{32}", n)]


def sqlite_schema(path: str) -> list[dict]:
    """Objects of an SQLite file with their columns, indexes and their columns, foreign keys and triggers; tables first, then
    views, hidden ones left out. Virtual tables are of type ``virtual``."""
    with opened(path) as db:
        found = db.execute("SELECT CASE WHEN type = 'table' AND upper(ltrim(sql)) LIKE 'CREATE VIRTUAL%' THEN 'virtual' ELSE type END, name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY type = 'view', name COLLATE NOCASE").fetchall()
        return [{
            "type": kind, "name": name,
            "columns": [{"name": c[1], "type": c[2], "not_null": bool(c[3]), "default": c[4], "key": c[5], "hidden": c[6]} for c in db.execute(f"PRAGMA table_xinfo({quoted(name)})")],
            "indexes": [{"name": i[1], "unique": bool(i[2]), "columns": [c[2] for c in db.execute(f"PRAGMA index_xinfo({quoted(i[1])})") if c[5]]} for i in db.execute(f"PRAGMA index_list({quoted(name)})").fetchall()],
            "foreign_keys": [{"table": f[2], "from": f[3], "to": f[4], "on_update": f[5], "on_delete": f[6]} for f in db.execute(f"PRAGMA foreign_key_list({quoted(name)})")],
            "triggers": [t[0] for t in db.execute("SELECT name FROM sqlite_master WHERE type = 'trigger' AND tbl_name = ? ORDER BY name COLLATE NOCASE", (name,))],
        } for kind, name in found]


#: Settings of a file that its description holds (fixed values).
PRAGMAS = ("user_version", "application_id", "page_size", "page_count", "encoding", "journal_mode")


def sqlite_pragmas(path: str) -> dict:
    with opened(path) as db:
        return {p: db.execute(f"PRAGMA {p}").fetchone()[0] for p in PRAGMAS}
