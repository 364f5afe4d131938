"""The SQLite data source: ranges, filters, odd tables."""

import sqlite3

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from chorale.sources import sqlite

DDL = "id long, name string, size long, body binary"


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "a b.db")
    db = sqlite3.connect(path)
    db.execute('CREATE TABLE "t""x" (name TEXT COLLATE NOCASE, size INTEGER, body BLOB)')
    db.executemany('INSERT INTO "t""x" (rowid, name, size, body) VALUES (?, ?, ?, ?)', [(i * 7 - 50, None if i % 5 == 0 else f"{'N' if i % 2 else 'n'}{i % 10}", i if i % 3 else None, bytes([i % 256]) * i) for i in range(100)])
    db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID")
    db.executemany("INSERT INTO keyed VALUES (?, ?)", [(f"k{i}", i) for i in range(20)])
    db.execute("CREATE TABLE empty (k TEXT)")
    db.execute("CREATE VIRTUAL TABLE found USING fts5(text)")
    db.execute("CREATE VIEW seen AS SELECT k FROM keyed WHERE n > 9")
    db.commit()
    db.close()
    return path


def reader(path, **more):
    return sqlite.SqliteReader({"path": path, "table": 't"x', "rowid": "id", "range": "100", **more}, _parse_datatype_string(DDL))


def test_ranges_hold_every_row_once(spark, path):
    got = sqlite.read_table(spark, path, 't"x', DDL, rowid="id", rows=100)
    rows = got.collect()
    assert got.rdd.getNumPartitions() == 7 and [r["id"] for r in rows] == [i * 7 - 50 for i in range(100)]
    assert all(r["body"] == bytes([i % 256]) * i and r["size"] == (i if i % 3 else None) for i, r in enumerate(rows))


@pytest.mark.parametrize("test", ["id = 13", "id > 600", "id >= 13 AND id < 300", "id <= -50", "id = 14", "name = 'n2'", "name >= 'N' AND name < 'n'", "size IN (1, 2, 50)", "name IS NULL", "size IS NOT NULL AND size > 90", "id = 13 OR size = 4", "id IN (13, 20)", "name LIKE 'n%'"])
def test_filters_equal_spark(spark, path, test):
    table = sqlite.read_table(spark, path, 't"x', DDL, rowid="id", rows=100)
    plain = spark.createDataFrame(table.collect(), DDL)
    assert sorted(map(tuple, table.where(test).select("id", "name", "size").collect())) == sorted(map(tuple, plain.where(test).select("id", "name", "size").collect())) if "NULL" not in test else table.where(test).count() == plain.where(test).count()


def test_a_lookup_by_id_reads_one_range(path):
    r = reader(path)
    left = list(r.pushFilters([D.IsNotNull(("id",)), D.EqualTo(("id",), 13)]))
    assert len(left) == 2 and [(p.first, p.last) for p in r.partitions()] == [(13, 13)]
    assert [b.num_rows for p in r.partitions() for b in r.read(p)] == [1]
    r = reader(path)
    list(r.pushFilters([D.GreaterThan(("id",), 5), D.LessThanOrEqual(("id",), 90)]))
    assert [(p.first, p.last) for p in r.partitions()] == [(6, 90)]
    r = reader(path)
    list(r.pushFilters([D.EqualTo(("id",), 10_000)]))
    assert [b for p in r.partitions() for b in r.read(p)] == []


def test_wide_gaps_of_ids_make_no_more_ranges(path, tmp_path):
    db = sqlite3.connect(tmp_path / "wide.db")
    db.execute("CREATE TABLE w (x TEXT)")
    db.executemany("INSERT INTO w (rowid, x) VALUES (?, ?)", [(1, "a"), (1 << 62, "b")])
    db.commit()
    db.close()
    r = sqlite.SqliteReader({"path": str(tmp_path / "wide.db"), "table": "w", "rowid": "id"}, _parse_datatype_string("id long, x string"))
    ranges = r.partitions()
    assert len(ranges) <= sqlite.RANGES and sum(b.num_rows for p in (ranges[0], ranges[-1]) for b in r.read(p)) == 2


def test_tables_without_rows_or_row_ids(spark, path):
    assert sqlite.read_table(spark, path, "empty", "k string").count() == 0
    keyed = sqlite.read_table(spark, path, "keyed", "k string, twice long", {"twice": "n * 2"})
    assert keyed.count() == 20 and keyed.agg(F.sum("twice")).first()[0] == 380 and keyed.where("twice = 8").first()["k"] == "k4"
    assert sqlite.read_table(spark, path, "seen", "k string").count() == 10
    with pytest.raises(Exception, match="no such table"):
        sqlite.read_table(spark, path, "nowhere", "k string").count()


def test_objects_tell_virtual_tables_apart(path):
    kinds = {o["name"]: o["type"] for o in sqlite.sqlite_schema(path)}
    assert kinds["found"] == "virtual" and kinds["keyed"] == "table" and kinds["seen"] == "view"
