"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from chorale.plans import export_queries, message_queries, registry, verification_queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else repr(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(plain(x) for x in r) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == expected


def test_cache_times_round_as_in_sql(spark, tmp_path):
    """A line's time counts in whole seconds, the nearest ones: half a second before the limit is still alive."""
    times = ["08 23:59:58.5", "08 23:59:59", "08 23:59:59.499999", "08 23:59:59.5", "08 23:59:59.500001", "08 23:59:59.999999", "09 00:00:00", "09 00:00:00.5"]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT n AS event_id, ts::TIMESTAMP AS ts, n AS user_id, 'view' AS event_type, 50.0::DOUBLE AS value FROM (VALUES {', '.join(f"({6 * i + 1}::BIGINT, '2024-01-{x}')" for i, x in enumerate(times))}) v(n, ts)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    cursor = con.execute(registry.ORACLE_SQL["q_cache_compaction"])
    names = [d[0] for d in cursor.description]
    got = sorted(tuple(r[c] for c in names) for r in registry.QUERIES["q_cache_compaction"](spark, str(tmp_path)).collect())
    assert got == sorted(cursor.fetchall()) and [r[names.index("stale")] for r in got] == [1, 1, 1, 0, 0, 0, 0, 0]
