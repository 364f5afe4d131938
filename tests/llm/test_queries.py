"""Registered queries of this package against their SQL, and the pipeline's stages on a small table."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from chorale.llm import langid, mixing, neardup, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, FOLDER)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, FOLDER).cache()
        assert kept.columns == docs.columns and kept.join(before, "doc_id", "left_anti").count() == 0 and 0 < kept.count() <= before.count()
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(kept).collect()}
    assert all(k == v for k, v in found.items())
    mixed = mixing.mix(kept)
    expected = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    got: dict = {}
    for r in whole:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        tokens = r["doc_tokens"]
        assert r["length"] <= 2048 and tokens >= r["length"]
    size = {r["doc_id"]: r["doc_tokens"] for r in whole}
    assert sorted(k for k, n in got.items() for _ in range(n // size[k])) == [k for k, _ in expected]


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("n_chars > 40")
    assert langid.keep_identified(docs).count() >= docs.count() - 2
