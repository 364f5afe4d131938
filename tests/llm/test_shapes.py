"""Every operator on missing values, empty and long texts, repeated rows, empty tables and clashing column names."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.llm import langid, lmscore, mixing, neardup, packing, quality, sharding, tokencount, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, "the cat sat on the mat and the dog ran off to the park today", "en", "a", 60),
    (4, "the cat sat on the mat and the dog ran off to the park today", "en", "a", 60), (5, "THE CAT sat on the mat and the dog ran off to the park today", None, "b", 60),
    (None, "der hund und die katze sind im garten und spielen dort den ganzen tag", "de", None, 70), (6, LONG, "en", "b", len(LONG)), (7, "12345 !!! ###", "de", "b", 13), (8, "ü", "de", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


OPERATORS = {
    "sharding": sharding.shard_documents, "mixing": mixing.mix, "quality": quality.keep_good, "tokens": tokencount.count_tokens, "language": langid.keep_identified, "neardup": neardup.keep_one,
    "packing": packing.pack, "scores": lmscore.score_documents, "identify": langid.identify,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(docs, name):
    clash = docs.withColumns({c: F.lit("kept") for c in ("_key", "_size", "_rate", "_stats", "_found", "_gone", "_tokens", "copy", "size", "key", "name", "set_key", "chunk", "_alike", "_earlier", "_range", "_row", "lang_pred", "score", "tag", "N_Copies")})
    out = OPERATORS[name](clash)
    rows = out.collect()
    assert rows
    if "_key" in out.columns:
        assert {r["_key"] for r in rows} == {"kept"} and {r["chunk"] for r in rows} == {"kept"}


def test_columns_pass_through_unchanged(docs):
    clash = docs.withColumns({"score": F.lit(-7.0), "lang_pred": F.lit("mine"), "_stats": F.col("n_chars"), "tag": F.lit(3), "set_key": F.lit(4)})
    for stage in (langid.keep_identified, quality.keep_good, neardup.keep_one, mixing.mix):
        out = stage(clash)
        rows = out.collect()
        assert out.columns == clash.columns and rows and {(r["score"], r["lang_pred"], r["tag"], r["set_key"]) for r in rows} == {(-7.0, "mine", 3, 4)}


def test_no_letter_is_no_language(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(9)] + [(20, "½ ² ①", None), (21, "Ⅷ ①", None), (22, "x½y", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[20] == got[21] == ("und", 0.0) and got[22][0] == "en" and langid.words_of("x½y Ⅷab") == ["x", "y", "ab"]


def test_one_row_stays_of_each_group(spark):
    """Ids that stand on several texts, repeated rows and missing ids."""
    same, other, third = ("one two three four five six seven", "some wholly other text of seven words", "a third text that nobody else has here")
    rows = [(3, same), (7, same), (7, other), (7, other), (None, same), (None, third), (None, third), (9, other), (5, ""), (5, "")]
    kept = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert kept == sorted([(3, same), (7, other), (None, third), (5, ""), (5, "")], key=repr)


def test_shards_are_written(spark, docs, tmp_path):
    sharded = sharding.shard_documents(docs, 3)
    sharding.write_shards(sharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: repr((r["doc_id"], r["text"], r["shard"], r["slot"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, sharded.collect()))


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from chorale.llm.common import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://head:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_shards_are_gapless_and_even(spark, docs):
    many = docs.where("doc_id <> 6").crossJoin(spark.range(40).select(F.col("id").alias("n")))
    rows = sharding.shard_documents(many).collect()
    assert len(rows) == many.count()
    size = lambda r: len((r["text"] or "").encode()) + 1
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(8))
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sums = [sum(map(size, v)) for v in by.values()]
    assert max(sums) - min(sums) <= 2 * max(map(size, rows)) + 0.02 * sum(sums) / 8


def test_one_text_fills_the_table(spark):
    rows = sharding.shard_digest(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))).groupBy("shard").count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) - min(r["count"] for r in rows) <= 2


def test_equal_texts_stay_together(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.floor(F.col("id") / 3)).alias("text"))
    assert sharding.shard_digest(df).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() <= 7


def test_poisson_quantile(spark):
    import math

    df = spark.createDataFrame([(u, m) for u in (0.0, 0.2, 0.5, 0.9, 0.999999) for m in (0.1, 1.0, 7.5, 16.0)], "u double, m double")
    for r in df.select("u", "m", mixing.poisson_quantile(F.col("u"), F.col("m")).alias("n")).collect():
        n, cum, term = 0, math.exp(-r["m"]), math.exp(-r["m"])
        while cum <= r["u"]:
            n += 1
            term *= r["m"] / n
            cum += term
        assert r["n"] == n


def test_mix_meets_weights_and_repeats(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), "id").alias("text"), F.when(F.col("id") < 5000, "big").otherwise("small").alias("source"))
    once, again = (mixing.mix(df, {"big": 1.0, "small": 1.0}, numbered=True).collect() for _ in range(2))
    assert sorted(once) == sorted(again)
    counts = {s: sum(r["source"] == s for r in once) for s in ("big", "small")}
    assert abs(counts["big"] - 3000) < 250 and abs(counts["small"] - 3000) < 250
    high = mixing.mix(df.where("doc_id < 50"), {"big": 1.0}, epochs=40.0).count()  # means beyond one slice
    assert abs(high - 2000) < 200


def test_near_duplicates_of_odd_rows(docs):
    rows = neardup.near_duplicates(docs).collect()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 11, 4), (5, 11, 4), (7, 1, 7), (8, 1, 8)} <= got and len(rows) == len(ROWS)
    kept = neardup.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1, 2, 3, 4, 6, 7, 8] and sum(r["doc_id"] is None for r in kept) == 1


def test_language_of_odd_rows(docs):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0)
    assert got[4] == got[5] and got[6][0] == "en" and all(0 <= s <= 1 for _, s in got.values())


def test_language_model_knows_every_word_and_ngram(docs):
    model = langid.fit(docs)
    words = sorted({w for r in ROWS if r[0] in (4, 8) for w in r[1].split()})
    assert set(model["keys"][0].tolist()) == set(map(langid.word_key, words))
    for n in range(1, langid.LONGEST + 1):
        grams = sorted({p[i : i + n] for w in words for p in [f" {w} "] for i in range(len(p) - n + 1)})
        own = lambda g: int(langid.gram_keys(langid.padded_points([g])[0][1:-1], n)[0])
        assert sorted(model["keys"][n].tolist()) == sorted({own(g) for g in grams}) and len(model["keys"][n]) == len(grams)


def test_language_of_long_unbroken_runs(spark):
    """The fit and the scores are linear in a word's length: a run of three million letters takes seconds."""
    run = "".join(chr(97 + (i * i) % 26) for i in range(3_000_000))
    rows = [(i, "the cat sat on the mat and the dog ran off", "en") for i in range(20)] + [(i, "der hund und die katze sind im garten", "de") for i in range(20, 40)]
    rows += [(100, run, "en"), (101, run, "en"), (102, run[1:], None), (103, f"der hund {run[:50]}", None)]
    began = time.time()
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == got[102] == "en" and got[0] == "en" and got[20] == "de" and time.time() - began < 60


def test_language_sample_is_bounded_in_characters(spark, monkeypatch):
    own = lambda i: "".join(chr(97 + int(d)) for d in str(1000 + i))
    rows = [(i, own(i) + " the cat sat on the mat" * 40, "en") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(table)["keys"][0]) > 300
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 20_000)
    assert 5 < len(langid.fit(table)["keys"][0]) < 80


def test_language_of_few_documents_wins_nothing_unseen(spark):
    rows = [(i, "the cat sat on the mat and the dog ran off", "en") for i in range(50)] + [(i, "hund", "de") for i in range(50, 53)] + [(100, "the dog sat wandering thereupon", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id = 100").first()
    assert got["lang_pred"] == "en"


def test_every_labelled_language_is_known(spark, monkeypatch):
    own = lambda i: " ".join(chr(0x4E00 + 100 * i + k) + chr(0x4E00 + 100 * i + k + 1) for k in range(20))
    rows = [(i, own(i), f"l{i:02}") for i in range(1000) if i < 80 and zlib.crc32(str(i).encode()) % langid.FOLDS] + [(1000 + i, own(90) + f" {i}", "big") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table, sample_docs=4)
    assert set(model["langs"]) == {r[2] for r in rows} and len(model["langs"]) > 64 and set(model["at"]) == set(range(len(model["langs"])))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    monkeypatch.setattr(langid, "LANGUAGES", 60)
    with pytest.raises(ValueError, match="60 languages"):
        langid.fit(table)


def test_quality_of_odd_rows(docs):
    got = {r["doc_id"]: r for r in quality.quality_digest(docs).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"]
    assert got[4]["kept"] and got[6]["n_words"] == 120_000 and got[7]["n_symbols"] == 3


URLS = [
    ("http://WWW.Example.com/en/71?q#f", "www.example.com", "/en/71", "example.com/en/7", "allow"), ("https://a.example.com/en/6", "a.example.com", "/en/6", "com/en/", "block"),
    ("x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"), ("x://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), ("x://net/de/", "net", "/de/", "net/de/", "allow"),
    ("no scheme casino", "", "", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://casinos.io/", "casinos.io", "/", None, "allow"), ("http://x-casino.io", "x-casino.io", "", None, "block"),
    ("http://free.io/free?free", "free.io", "/free", None, "allow"), ("http://free.io/bets", "free.io", "/bets", None, "block"), ("http://h?a://b/c", "h", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in urls.judge_urls(df).collect():
        assert (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"]]
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_terms_are_loaded(spark):
    rows = [(" Casino ", 2.0), ("casino", 0.5), ("free", 0.4), ("bonus", 0.9), ("", 1.0), (None, 1.0), ("none", None), ("off", 0.0)]
    strict, soft = urls.load_terms(spark.createDataFrame(rows, "term string, weight double"))
    assert (strict, soft) == (("casino",), ("bonus", "free"))
    df = spark.createDataFrame([(1, "http://x.io/Casino"), (2, "http://x.io/free"), (3, "http://free.io/bonus")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge_urls(df, strict=strict, soft=soft).collect()} == {1: "block", 2: "allow", 3: "block"}
    with pytest.raises(ValueError, match="2 terms"):
        urls.load_terms(spark.createDataFrame(rows, "term string, weight double"), most=2)


def test_clashing_columns_and_long_urls(spark):
    long = "http://example.org/" + "a" * 100_000 + "/casino"
    df = spark.createDataFrame([(1, long), (2, "http://com/en/x")], "page_id long, url string").withColumns({c: F.lit("kept") for c in ("_hits", "_host", "_path", "_rule", "_url", "verdict", "RULE", "n_strict")})
    got = {r["page_id"]: r for r in urls.judge_urls(df).collect()}
    assert got[1]["verdict"] == "block" and got[1]["_hits"] == "kept" and got[2]["rule"] == "com/en/" and len(got[1]["path"]) == 100_008


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, float("nan")]), (4, None), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 2.0]), (8, [0.001, -0.001]), (9, [])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3).orderBy("query_id", "rank").collect()]
    assert got[0] == (0, 1, 1, 65536 * 5) and {g[2] for g in got} == {1, 2, 8}
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
