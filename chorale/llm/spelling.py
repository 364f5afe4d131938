"""Spelling variants: words one edit apart, by bands of letter-parity bitmasks.

A word's mask has a bit for each letter, set if the letter stands in it an odd number of times. One edit flips at most two
bits, so of three bands of the mask one at least is equal in both words. Words with an equal band are joined if their
lengths differ by one at most and what the edit leaves alone, two thirds of the word, is equal too; then they are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, id_text, let

#: Runs of letters, of which only A-Z are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of so many occurrences has a code point deleted.
ODDS = 199
#: Words have so many code points and occurrences at least; a form has RATIO times the occurrences of its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
BANDS, PARTS = 3, 3


def damaged_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of all documents with a fixed damage, however short or rare. A null text has none."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))
    each = docs.select(id_text(doc_id).alias("d"), F.explode(runs).alias("w"))
    h = F.crc32(F.concat("d", F.lit(":"), "w"))
    cut = h % F.length("w")
    hit = F.concat(F.substring("w", F.lit(1), cut.cast("int")), F.substring("w", cut.cast("int") + 2, F.length("w")))
    return each.select(F.when(h % ODDS == 0, hit).otherwise(F.col("w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def masks(word: Column) -> Column:
    """The bands of a word's letter-parity mask, as an array: a letter's place in the alphabet decides its band and bit."""
    places = F.transform(F.split(word, ""), lambda c: let(F.ascii(c), lambda p: F.when(p < 128, p - ord("a")).otherwise(p - 0xC0 + 26)))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(p / BANDS).cast("int"))
    band = lambda ps, b: F.aggregate(F.filter(ps, lambda p: p % BANDS == b), F.lit(0).cast("long"), lambda m, p: m.bitwiseXOR(bit(p)))
    return let(places, lambda ps: F.array(*[band(ps, b) for b in range(BANDS)]))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: each pair of different words that one inserted, deleted or replaced code point makes equal, once, ``a`` before ``b``.

    ``words`` has distinct words, of letters of RUN in lower case. A pair is looked for where its greater length is m: both words
    stand in the buckets (named by 64 bits) of their length and of one more, for each band and for each of PARTS parts of the
    first or last m - 1 code points, with the others. The edit touches one part, so a pair meets where this part is left out.
    """
    sized = words.select("word", F.length("word").alias("size"), masks(F.col("word")).alias("masks"))
    shared, part = F.col("m") - 1, F.col("k") % PARTS
    start, end = (((shared * (part + i)) / PARTS).cast("int") for i in (0, 1))
    rest = F.concat(F.substring("word", F.lit(1), start), F.lit(" "), F.substring("word", F.col("size") - (shared - end) + 1, shared - end))
    keyed = (
        sized.withColumn("m", F.explode(F.array("size", F.col("size") + 1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PARTS * BANDS - 1))))
        .select("word", F.xxhash64("k", "m", F.get("masks", (F.col("k") / PARTS).cast("int")), rest).alias("bucket"))
    )
    met = keyed.withColumnRenamed("word", "a").join(keyed.withColumnRenamed("word", "b"), "bucket")
    return met.where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words with their occurrences ``n``.

    A word's form is its near word of largest n (of equal ones the least), if that is ``ratio`` (2 at least) times its own or
    more; its root follows the forms to the last. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    counted = durable(words.select("word", "n"))
    pairs = near_pairs(counted)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")
    ranked = both.join(counted.withColumnRenamed("word", "near"), "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    best_n = -F.col("best.less")
    judged = counted.join(ranked, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(best_n >= ratio * F.col("n"), F.col("best.near")).alias("form"), F.when(best_n >= ratio * F.col("n"), best_n).alias("form_n"))
    judged = durable(judged)
    roots = judged.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken; counts grow by ratio with each step, so there are few
        roots = durable(roots)
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            break
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_digest(docs: DataFrame) -> DataFrame:
    """``variants`` of the frequent longer words of all documents, after ``damaged_words``. Null and empty texts have no words, a
    missing id is the empty text, repeated rows count each, long texts count whole, other columns are left out."""
    words = damaged_words(docs.select("doc_id", "text")).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))
    return variants(words)


#: The same in DuckDB: near words share what is left when one code point is taken out of one of them, or of both at one place.
VARIANTS_SQL = r"""
WITH RECURSIVE steps AS (SELECT i AS byte, 0 AS step, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE step < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM steps WHERE step = 8),
occ AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
own AS (SELECT d, w, count(*) AS n FROM occ GROUP BY ALL),
coded AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(d || ':' || w)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM own, crc),
w AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, sum(n)::BIGINT AS n FROM coded GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, cut.word, cut.n FROM w JOIN cut ON w.word = cut.rest UNION SELECT cut.word, w.word, w.n FROM w JOIN cut ON w.word = cut.rest),
best AS (SELECT word, count(*) AS n_near, min({'less': -n, 'form': other}) AS b FROM near GROUP BY word),
j AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 5 * w.n THEN b.form END AS form, CASE WHEN -b.less >= 5 * w.n THEN -b.less END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM j UNION ALL SELECT chain.word, j.form FROM chain JOIN j ON chain.root = j.word WHERE j.form IS NOT NULL)
SELECT j.word, form, root, j.n, n_near, form_n FROM j JOIN (SELECT chain.word, chain.root FROM chain JOIN j last ON chain.root = last.word WHERE last.form IS NULL) r ON j.word = r.word
"""
