"""Quality rules as weak supervision.

Rules read a document's statistics and vote good (1), bad (-1) or abstain (0). The votes' patterns are counted over all
documents; expectation-maximisation on these counts (at most 3 to the number of rules) estimates how often each rule is
right about good and about bad documents. A document is kept by its posterior probability of being good, not by passing
every rule: a rule whose bad votes no other rule shares is found to err and is outvoted. Everything is DataFrame
expressions; the estimation is one fold over an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, let

SPACE_CHARS = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: From the first character that prose has not to the end of its word.
ODD = r"""[^\p{L}\p{M}\p{N}'\u2019.,;:!?()"\u00AB\u00BB\u201C\u201D\u201E\u2026\u00BF\u00A1\u2013\u2014\x20\x09-\x0D-][^\x20\x09-\x0D]*"""
#: A line that ends as a sentence does, quotes and brackets aside.
ENDED = r"[.!?:;\u2026\u3002][\"'\u00BB\u201D\u2019)\]]?$"
WINDOW = 5
ROUNDS = 25
#: Smallest posterior probability of a kept document.
LEAST = 0.5
#: The estimated probabilities of a right vote on good and on bad documents, and the share of good ones, stay in these
#: ranges, which only keep the logarithms finite and a rule no worse than chance on good documents (else classes could swap).
GOOD_RANGE, BAD_RANGE, SHARE_RANGE = (0.5, 0.9999), (0.01, 0.99), (0.01, 0.99)
#: Before any votes: right and wrong ones on good documents, on bad ones, and good and bad documents. They anchor tables of few
#: documents, where most are good and rules seldom err, and vanish in larger ones.
GOOD_PRIOR, BAD_PRIOR, SHARE_PRIOR = (9, 1), (1, 1), (9, 1)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_shouts", "n_odd_words", "n_ended_lines")


def words_of(text: Column) -> Column:
    """Array of the words, whole text, in order; none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{SPACE}+")))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            n = F.size(s)
            near = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"]))
            starts = F.sort_array(F.transform(F.filter(s, near), lambda x: x["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda a, i: F.struct((a["n"] + i + window - F.greatest(a["end"], i)).alias("n"), (i + window).alias("end"))
            return F.aggregate(starts, zero, step, lambda a: a["n"])

        return let(pairs, again)

    def hashed(h: Column) -> Column:
        last = F.size(h) - window
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return F.when(last < 1, F.lit(0)).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def text_stats(text: Column) -> Column:
    """Struct of STATS, all long."""
    value = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(value, F.lit(pattern))

    def with_words(words: Column) -> Column:
        lines = F.filter(F.split(value, "\n", -1), lambda line: F.trim(line, F.lit(SPACE_CHARS)) != "")
        ended = lambda line: F.substring(F.rtrim(line, F.lit(SPACE_CHARS)), -2, 2).rlike(ENDED)
        counted = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), F.size(F.array_distinct(ls)).alias("d"), F.size(F.filter(ls, ended)).alias("e")))
        return let(counted, lambda ls: F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.length(value) - count(SPACE)).cast("long").alias("word_chars"),
            count(SYMBOLS).cast("long").alias("n_symbols"),
            (ls["n"] - ls["d"]).cast("long").alias("n_dup_lines"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
            ls["n"].cast("long").alias("n_lines"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            count(r"\p{Lu}").cast("long").alias("n_upper"),
            count("!").cast("long").alias("n_shouts"),
            count(ODD).cast("long").alias("n_odd_words"),
            ls["e"].cast("long").alias("n_ended_lines"),
        ))

    return let(words_of(text), with_words)


def votes(s: Column) -> Column:
    """The rules' votes as an array of -1, 0 and 1."""
    n, chars, lines = (F.greatest(s[c], F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))

    def rule(measure: Column, good: Column, bad: Column, applies: Column | None = None) -> Column:
        vote = F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
        return F.when(applies, vote).otherwise(F.lit(0)) if applies is not None else vote

    symbols, upper, shouts = s["n_symbols"] / n, s["n_upper"] / chars, s["n_shouts"] / n
    variety, again, repeats, length = s["n_distinct_words"] / n, s["n_dup_lines"] / lines, s["n_repeat_words"] / n, s["word_chars"] / n
    odd, ended = s["n_odd_words"] / n, s["n_ended_lines"] / lines
    return F.array(
        rule(symbols, symbols < 0.05, symbols > 0.1),
        rule(upper, upper < 0.15, upper > 0.35, s["word_chars"] >= 20),
        rule(shouts, shouts < 0.1, shouts > 0.5),
        rule(variety, variety > 0.5, variety < 0.3, s["n_words"] >= 30),
        rule(again, again < 0.1, again > 0.3, s["n_lines"] >= 4),
        rule(repeats, repeats < 0.05, repeats > 0.15, s["n_words"] >= 10),
        rule(length, (length > 2) & (length < 15), (length < 1.2) | (length > 40), s["n_words"] >= 10),
        rule(odd, odd < 0.1, odd > 0.2, s["n_words"] >= 10),
        rule(ended, ended > 0.8, ended < 0.5, s["n_words"] >= 10),
    )


RULES = 9


def _estimate(patterns: Column) -> Column:
    """EM over array<struct<v array<int>, c double>>: struct of the share of good documents and, for each rule, the
    probability that a vote on a good document is good and that one on a bad document is bad."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    bounded = lambda x, low, high: F.greatest(low, F.least(F.lit(high), x))
    rules = F.sequence(F.lit(0), F.lit(RULES - 1))

    def maximise(q: Column) -> Column:
        def right(vote: int, good: bool) -> Column:
            weight, (low, high) = (lambda p, x: p["c"] * (x if good else 1 - x)), (GOOD_RANGE if good else BAD_RANGE)
            right_ones, wrong_ones = GOOD_PRIOR if good else BAD_PRIOR
            one = lambda r: bounded(
                (total(F.zip_with(patterns, q, lambda p, x: F.when(F.get(p["v"], r) == vote, weight(p, x)).otherwise(0.0))) + right_ones)
                / (total(F.zip_with(patterns, q, lambda p, x: F.when(F.get(p["v"], r) != 0, weight(p, x)).otherwise(0.0))) + right_ones + wrong_ones), F.lit(low), high)
            return F.transform(rules, one)

        share = (total(F.zip_with(patterns, q, lambda p, x: p["c"] * x)) + SHARE_PRIOR[0]) / (total(F.transform(patterns, lambda p: p["c"])) + sum(SHARE_PRIOR))
        return F.struct(bounded(share, F.lit(SHARE_RANGE[0]), SHARE_RANGE[1]).alias("share"), right(1, True).alias("good"), right(-1, False).alias("bad"))

    bad = lambda p: F.size(F.filter(p["v"], lambda x: x == -1))
    first = F.transform(patterns, lambda p: F.when(bad(p) == 0, 0.9).when(bad(p) == 1, 0.5).otherwise(0.1))  # one bad vote decides nothing

    step = lambda q: let(q, maximise)
    improve = lambda s, _: step(F.transform(patterns, lambda p: posterior(p["v"], s)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), step(first), improve)


def posterior(vote: Column, model: Column) -> Column:
    """Probability that a document with these votes is good."""
    def evidence(v, r):
        good, bad = F.get(model["good"], r), F.get(model["bad"], r)
        return F.when(v == 1, F.log(good / (1 - bad))).when(v == -1, F.log((1 - good) / bad)).otherwise(0.0)

    odds = F.aggregate(F.transform(vote, evidence), F.log(model["share"] / (1 - model["share"])), lambda a, b: a + b)
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame) -> Column | None:
    """The estimated model as a literal, from the votes ``v`` of all rows; None for an empty table."""
    counted = voted.groupBy("v").agg(F.count("*").cast("double").alias("c"))
    patterns = counted.agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("p"))  # at most 3 ** RULES entries
    found = patterns.where(F.size("p") > 0).select(_estimate(F.col("p")).alias("m")).select("m.*").first()
    if found is None:
        return None
    numbers = lambda name: F.array(*[F.lit(x) for x in found[name]]).alias(name)
    return F.struct(F.lit(found["share"]).alias("share"), numbers("good"), numbers("bad"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def _kept(s: Column, model: Column | None) -> Column:
    good = posterior(votes(s), model) if model is not None else F.lit(1.0)
    return ~base_failed(s) & (good >= LEAST)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    A document with fewer than 10 words, or with over a fifth of its words in repeated 5-word windows, goes; so does a
    null or empty text, and any whose posterior is below LEAST. Repeated rows share a fate; an empty table stays empty.
    Columns of any name pass through. The rows are stored with their votes in between, so texts are judged once.
    """
    (judged,) = fresh(docs, "_judged")
    told = let(text_stats(F.col(text)), lambda s: F.struct(votes(s).alias("v"), base_failed(s).alias("failed")))
    stored = durable(docs.withColumn(judged, told))
    model = fit(stored.select(f"{judged}.v"))
    good = posterior(F.col(f"{judged}.v"), model) if model is not None else F.lit(1.0)
    return stored.where(~F.col(f"{judged}.failed") & (good >= LEAST)).select(*docs.columns)


def quality_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the five base statistics, base_failed and kept of every row.

    A null text has no words, like an empty one, and fails; repeated rows share a fate; a posterior of exactly LEAST keeps;
    an empty table gives an empty result. Other columns of ``docs`` are left out, whatever their names.
    """
    stats = durable(docs.select("doc_id", text_stats(F.col("text")).alias("s")))
    model, s = fit(stats.select(votes(F.col("s")).alias("v"))), F.col("s")
    return stats.select("doc_id", *[s[c].alias(c) for c in STATS[:5]], base_failed(s).alias("base_failed"), _kept(s, model).alias("kept"))


#: The same statistics, votes, estimation (a recursion over the patterns' posteriors) and verdicts in DuckDB.
QUALITY_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT row, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
again AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS j FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
s AS MATERIALIZED (SELECT w.row, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
  len(l) AS n_lines, len(list_distinct(w)) AS n_distinct_words, len(regexp_extract_all(text, '\p{Lu}')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_shouts,
  len(list_filter(w, lambda x: regexp_matches(x, '[^\p{L}\p{M}\p{N}''’.,;:!?()"«»“”„…¿¡–—-]'))) AS n_odd_words,
  len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;…。]["''»”’)\]]?[\x20\x09-\x0D]*$'))) AS n_ended_lines FROM w LEFT JOIN again USING (row)),
m AS (SELECT *, greatest(n_words, 1) AS n, greatest(word_chars, 1) AS c, greatest(n_lines, 1) AS k FROM s),
v AS MATERIALIZED (SELECT *, [
  CASE WHEN n_symbols / n > 0.1 THEN -1 WHEN n_symbols / n < 0.05 THEN 1 ELSE 0 END,
  CASE WHEN word_chars < 20 THEN 0 WHEN n_upper / c > 0.35 THEN -1 WHEN n_upper / c < 0.15 THEN 1 ELSE 0 END,
  CASE WHEN n_shouts / n > 0.5 THEN -1 WHEN n_shouts / n < 0.1 THEN 1 ELSE 0 END,
  CASE WHEN n_words < 30 THEN 0 WHEN n_distinct_words / n < 0.3 THEN -1 WHEN n_distinct_words / n > 0.5 THEN 1 ELSE 0 END,
  CASE WHEN n_lines < 4 THEN 0 WHEN n_dup_lines / k > 0.3 THEN -1 WHEN n_dup_lines / k < 0.1 THEN 1 ELSE 0 END,
  CASE WHEN n_words < 10 THEN 0 WHEN n_repeat_words / n > 0.15 THEN -1 WHEN n_repeat_words / n < 0.05 THEN 1 ELSE 0 END,
  CASE WHEN n_words < 10 THEN 0 WHEN word_chars / n < 1.2 OR word_chars / n > 40 THEN -1 WHEN word_chars / n > 2 AND word_chars / n < 15 THEN 1 ELSE 0 END,
  CASE WHEN n_words < 10 THEN 0 WHEN n_odd_words / n > 0.2 THEN -1 WHEN n_odd_words / n < 0.1 THEN 1 ELSE 0 END,
  CASE WHEN n_words < 10 THEN 0 WHEN n_ended_lines / k < 0.5 THEN -1 WHEN n_ended_lines / k > 0.8 THEN 1 ELSE 0 END] AS v FROM m),
pat AS MATERIALIZED (SELECT list({'v': v, 'c': c} ORDER BY v) AS p, sum(c) AS total FROM (SELECT v, count(*)::DOUBLE AS c FROM v GROUP BY v)),
em AS (SELECT 0 AS round, list_transform(p, lambda x: CASE len(list_filter(x.v, lambda y: y = -1)) WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0.1 END::DOUBLE) AS q FROM pat
  UNION ALL SELECT round + 1, list_transform(p, lambda x: 1 / (1 + exp(-(ln(share / (1 - share)) + list_sum(list_transform(range(1, 10), lambda r:
    CASE x.v[r] WHEN 1 THEN ln(good[r] / (1 - bad[r])) WHEN -1 THEN ln((1 - good[r]) / bad[r]) ELSE 0 END)))))) FROM (
    SELECT round, p, greatest(0.01, least(0.99, (list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i].c * q[i])) + 9) / (total + 10))) AS share,
      list_transform(range(1, 10), lambda r: greatest(0.5, least(0.9999, (list_sum(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i].v[r] = 1 THEN p[i].c * q[i] ELSE 0 END)) + 9)
        / (list_sum(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i].v[r] <> 0 THEN p[i].c * q[i] ELSE 0 END)) + 10)))) AS good,
      list_transform(range(1, 10), lambda r: greatest(0.01, least(0.99, (list_sum(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i].v[r] = -1 THEN p[i].c * (1 - q[i]) ELSE 0 END)) + 1)
        / (list_sum(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN p[i].v[r] <> 0 THEN p[i].c * (1 - q[i]) ELSE 0 END)) + 2)))) AS bad
    FROM em, pat WHERE round < 26)),
judged AS (SELECT unnest(p).v AS v, unnest(q) AS good FROM em, pat WHERE round = 26)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND good >= 0.5 AS kept FROM v JOIN judged USING (v)
"""
