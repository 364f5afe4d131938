"""URL filter: path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's path.
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
#: One of these as a whole word rejects a url.
STRICT = ("casino", "porn", "xxx", "viagra", "escort", "adult", "spam", "pills", "hentai", "camgirl")
#: So many different ones of these, as whole words, reject a url.
SOFT = ("free", "bets", "win", "cheap", "ads", "track", "farm", "poker", "slots", "loan", "bonus", "promo", "click", "dating", "replica", "deal", "offer")
SOFT_LIMIT = 2

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_FOLD = {ord(c.upper()): c for c in _LETTERS}
_WORD = frozenset(_LETTERS + "0123456789")


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        automaton.add_word(term, (term, term in strict))
    automaton.make_automaton()
    return automaton


def _hits(url: str | None, automaton) -> tuple[int, int]:
    """Different strict and soft terms that stand between characters other than a-z and 0-9."""
    text = (url or "").translate(_FOLD)
    strict, soft = set(), set()
    for end, (term, is_strict) in automaton.iter(text):
        start = end - len(term) + 1
        if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            (strict if is_strict else soft).add(term)
    return len(strict), len(soft)


def term_hits(url: Column, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> Column:
    """Struct of the counts of different strict and soft terms in the whole url; null has none."""

    @F.pandas_udf(T.StructType([T.StructField("strict", T.IntegerType()), T.StructField("soft", T.IntegerType())]))
    def count(urls: pd.Series) -> pd.DataFrame:
        automaton = _automaton(strict, soft)
        return pd.DataFrame([_hits(u, automaton) for u in urls], columns=["strict", "soft"], dtype="int32")

    return count(url)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return (F.coalesce(F.translate(host, _LETTERS.upper(), _LETTERS), F.lit("")), F.coalesce(path, F.lit("")))


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict``, ``n_strict`` and ``n_soft``; columns of these names are replaced.

    The longest fitting rule decides (host and path together; equal lengths: the rule given first); without one, one
    strict or ``soft_limit`` different soft terms block. A null or empty url has empty parts and is allowed. Repeated
    rows are judged alike, and an empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "n_strict", "n_soft")]
    hits, host_, path_, rule_, u = fresh(pages, "_hits", "_host", "_path", "_rule", "_url")
    host, path = url_parts(F.col(u))
    named = pages.withColumn(u, F.col(url)).withColumn(hits, term_hits(F.col(u), tuple(strict), tuple(soft))).withColumns({host_: host, path_: path})
    fitting, verdict = F.lit(None).cast("string"), F.when((F.col(f"{hits}.strict") > 0) | (F.col(f"{hits}.soft") >= soft_limit), "block").otherwise("allow")
    for what, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host_) == h) | F.col(host_).endswith(f".{h}")) & F.col(path_).startswith(p)
        fitting, verdict = F.when(fits, h + p).otherwise(fitting), F.when(fits, what).otherwise(verdict)
    return named.select(
        *kept, F.col(host_).alias("host"), F.col(path_).alias("path"), fitting.alias("rule"), verdict.alias("verdict"),
        F.col(f"{hits}.strict").alias("n_strict"), F.col(f"{hits}.soft").alias("n_soft"),
    )


def load_terms(terms: DataFrame, term: str = "term", weight: str = "weight", most: int = 1_000_000) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) terms of a weighted vocabulary: a weight of 1 or more rejects alone, a positive one below it is soft.

    Terms are trimmed and lower-cased (A-Z); blank and repeated ones count once, by their largest weight, and weights of 0 or
    less, or missing, leave a term out. A vocabulary of more than ``most`` terms is an error, as each task holds it.
    """
    name = F.translate(F.trim(term), _LETTERS.upper(), _LETTERS)
    found = terms.where((F.trim(term) != "") & (F.col(weight) > 0)).groupBy(name.alias("t")).agg(F.max(weight).alias("w")).orderBy("t").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the vocabulary has more than {most} terms")
    return tuple(r["t"] for r in found if r["w"] >= 1), tuple(r["t"] for r in found if r["w"] < 1)


def url_digest(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, as ``judge_urls`` treats null and empty urls, ties and repeated rows.
    Other columns of ``pages`` are left out, whatever their names."""
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same verdicts in DuckDB, each term by its own pattern."""
    def found(terms):
        return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms)

    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for _, h, p in ranked]
    rule = " ".join(f"WHEN {f} THEN '{h + p}'" for f, (_, h, p) in zip(fits, ranked))
    verdict = " ".join(f"WHEN {f} THEN '{what}'" for f, (what, _, _) in zip(fits, ranked))
    return f"""
WITH rest AS (SELECT page_id, coalesce(translate(url, '{_LETTERS.upper()}', '{_LETTERS}'), '') AS u,
  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, u, translate(regexp_extract(r, '^[^/?#]*'), '{_LETTERS.upper()}', '{_LETTERS}') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {found(STRICT)} > 0 OR {found(SOFT)} >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM parts
"""


URLS_SQL = _sql()
