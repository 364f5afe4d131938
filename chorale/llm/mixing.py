"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output divided by the share it has. A document's count
is the Poisson quantile of a uniform number that is hashed from its id, its text and the seed, so that a rerun repeats
it. Documents are exploded by their counts and put in a global random order, again by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, id_text, let, sized_join

#: A source's default target weight is its size to this power: small sources are raised, large ones lowered.
TEMPERATURE = 0.5
SEED = "mix-1"
#: A Poisson of a larger mean is the sum of independent ones of at most this mean.
SLICE = 16.0
#: Terms of the distribution's inversion; beyond them at a mean of SLICE lies less than 1e-20.
TERMS = 80


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_quantile(u: Column, mean: Column) -> Column:
    """The least n whose cumulative Poisson probability exceeds ``u``."""

    def invert(given: Column) -> Column:  # the number and the mean are computed once, not at every term
        u, mean = given["u"], given["mean"]
        start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"), F.lit(0).alias("n"))

        def step(s, k):
            term = s["term"] * mean / k
            return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"), (s["n"] + F.when(u >= s["sum"], 1).otherwise(0)).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["n"])

    return let(F.struct(u.alias("u"), mean.alias("mean")), invert)


def repetition_rates(docs: DataFrame, weights: dict | None = None, source: str = "source", text: str = "text", epochs: float = 1.0) -> DataFrame:
    """One row per source with its mean repetition rate; sizes are UTF-8 bytes plus 1 over all documents.

    ``weights`` maps sources to target weights (others get 0); without it, a source's weight is its size to the power
    TEMPERATURE. A null source is a source like any other. The output is expected to hold ``epochs`` times the bytes.
    """
    sizes = docs.groupBy(F.col(source).alias("s")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("bytes"))
    sizes = durable(sizes)  # one row a source, used three times
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("s").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighted = sizes.withColumn("w", weight)
    totals = weighted.agg(F.sum("bytes"), F.sum("w")).first()
    if not totals[1]:
        return weighted.select("s", F.lit(0.0).alias("rate"))
    return weighted.select("s", (F.col("w") / F.lit(float(totals[1])) * F.lit(float(totals[0] * epochs)) / F.col("bytes")).alias("rate"))


def mix(docs: DataFrame, weights: dict | None = None, source: str = "source", text: str = "text", doc_id: str = "doc_id", epochs: float = 1.0, seed: str = SEED, numbered: bool = False) -> DataFrame:
    """``docs`` with every row repeated by its Poisson count, in a global random order; the columns stay.

    With ``numbered``, columns ``copy`` (from 1) and ``n_copies`` follow. Repeated input rows get the same count each.
    Null ids, sources and texts count as empty in the hash. An empty table gives an empty result.
    """
    rate, source_, count, order, copy = fresh(docs, "_rate", "_source", "_count", "_order", "copy" if numbered else "_copy")
    rates = repetition_rates(docs, weights, source, text, epochs).select(F.col("s").alias(source_), F.col("rate").alias(rate))
    known = sized_join(docs, rates, docs[source].eqNullSafe(rates[source_]), "inner").drop(source_)
    slices = F.greatest(F.ceil(F.col(rate) / SLICE), F.lit(1)).cast("int")
    name = F.concat_ws("|", id_text(doc_id), F.md5(F.coalesce(F.col(text), F.lit(""))))
    drawn = F.aggregate(
        F.transform(F.sequence(F.lit(1), slices), lambda j: poisson_quantile(uniform(name, F.lit(seed), j.cast("string")), F.col(rate) / slices)),
        F.lit(0), lambda a, b: a + b,
    )
    counted = known.withColumn(count, drawn).where(F.col(count) > 0)
    exploded = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
    shuffled = exploded.withColumn(order, F.xxhash64(name, F.col(copy), F.lit(seed)))
    shuffled = shuffled.repartition(F.col(order)).sortWithinPartitions(order)
    if numbered:
        return shuffled.select(*[c for c in docs.columns if c.lower() != "n_copies"], copy, F.col(count).alias("n_copies"))
    return shuffled.select(*docs.columns)


#: The mixed table as DuckDB computes it.
MIX_SQL = f"""
WITH sized AS (SELECT source, sum(coalesce(octet_length(encode(text)), 0) + 1) AS bytes FROM documents GROUP BY source),
weighted AS (SELECT source, bytes, pow(bytes::DOUBLE, {TEMPERATURE}) AS w FROM sized),
rates AS (SELECT source, w / (SELECT sum(w) FROM weighted) * (SELECT sum(bytes) FROM weighted)::DOUBLE / bytes AS rate FROM weighted),
sliced AS (SELECT d.*, rate, greatest(ceil(rate / {SLICE}), 1)::INT AS slices,
  concat_ws('|', coalesce(CAST(d.doc_id AS VARCHAR), ''), md5(coalesce(text, ''))) AS name
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
drawn AS (SELECT row_number() OVER () AS rid, * FROM sliced),
uniforms AS (SELECT rid, rate / slices AS mean, ('0x' || substr(md5(concat_ws('|', name, '{SEED}', CAST(j AS VARCHAR))), 1, 13))::BIGINT / {float(1 << 52)} AS u, j
  FROM (SELECT *, unnest(generate_series(1, slices)) AS j FROM drawn)),
terms AS (SELECT rid, j, u, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY rid, j ORDER BY k) AS cum
  FROM uniforms, (SELECT unnest(generate_series(0, {TERMS - 1})) AS k)),
counts AS (SELECT rid, count(*) FILTER (WHERE u >= cum) AS n FROM terms GROUP BY rid)
SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, n)) AS copy, n::INT AS n_copies
FROM drawn JOIN counts USING (rid) WHERE n > 0
"""


def mix_digest(docs: DataFrame) -> DataFrame:
    """The whole mixed table: the documents' columns, ``copy`` and ``n_copies``."""
    return mix(docs, numbered=True)
