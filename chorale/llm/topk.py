"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are cut into segments; of each segment only the mean and the deviation are kept. By Cauchy and Schwarz, the
inner product of two segments of L components is at most L (mean * mean + deviation * deviation), and the sum over the
segments bounds the whole product from above (so it bounds the distance from below). Vectors are dealt to blocks in the
order of their coarse means, so that like ones share a block. A block keeps an envelope of its segments' statistics, and a
query's best products inside its own block give it a floor. A query is sent only to the blocks whose envelope can reach its
floor; there, bounds of 1, 4 and 16 segments discard candidates that cannot, and the survivors get their exact integer
product. Candidates are sent once for each group of queries that come to their block, not for all queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, sized_join

#: Segments of each resolution, coarse to fine.
LEVELS = (1, 4, 16)
#: Most rows of a block of candidates, and of a group of queries that meets it; smaller tables have a block for each core.
BLOCK = 32_768
#: Most blocks: their envelopes (2 KB each) are told to all tasks. Blocks of still larger tables grow instead.
MOST_BLOCKS = 16_384
#: Components of a product are computed for so many pairs of rows at a time.
CELLS = 1 << 22
RESULT = "query_id long, query_key long, vec_id long, score long"


def _stats(m: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: root-length-weighted segment means and deviations, so that bounds are plain products of matrices."""
    edges = np.linspace(0, m.shape[1], min(segments, m.shape[1]) + 1).astype(int)
    length = np.diff(edges)
    mean = np.add.reduceat(m, edges[:-1], axis=1) / length
    square = np.add.reduceat(m * m, edges[:-1], axis=1) / length
    return mean * np.sqrt(length), np.sqrt(np.maximum(square - mean * mean, 0)) * np.sqrt(length)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _exact_type(a: np.ndarray, b: np.ndarray):
    """Doubles hold the products of these integers, or Python's integers have to."""
    return np.float64 if b.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53 else object


def search_block(queries: np.ndarray, query_ids: np.ndarray, query_keys: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> pd.DataFrame:
    """The k best of this block for each query, ties to the smaller id; fewer where a known floor rules the others out.

    Matrices hold integers; ``floors`` are scores that each query's k-th best reaches at least.
    """
    exact = _exact_type(queries, vectors)
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    stats = [(_stats(q, n), _stats(v, n)) for n in LEVELS]
    out = []
    qe, ve = (queries.astype(exact), vectors.astype(exact))
    (qm, qd), (vm, vd) = stats[0]
    step = max(1, CELLS // max(1, len(v)))
    for low in range(0, len(q), step):
        coarse = qm[low : low + step] @ vm.T + qd[low : low + step] @ vd.T
        for i in range(low, min(low + step, len(q))):
            other = np.flatnonzero(ids != query_ids[i])
            if not len(other):
                continue
            bound = coarse[i - low]
            # The most promising candidates by the coarse bound give a first k-th score.
            first = other[np.argpartition(-bound[other], min(4 * k, len(other) - 1))[: 4 * k]]
            scores = ve[first] @ qe[i]
            floor = np.sort(scores.astype(np.float64))[-k] if len(first) >= k else -np.inf
            if floors is not None:
                floor = max(floor, floors[i])
            slack = 1e-9 * (1 + abs(floor)) if np.isfinite(floor) else 0
            alive = other[bound[other] * (1 + 1e-12) + slack >= floor]
            for (fm, fd), (wm, wd) in stats[1:]:
                finer = wm[alive] @ fm[i] + wd[alive] @ fd[i]
                alive = alive[finer + 1e-9 * (1 + np.abs(finer)) >= floor]
            alive = np.union1d(alive, first)
            scores = ve[alive] @ qe[i]
            best = _best(ids[alive], scores, k)
            best = best[scores[best] >= floor]
            out.append(pd.DataFrame({"query_id": query_ids[i], "query_key": query_keys[i], "vec_id": ids[alive][best], "score": scores[best].astype(np.int64)}))
    return pd.concat(out) if out else _nothing()


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}).astype("int64")


def clean_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array of double, floor(256 x)) and its length; rows with a null id, or a vector that is null, empty or
    holds a null or non-finite component, take no part."""
    x = F.col(vector)
    sound = F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.coalesce(sound, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("double")).alias("v"), F.size(x).alias("dim")
    )


def _order(v: Column) -> list[Column]:
    """Coarse to fine: the signs of the means of four segments, the direction in the first pair, then the first mean."""
    n = F.size(v)
    part = lambda i: F.slice(v, F.floor(n * i / 4).cast("int") + 1, F.greatest(F.floor(n * (i + 1) / 4) - F.floor(n * i / 4), F.lit(1)).cast("int"))
    mean = [F.aggregate(part(i), F.lit(0.0), lambda a, x: a + x) for i in range(4)]
    signs = sum((F.when(m > 0, 1 << i).otherwise(0) for i, m in enumerate(mean)), F.lit(0))
    return [signs, F.atan2(mean[1], mean[0])]


_BLOCK_FACTS = "cb int, dim int, rows int, low array<double>, high array<double>, spread array<double>, query_id long, query_key long, v array<double>, floor double"


def _facts(k: int, every: int):
    """Of each block: one row with its envelope, and one for each query in it with the k-th best score inside the block."""
    def run(batches):
        held = [b.to_pandas() for b in batches]
        held = pd.concat(held) if held else pd.DataFrame({"dim": []})
        for dim, own in held.groupby("dim"):
            m, ids = np.stack(own["v"]).astype(np.float64), own["id"].to_numpy()
            mean, deviation = _stats(m, LEVELS[-1])
            envelope = {"cb": int(own["cb"].iloc[0]), "dim": int(dim), "rows": len(own), "low": mean.min(0).tolist(), "high": mean.max(0).tolist(), "spread": deviation.max(0).tolist(), "query_id": None, "query_key": None, "v": None, "floor": None}
            yield _facts_batch([envelope])
            ask = np.flatnonzero(ids % every == 0)
            exact = _exact_type(m, m)
            me = m.astype(exact)
            step = max(1, CELLS // len(m))
            for low in range(0, len(ask), step):
                rows = []
                for i in ask[low : low + step]:
                    scores = np.sort((me[ids != ids[i]] @ me[i]).astype(np.float64))
                    floor = float(scores[-k]) if len(scores) >= k else float("-inf")
                    rows.append({"cb": envelope["cb"], "dim": int(dim), "rows": None, "low": None, "high": None, "spread": None, "query_id": int(ids[i]), "query_key": int(own["key"].iloc[i]), "v": m[i].tolist(), "floor": floor})
                if rows:
                    yield _facts_batch(rows)

    return run


def _facts_batch(rows: list[dict]):
    import pyarrow as pa

    doubles = pa.list_(pa.float64())
    return pa.RecordBatch.from_pylist(rows, pa.schema([("cb", pa.int32()), ("dim", pa.int32()), ("rows", pa.int32()), ("low", doubles), ("high", doubles), ("spread", doubles), ("query_id", pa.int64()), ("query_key", pa.int64()), ("v", doubles), ("floor", pa.float64())]))


def _reach(envelopes):
    """Each query with the blocks whose envelope can reach its floor."""
    def run(frames):
        facts = envelopes.value
        for frame in frames:
            for dim, own in frame.groupby("dim"):
                cb, low, high, spread = facts[dim]
                mean, deviation = _stats(np.stack(own["v"]), LEVELS[-1])
                for i in range(len(own)):
                    bound = np.maximum(mean[i] * low, mean[i] * high).sum(1) + spread @ deviation[i]
                    reached = cb[bound + 1e-9 * (1 + np.abs(bound)) >= own["floor"].iloc[i]]
                    row = own.iloc[i]
                    yield pd.DataFrame({"dim": dim, "cb": reached, "query_id": row["query_id"], "query_key": row["query_key"], "floor": row["floor"], "v": [row["v"]] * len(reached)})

    return run


def top_k(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its ``k`` best other rows.

    Only vectors of equal length are compared. Rows with the query's own id are no candidates; repeated rows are
    candidates each, but ask once; rows that share an id and not the vector ask each. An empty table gives an empty result.
    Blocks and envelopes decide where products are computed, never the result.
    """
    spark = df.sparkSession
    vectors = clean_vectors(df, vec_id, vector)
    total = vectors.count()
    size = block or min(BLOCK, max(1024, -(-total // (2 * spark.sparkContext.defaultParallelism))))
    blocks = max(1, min(-(-total // size), MOST_BLOCKS))
    near = [c.alias(f"o{i}") for i, c in enumerate(_order(F.col("v")))]
    keyed = vectors.select("id", "v", "dim", F.xxhash64("v").alias("key"), *near, F.xxhash64("id", "v", F.monotonically_increasing_id()).alias("tie"))
    # Stored, as a row must stay in its block.
    placed = durable(keyed.repartitionByRange(blocks, "dim", "o0", "o1", "tie").select("id", "v", "dim", "key", F.spark_partition_id().alias("cb")))

    facts = durable(placed.mapInArrow(_facts(k, every), _BLOCK_FACTS))
    envelopes: dict = {}
    for r in facts.where("query_id IS NULL").select("dim", "cb", "rows", "low", "high", "spread").toLocalIterator():  # one row a block
        envelopes.setdefault(r["dim"], []).append((r["cb"], r["low"], r["high"], r["spread"]))
    told = spark.sparkContext.broadcast({d: tuple(np.array(x) for x in zip(*e)) for d, e in envelopes.items()})

    asked = facts.where("query_id IS NOT NULL").groupBy("dim", "query_id", "query_key").agg(F.first("v").alias("v"), F.max("floor").alias("floor"))
    sent = durable(asked.mapInPandas(_reach(told), "dim int, cb int, query_id long, query_key long, floor double, v array<double>"))
    groups = durable(sent.groupBy("dim", "cb").agg(F.ceil(F.count("*") / (block or BLOCK)).cast("int").alias("groups")))
    queries = sized_join(sent, groups, ["dim", "cb"], "inner").withColumn("qb", F.pmod(F.xxhash64("query_id", "query_key"), F.col("groups")).cast("int"))
    candidates = sized_join(placed, groups, ["dim", "cb"], "inner").select("dim", "cb", "id", "v", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("qb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _nothing()
        return search_block(np.stack(left["v"]), left["query_id"].to_numpy(), left["query_key"].to_numpy(), np.stack(right["v"]), right["id"].to_numpy(), k, left["floor"].to_numpy())

    keys = ["dim", "cb", "qb"]
    found = queries.groupBy(keys).cogroup(candidates.groupBy(keys)).applyInPandas(meet, RESULT)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
