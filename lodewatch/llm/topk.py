"""Exact top-k search by inner product, pruned with MaxScore.

A vector's components are the terms of a query and the entries of the postings. In a shard of candidates each term of a
query adds at least ``low`` and at most ``high`` to a score, from the least and largest entry of its postings. Counted
from the sum of all lows, every term adds between nothing and its range, as in MaxScore proper.

Each query orders its terms by range. Its non-essential terms are the longest tail whose ranges together can't lift a
candidate to the query's threshold; the terms before it are essential. The postings of essential terms are traversed
for every candidate, the others are probed, a few at a time, for the candidates that are still competitive: those
whose score so far and the ranges still open reach the threshold. Thresholds start at the k-th best score among
``SEEDS`` rows, found in a pass of its own and shared by all shards, and rise with the best of each shard. Each shard
hands on its k best a query, and the shards are merged by rank.

Work is laid out as (query block, shard) tasks: candidates go to a shard by hash and meet each block of the stated query
set there. No task holds more than a block and a shard, whatever the number of equal vectors.

Defined cases: vectors null or with null or non-finite components take no part; each row is a candidate and, where it is
asked for, a query of its own, which meets every row but itself, so rows that repeat an id or a vector all count; vectors
of different lengths score over the shorter one's components; fewer candidates than k give fewer rows; ties go to the
smaller id; an empty table gives no rows; extra columns are left alone. Scores are exact up to 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, staged

#: Vectors of one shard and queries of one block, about.
SHARD_ROWS, BLOCK_ROWS = 8192, 4096
#: Rows whose scores give the thresholds to start with, and terms that are probed in one step.
SEEDS, STEP = 2048, 8
#: Queries whose essential postings are traversed together.
TOGETHER = 64


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each row, or minus infinity where there are fewer."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] >= k else np.full(len(scores), -np.inf)


def best_of(q: np.ndarray, own: np.ndarray, theta: np.ndarray, c: np.ndarray, c_rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, candidates, scores) of the k best for each query, best first; ``c`` has a row for each term and a column for each candidate.

    Candidates must be in ascending order of id. ``own`` are the queries' own rows, ``theta`` scores that k other rows reach.
    """
    n, dims = q.shape
    high, low = c.max(axis=1), c.min(axis=1)
    most, least = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
    order = np.argsort(least - most, axis=1, kind="stable")
    base = least.sum(axis=1)
    # what the terms from each place on can add together, above their least
    open_range = np.zeros((n, dims + 1))
    open_range[:, :-1] = np.cumsum(np.take_along_axis(most - least, order, axis=1)[:, ::-1], axis=1)[:, ::-1]
    out_of_reach = base[:, None] + open_range < theta[:, None]
    essential = np.where(out_of_reach.any(axis=1), out_of_reach.argmax(axis=1), dims)
    # essential postings are traversed for all candidates, those of several queries in one product
    on_essential = np.zeros((n, dims), bool)
    np.put_along_axis(on_essential, order, np.arange(dims) < essential[:, None], axis=1)
    scores = np.where(on_essential, q, 0.0) @ c + (base - np.where(on_essential, least, 0.0).sum(axis=1))[:, None]
    reach = scores + open_range[np.arange(n), essential][:, None] >= theta[:, None]
    reach &= own[:, None] != c_rows[None, :]
    for i in range(n):
        on = np.flatnonzero(reach[i])
        score, bar = scores[i, on], theta[i]
        for at in range(int(essential[i]), dims, STEP):  # the others are probed, a few at a time, while competitive
            terms = order[i, at : at + STEP]
            # whole postings while most candidates are competitive, single entries from then on
            added = (q[i, terms] @ c[terms])[on] if 4 * len(on) > len(c_rows) else q[i, terms] @ c[np.ix_(terms, on)]
            score = score + (added - least[i, terms].sum())
            # a score so far is a bound from below, so the k-th best raises the threshold
            if len(on) > k:
                bar = max(bar, float(np.partition(score, len(on) - k)[len(on) - k]))
            live = score + open_range[i, min(at + STEP, dims)] >= bar
            on, score = on[live], score[live]
        best = np.lexsort((on, -score))[:k]
        yield i, on[best], score[best]


def top_k(vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``vectors`` (vec_id, vector array<long>); ``is_query`` marks the stated query set."""
    vectors = staged(vectors.select("vec_id", "vector", is_query.alias("asked")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    total, asked = vectors.agg(F.count("*"), F.count_if("asked")).first()
    n_shards, n_blocks = max(1, -(-total // shard_rows)), max(1, -(-asked // block_rows))
    part = lambda salt, n: F.pmod(F.xxhash64(F.col("row"), F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    again = lambda name: F.col(name).alias(name)  # noqa: E731  the two sides of a cogroup must not share a column
    queries = vectors.filter("asked").select("row", "vec_id", "vector", part(1, n_blocks).alias("block"))
    seeds = vectors.orderBy(F.xxhash64("row", F.lit(3))).limit(SEEDS).select(again("row"), again("vec_id"), again("vector"), every(n_blocks).alias("block"))
    candidates = vectors.select(again("row"), again("vec_id"), again("vector"), part(2, n_shards).alias("shard"), every(n_blocks).alias("block"))

    def matrix(pdf: pd.DataFrame, dims: int) -> np.ndarray:
        out = np.zeros((len(pdf), dims))
        for i, v in enumerate(pdf["vector"]):
            out[i, : len(v)] = v
        return out

    def first_thresholds(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame({"row": [], "theta": []}).astype({"row": "int64", "theta": "float64"})
        dims = max(map(len, [*q["vector"], *c["vector"]]))
        c_rows, seen = c["row"].to_numpy(), matrix(c, dims).T
        thetas = []
        for at in range(0, len(q), 256):
            scores = matrix(q.iloc[at : at + 256], dims) @ seen
            scores[q["row"].to_numpy()[at : at + 256, None] == c_rows[None, :]] = -np.inf
            thetas.append(kth_best(scores, k))
        return pd.DataFrame({"row": q["row"], "theta": np.concatenate(thetas)})

    found = queries.groupBy("block").cogroup(seeds.groupBy("block")).applyInPandas(first_thresholds, "row long, theta double")
    queries = queries.join(found, "row").withColumn("shard", every(n_shards))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")]
        if len(q) and len(c):
            dims = max(map(len, [*q["vector"], *c["vector"]]))
            c = c.sort_values("vec_id", kind="stable")
            c_rows, c_ids, postings = c["row"].to_numpy(), c["vec_id"].to_numpy(), np.ascontiguousarray(matrix(c, dims).T)
            for at in range(0, len(q), TOGETHER):
                part = q.iloc[at : at + TOGETHER]
                ids, rows = part["vec_id"].to_numpy(), part["row"].to_numpy()
                for i, ci, score in best_of(matrix(part, dims), rows, part["theta"].to_numpy(), postings, c_rows, k):
                    parts.append(pd.DataFrame({"query": rows[i], "query_id": ids[i], "vec_id": c_ids[ci], "score": score.astype(np.int64)}))
        return pd.concat(parts)

    key = ["block", "shard"]
    found = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(search, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_maxscore_top20(spark, sf_dir: str) -> DataFrame:
    rows = pick(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding").filter("vec_id IS NOT NULL")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long"))
    rows = rows.filter(F.col("embedding").isNotNull() & finite).select("vec_id", vector.alias("vector"))
    return top_k(rows, F.col("vec_id") % 20 == 0, 20)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.nr, q.vec_id AS query_id, c.vec_id,
         list_dot_product(q.vec::DOUBLE[], c.vec::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.nr <> c.nr
), r AS (SELECT *, (row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
