"""The vector search against brute force, on repeated rows, awkward vectors and empty tables."""

import math
import random

import numpy as np
import pytest

from lodewatch.llm import topk


def brute(rows, k):
    """{(query row): [(score, vec_id)]} of rows (vec_id, vector) whose id is divisible by 20."""
    out = {}
    for i, (q_id, q) in enumerate(rows):
        if q_id % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(q, c)), c_id) for j, (c_id, c) in enumerate(rows) if j != i]  # noqa: B905
            out[i] = [(-s, c) for s, c in sorted(scores)[:k]]
    return out


def test_every_row_but_the_own_one_counts_also_when_repeated(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(120), [rng.randrange(-9, 9) for _ in range(12)]) for _ in range(300)]
    rows += [rows[0]] * 30 + [(20, [1] * 12)] * 3 + [(40, [-5] * 5), (40, [7, 7])]
    table = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(3)
    found = topk.top_k(table, table["vec_id"] % 20 == 0, 7, shard_rows=50, block_rows=5).collect()
    wanted = sorted((rows[i][0], rank, c, s) for i, best in brute(rows, 7).items() for rank, (s, c) in enumerate(best, 1))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == wanted


@pytest.mark.parametrize("seed", range(5))
def test_pruned_search_of_one_query_is_exact(seed):
    rng = np.random.default_rng(seed)
    c = rng.integers(-40, 40, (16, 500)).astype(float)
    c[:, 250:] = c[:, :250]
    rows, own = np.arange(500), np.arange(0, 500, 37)
    scores = c[:, own].T @ c
    scores[np.arange(len(own)), own] = -np.inf
    orders = [np.lexsort((rows, -x))[:9] for x in scores]
    for theta in (np.full(len(own), -np.inf), np.sort(scores, axis=1)[:, -300], np.array([x[o[-1]] for x, o in zip(scores, orders, strict=True)])):
        for i, at, score in topk.best_of(c[:, own].T, own, theta, c, rows, 9):
            assert at.tolist() == orders[i].tolist() and score.tolist() == scores[i, orders[i]].tolist()


def test_query_on_awkward_vectors(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, math.nan]), (60, [math.inf, 1.0]), (80, [None, 1.0]), (None, [1.0, 1.0]), (1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [3.0]), (100, [])]
    rows = [(*r, "x", i) for i, r in enumerate(rows)]
    schema = "vec_id long, embedding array<float>, `block` string, `row` int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "some" / "embeddings.parquet"))
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.op6_maxscore_top20(spark, str(tmp_path / "some")).collect()}
    assert found == {(0, 1): (2, 64 * 192), (0, 2): (100, 0), (0, 3): (1, 64 * 32 - 128 * 32), (0, 4): (1, 64 * 32 - 128 * 32), (100, 1): (0, 0), (100, 2): (1, 0), (100, 3): (1, 0), (100, 4): (2, 0)}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert topk.op6_maxscore_top20(spark, str(tmp_path / "none")).count() == 0
