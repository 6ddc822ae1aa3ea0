"""FTRL against a plain version over dictionaries, and the mean of shards."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodewatch.llm import toxicity

RATES = toxicity.Rates(l1=0.5)


def plain_ftrl(rows, steps, rates):
    """Weights by place of rows of (places, label), one coordinate after the other."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= rates.l1:
            return 0.0
        return (math.copysign(rates.l1, z[i]) - z[i]) / ((rates.beta + math.sqrt(n[i])) / rates.alpha + rates.l2)

    deal, done = np.random.default_rng(7), 0
    while done < steps:
        for r in deal.permutation(len(rows)):
            places, label = rows[r]
            own = {i: weight(i) for i in places}
            p = 1 / (1 + math.exp(-sum(own.values())))
            g = (p - label) * (rates.weight if label else 1.0)
            for i, w in own.items():
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / rates.alpha * w
        done += len(rows)
    return {i: w for i in z if (w := weight(i))}


@pytest.fixture(scope="module")
def corpus(spark):
    deal = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        toxic = deal.random() < 0.3
        rows.append((i, " ".join(deal.choices(words, k=deal.randrange(1, 25)) + ["vile"] * (toxic and deal.random() < 0.9)), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    used = docs.join(labels, "doc_id").filter(~toxicity.held_out(F.col("doc_id")))
    return docs, labels, used.withColumn("h", F.xxhash64("doc_id", F.lit(1))).orderBy("h").collect()


def examples(rows):
    out = []
    for r in rows:
        _, places = toxicity.feature_places(pa.array([r.text.lower()]))
        out.append(([0, *sorted(set(places.tolist()))], r.toxic))
    return out


def steps(rows):
    return max(toxicity.LEAST_STEPS, toxicity.EPOCHS * len(rows))


def agree(model, wanted):
    got = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))
    assert {i for i, w in got.items() if abs(w) > 1e-12} == {i for i, w in wanted.items() if abs(w) > 1e-12}
    assert all(abs(got[i] - w) < 1e-9 for i, w in wanted.items())


def test_one_shard(spark, corpus):
    docs, labels, used = corpus
    model = toxicity.train(docs, labels, RATES)
    wanted = plain_ftrl(examples(used), steps(used), RATES)
    assert model.rows == len(used) and len(wanted) > 5
    agree(model, wanted)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r, (places, _) in zip(used, examples(used), strict=True):
        assert abs(scores[r.doc_id] - 1 / (1 + math.exp(-sum(wanted.get(i, 0.0) for i in places)))) < 1e-9


def test_shards_count_by_their_rows(spark, corpus):
    docs, labels, used = corpus
    shards = -(-len(used) // 25)
    model = toxicity.train(docs, labels, RATES, shard_rows=25)
    wanted, sizes = {}, []
    for k in range(shards):
        own = [r for r in used if r.h % shards == k]
        sizes.append(len(own))
        for i, w in plain_ftrl(examples(own), steps(own), RATES).items() if own else ():
            wanted[i] = wanted.get(i, 0.0) + w * len(own) / len(used)
    assert shards >= 3 and len(set(sizes)) > 1
    agree(model, wanted)


def test_parts_of_a_shard_count_by_their_rows(spark, corpus):
    docs, labels, used = corpus
    limit = sum(len(p) - 1 for p, _ in examples(used)) // 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        model = toxicity.train(docs, labels, RATES, shard_features=limit)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts, part, held = [], [], 0
    for at in range(0, len(used), 10):  # a part ends behind the batch that fills it
        for e in examples(used[at : at + 10]):
            part.append(e)
            held += len(e[0]) - 1
        if held > limit:
            parts.append(part)
            part, held = [], 0
    parts += [part] if part else []
    wanted = {}
    for own in parts:
        for i, w in plain_ftrl(own, steps(own), RATES).items():
            wanted[i] = wanted.get(i, 0.0) + w * len(own) / len(used)
    assert len({len(p) for p in parts}) > 1
    agree(model, wanted)
