"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, pairs of neighbours and pairs with one word between, hashed to ``DIMENSIONS`` places.
Each coordinate has its own learning rate, and the L1 term leaves most weights at zero, so the model is a short list of
places and weights: at most ``DIMENSIONS`` of them, and in practice a few thousand, which is what is broadcast.

The model is fitted on a sample of at most ``SAMPLE_ROWS`` labelled ids, by hash of the id, with one text each. The sample
is dealt to shards of about ``SHARD_ROWS`` rows, each is learned by itself, and the weights are averaged, each model by its
rows. A shard whose rows have more than ``SHARD_FEATURES`` features is learned in several parts, each of which counts by
its rows too, so what a task holds is bounded however long texts are. Scoring covers all rows.

Defined cases: null or empty text is scored by the bias alone; ids that are labelled twice are toxic if one label says
so; of several texts of a labelled id the one of the least hash is learned; null labels are left out; without any labelled row all scores are 0; repeated rows are scored one by one; an empty
table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, short_batches, staged
from .wordhash import NOT_ALNUM, mixed, small_batches, word_hashes

DIMENSIONS = 1 << 21
SAMPLE_ROWS, SHARD_ROWS, EPOCHS = 1 << 16, 1 << 14, 4
#: Features, four bytes each, that a task holds before it learns what it has.
SHARD_FEATURES = 1 << 25
#: Texts of few rows are passed over more often: at least so many steps a shard.
LEAST_STEPS = 6000


@dataclass(frozen=True)
class Rates:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 0.05
    #: of a toxic row, as these are the fewer
    weight: float = 5.0


@dataclass(frozen=True)
class Model:
    """The place 0 is the bias. A model of no rows has ``rows`` 0."""

    places: np.ndarray
    weights: np.ndarray
    rows: int


def feature_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of all features, not yet distinct."""
    hashes, bounds = word_hashes(texts, NOT_ALNUM)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    places, owners = [hashes], [owner]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(hashes) > gap:
            both = owner[gap:] == owner[:-gap]
            places.append(mixed(hashes[:-gap] * np.uint64(salt) + hashes[gap:])[both])
            owners.append(owner[gap:][both])
    return np.concatenate(owners), (np.concatenate(places) % np.uint64(DIMENSIONS - 1)).astype(np.int64) + 1


def learn(rows: list[tuple[np.ndarray, int]], rates: Rates, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of the nonzero weights after ``steps`` examples, by rows of (distinct places, label)."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = (np.sign(zi) * rates.l1 - zi) / ((rates.beta + np.sqrt(ni)) / rates.alpha + rates.l2)
        return np.where(np.abs(zi) <= rates.l1, 0.0, w)

    order = np.random.default_rng(7)
    done = 0
    while done < steps and rows:
        for r in order.permutation(len(rows)):
            at, label = rows[r]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label) * (rates.weight if label else 1.0)
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / rates.alpha * w
            n[at] = more
        done += len(rows)
    w = weights(z, n)
    at = np.flatnonzero(w)
    return at, w[at]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rates: Rates = Rates(), sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, shard_features: int = SHARD_FEATURES) -> Model:
    """A model from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text) that aren't held out."""
    short_batches(docs.sparkSession)
    marked = pick(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marked = marked.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = marked.count()
    share = min(1.0, 0.95 * sample_rows / total) if total else 1.0
    scale = 1 << 20
    marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < math.ceil(share * scale)).orderBy(F.xxhash64("doc_id")).limit(sample_rows)
    texts = pick(docs, "doc_id", "text").select("doc_id", F.lower("text").alias("text"))
    # at most sample_rows pairs of numbers are broadcast
    rows = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select((F.col("toxic") > 0).cast("int").alias("label"), "text", F.xxhash64("doc_id", F.lit(1)).alias("h"))
    shards = max(1, -(-min(total, sample_rows) // shard_rows))
    # by number, as a hash of so few shards would put some of them into one task
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("shard", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: dict[int, list[tuple[np.ndarray, int]]] = {}
        held = 0

        def learned_parts() -> Iterator[pa.RecordBatch]:
            for shard, own in examples.items():
                at, w = learn(own, rates, max(LEAST_STEPS, EPOCHS * len(own)))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * (len(at) + 1), pa.int32()), pa.array([-1, *at], pa.int64()), pa.array([float(len(own)), *(w * len(own))], pa.float64())], ["shard", "place", "weight"])

        for batch in small_batches(batches):
            owner, place = feature_places(batch.column(1))
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
            for i, (label, shard) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = np.unique(place[order[ends[i] : ends[i + 1]]])
                examples.setdefault(shard, []).append((np.concatenate([[0], own]).astype(np.int32), label))
                held += len(own)
            if held > shard_features:
                yield from learned_parts()
                examples.clear()
                held = 0
        yield from learned_parts()

    learned = staged(rows.select("label", "text", "h", "shard").mapInArrow(run, "shard int, place long, weight double"), "weights")
    n_rows = learned.filter("place = -1").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    mean = learned.filter("place >= 0").groupBy("place").agg((F.sum("weight") / max(n_rows, 1)).alias("weight")).orderBy("place")
    found = mean.toArrow()  # at most DIMENSIONS rows, whatever the corpus
    return Model(found.column("place").to_numpy().astype(np.int64), found.column("weight").to_numpy(), int(n_rows))


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row of ``docs``, its ``score`` and ``predicted``."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = pick(docs, *columns, "text").withColumn("text", F.lower("text")) if "text" not in columns else pick(docs, *columns).withColumn("lw_text", F.lower("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        dense = np.zeros(DIMENSIONS)
        dense[own.places] = own.weights
        bias = dense[0]
        for batch in small_batches(batches, len(columns)):
            owner, place = feature_places(batch.column(len(columns)))
            on = np.flatnonzero(dense[place])
            pairs = np.unique(np.stack([owner[on], place[on]], axis=1), axis=0) if len(on) else np.zeros((0, 2), np.int64)
            total = bias + np.bincount(pairs[:, 0], dense[pairs[:, 1]], batch.num_rows)
            out = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))) if own.rows else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(out), pa.array((out >= 0.5).astype(np.int32))], [*columns, "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(columns)]]
    return rows.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def op10_ftrl_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
