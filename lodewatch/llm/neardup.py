"""Near-duplicate documents by SetSketch registers, joint likelihood and a check on full sets.

A document is the set of its distinct k-word shingles. Its sketch holds, for each register, a truncated minimum of
exponential values, on a scale of powers of ``BASE``: the spacings of a shingle's ascending values shrink exponentially
distributed over a permutation of the registers, so few of them are made before they exceed all minima (Ertl, "SetSketch:
filling the gap between MinHash and HyperLogLog", 2021). Equal registers mark likely similar sets.

1. Documents of one set form a class; from here on classes stand for all their copies.
2. Bands of registers are bucketed. Each class is paired with the least and the greatest class of each of its buckets,
   a number of pairs in proportion to the classes however large a bucket is.
3. A pair stays if the likelihood of its register comparison, joint with the known set sizes, does not speak against the
   wanted similarity by ``SIGMAS`` standard deviations.
4. What stays is confirmed on the full sets, and components are taken.
5. Buckets whose classes still lie in several components are compared in full, in blocks of bounded size: classes with a
   partner in another component that passes step 3 are confirmed as in step 4, all pairs of two blocks at once, and the
   components taken again.

Defined cases: a document without words is linked with nothing and is its own component; null text is no text; rows that
share an id and a set share a class; a null id is a document, and never the smallest id where its component holds
another; an empty table gives no rows; extra columns are left alone.

Words are hashed as ``wordhash`` says, shingles and sets to 64 and 128 bits, so sets that differ compare as equal only by
chance.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, short_batches, staged
from .components import components
from .wordhash import SPACES, mixed, small_batches, windows, word_hashes

REGISTERS, BAND, BASE, RATE = 128, 5, 1.001, 20.0
SIGMAS = 6.0
#: Classes of one block of a bucket that is compared in full.
BLOCK = 256


# --- sets and sketches


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, bounds = windows(*word_hashes(texts, SPACES), k)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def set_name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    one, two = mixed(s + np.uint64(0x5851F42D4C957F2D)), mixed(s ^ np.uint64(0x14057B7EF767814F))
    return int(mixed(one.sum(keepdims=True)).view(np.int64)[0]), int(mixed(two.sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def sketch(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """uint16 registers of each set, a row a set."""
    n = len(sets)
    least = np.full(n * m, np.inf)
    element = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    x = np.zeros(len(element))
    shift, stride = mixed(element ^ np.uint64(0xD6E8FEB86659FD93)), mixed(element + np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    for j in range(m):
        u = (mixed(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64)
        x = x - np.log((u + 0.5) / 2.0**53) / (m - j)
        if j:
            on = x < least.reshape(n, m).max(axis=1)[owner]
            element, owner, x, shift, stride = element[on], owner[on], x[on], shift[on], stride[on]
            if not len(x):
                break
        place = (shift + np.uint64(j) * stride) & np.uint64(m - 1)  # a permutation of the registers: the stride is odd
        place ^= place >> np.uint64(3)
        np.minimum.at(least, owner * m + place.astype(np.int64), x)
    with np.errstate(divide="ignore"):
        value = np.floor(1.0 - np.log(least.reshape(n, m) / RATE) / np.log(BASE))
    return np.clip(value, 0, 65535).astype(np.uint16)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, f1, f2, regs) of each row; a row without words has n = 0 and no sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = shingle_sets(batch.column(1), k)
            full = [s for s in sets if len(s)]
            rows = iter(sketch(full))
            regs = [next(rows).tobytes() if len(s) else None for s in sets]
            names = [set_name(s) if len(s) else (None, None) for s in sets]
            columns = [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)], pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "regs"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n long, f1 long, f2 long, regs binary")


# --- joint estimation


def likely(more: np.ndarray, less: np.ndarray, m: int, n1: np.ndarray, n2: np.ndarray, least: float) -> np.ndarray:
    """Whether a similarity of ``least`` or more fits: registers in which the first is more or less, and the set sizes.

    The log-likelihood of the similarity is concave; its maximum is found by thirds and compared with that at ``least``.
    """
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    same = m - more - less

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    most = np.minimum(u / v, v / u)
    low, high = np.zeros(len(u)), most.copy()
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = log_likelihood(a) > log_likelihood(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    best = (low + high) / 2
    wanted = np.minimum(least, most)
    return (most >= least - 1e-9) & ((best >= wanted) | (2 * (log_likelihood(best) - log_likelihood(wanted)) <= SIGMAS**2))


def registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint16).reshape(len(column), -1)


def fitting(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sketches fit a similarity of ``least``."""
    for side in "ab":
        own = classes.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("regs").alias(f"regs_{side}"))
        pairs = pairs.join(own, side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = registers_of(batch.column(4)), registers_of(batch.column(5))
                n1, n2 = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
                on = likely((one > two).sum(axis=1), (one < two).sum(axis=1), one.shape[1], n1, n2, least)
                yield batch.select([0, 1]).filter(pa.array(on))

    return pairs.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


# --- confirmation


def full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(cid, shingles) of the classes ``wanted`` (cid), from the texts of one document each."""
    ids = wanted.distinct().join(classes.select("cid", "first_id"), "cid").select("first_id").distinct()
    texts = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["first_id"]), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [s for s in shingle_sets(batch.column(1), k) if len(s)]
            names = [set_name(s) for s in found]
            columns = [*[pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)], pa.array([s.tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["f1", "f2", "shingles"])

    full = texts.mapInArrow(sets, "f1 long, f2 long, shingles binary")
    # ids that are given twice may bring other sets, or one set twice
    return staged(full.join(classes.select("cid", "f1", "f2"), ["f1", "f2"]).select("cid", "shingles").dropDuplicates(["cid"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` with 100 * |intersection| >= percent * |union| on full sets."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("cid").alias(side), F.col("shingles").alias(f"set_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, two))
                both = len(np.intersect1d(one, two, assume_unique=True))
                on.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(on, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


# --- candidates


def bands(classes: DataFrame, m: int = REGISTERS, band: int = BAND) -> DataFrame:
    """(cid, nr, bucket) of each class and band."""
    rows = classes.select("cid", "regs", F.explode(F.sequence(F.lit(0), F.lit(m // band - 1))).alias("nr"))
    # registers take two bytes each, and places count from 1
    return rows.select("cid", "nr", F.xxhash64("nr", F.substring("regs", F.col("nr") * (2 * band) + 1, F.lit(2 * band))).alias("bucket"))


def grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first ``key`` columns; a run may go on over batches."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if not held or (batch is not None and not batch.num_rows):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        k = np.stack([table.column(c).to_numpy() for c in range(key)], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        if batch is not None:
            held = table.slice(cuts[-2]).to_batches()
            cuts.pop()
        for start, end in itertools.pairwise(cuts):
            yield table.slice(start, end - start)


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, i, j, nr, own, cid, label): the classes of buckets that hold several components, dealt to pairs of blocks.

    Only pairs across components matter, so the largest component of a bucket is not paired with itself: the others are
    paired with it and with each other. Each pair of blocks of at most about ``BLOCK`` classes is a group.
    """
    rows = members.filter("size > 2").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    rows = staged(rows.select("cid", "nr", "bucket", "size", F.coalesce("label", "cid").alias("label")), "labelled")
    parts = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("n_major"), F.count("*").alias("n_labels"))
    # written, as a join can be split at a hot bucket only where both its sides come straight from a shuffle
    rows = rows.join(staged(largest.filter("n_labels > 1").drop("n_labels"), "largest"), "bucket")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    small = F.col("size") <= 2 * BLOCK
    rows = rows.withColumns({"minor": F.col("label") != F.col("major"), "ones": F.when(small, 1).otherwise(blocks(F.col("size") - F.col("n_major"))), "twos": F.when(small, 0).otherwise(blocks(F.col("n_major")))})
    place = lambda n: F.pmod(F.xxhash64("cid", F.lit(3)), n).cast("int")
    rows = rows.withColumn("own", F.when(F.col("minor") | small, place(F.col("ones"))).otherwise(F.col("ones") + place(F.greatest("twos", F.lit(1)))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("minor"), F.col("ones") + F.col("twos")).otherwise(F.col("ones")) - 1)))
    return rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "nr", "own", "cid", "label")


def across(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, band: int = BAND) -> DataFrame:
    """Links (a, b) that join the components of classes sharing a bucket; nothing is left out.

    First the sketches tell which classes of a group have a likely partner in another component; a pair is looked at in
    the first band that it shares. The full sets of these classes are then compared group by group, all pairs by one
    matrix product, and a group gives no more links than it takes to join its classes.
    """
    spark, key, least = members.sparkSession, ["bucket", "i", "j"], percent / 100
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(n, *key).sortWithinPartitions(*key)
    rows = open_members(members, labels).join(classes.select("cid", "n", "regs"), "cid")

    def apart(i: int, j: int, own: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = np.repeat(one, len(two)), np.tile(two, len(one))
        on = (label[a] != label[b]) & ((i != j) | (a < b))
        return a[on], b[on]

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            (_, i, j, nr), (own, cid, label, size) = [group.column(c)[0].as_py() for c in range(4)], [group.column(c).to_numpy() for c in range(4, 8)]
            a, b = apart(i, j, own, label)
            if not len(a):
                continue
            regs = registers_of(group.column(8).combine_chunks())
            hit = np.zeros(len(cid), bool)
            for at in range(0, len(a), 1 << 14):
                x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                if nr:
                    same = (regs[x, : nr * band] == regs[y, : nr * band]).reshape(len(x), nr, band)
                    first = ~same.all(axis=2).any(axis=1)
                    x, y = x[first], y[first]
                on = likely((regs[x] > regs[y]).sum(axis=1), (regs[x] < regs[y]).sum(axis=1), regs.shape[1], size[x].astype(float), size[y].astype(float), least)
                hit[x[on]] = hit[y[on]] = True
            yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in group.select([0, 1, 2, 4, 5, 6]).filter(pa.array(hit)).columns], [*key, "own", "cid", "label"])

    found = staged(dealt(rows.select(*key, "nr", "own", "cid", "label", "n", "regs")).mapInArrow(partners, "bucket long, i int, j int, own int, cid long, label long"), "partners")
    sets = full_sets(found.select("cid"), classes, docs, k)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            (i, j), (own, cid, label) = [group.column(c)[0].as_py() for c in (1, 2)], [group.column(c).to_numpy() for c in range(3, 6)]
            a, b = apart(i, j, own, label)
            if not len(a):
                continue
            shared = intersections([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(6)])
            sizes = np.array([len(x.as_buffer()) // 8 for x in group.column(6)])
            both = shared[a, b]
            on = 100 * both >= percent * (sizes[a] + sizes[b] - both)
            a, b = spanning(label, a[on], b[on])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[a], cid[b])), pa.array(np.maximum(cid[a], cid[b]))], ["a", "b"])

    return dealt(found.join(sets, "cid").select(*key, "own", "cid", "label", "shingles")).mapInArrow(links, "a long, b long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections. Only shingles that two sets hold have a column, and columns are multiplied in parts."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1
    number = np.where(often, np.cumsum(often) - 1, -1)[column]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    row, number = row[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(often.sum()), 4096):
        s, e = np.searchsorted(number, [at, at + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[s:e], number[s:e] - at] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links (a, b), those that join labels that the ones before haven't joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        one, two = root(int(label[x])), root(int(label[y]))
        if one != two:
            parent[one] = two
            kept[0].append(x)
            kept[1].append(y)
    return kept


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, band: int = BAND) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    A lower ``percent`` needs shorter bands: a link of similarity s is missed with a chance of about (1 - s**band) ** (REGISTERS // band).
    """
    least = percent / 100
    short_batches(docs.sparkSession)
    rows = staged(sketches(docs, k), "sketches")
    classes = rows.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = bands(classes, band=band)
    heads = found.groupBy("bucket").agg(F.min("cid").alias("head"), F.max("cid").alias("tail"), F.count("*").alias("size")).filter("size > 1")
    # written, as a join can be split at a hot bucket only where both its sides come straight from a shuffle
    members = staged(found.join(staged(heads, "heads"), "bucket"), "members")
    ends = [members.filter(f"cid <> {end}").select(F.least(end, "cid").alias("a"), F.greatest(end, "cid").alias("b")) for end in ("head", "tail")]
    pairs = ends[0].unionByName(ends[1]).distinct()
    pairs = staged(fitting(pairs, classes, least), "pairs")
    sets = full_sets(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))), classes, docs, k)
    links = staged(confirmed(pairs, sets, percent), "confirmed")
    labels = staged(components(links), "labels")
    more = staged(across(members, labels, classes, docs, k, percent, band), "across")
    if not more.isEmpty():
        labels = staged(components(links.unionByName(more)), "labels")
    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("f1", "f2", "first_id", F.coalesce("label", "cid").alias("label"))
    least_ids = named.groupBy("label").agg(F.min("first_id").alias("component"))
    named = named.join(least_ids, "label").select("f1", "f2", "component")
    full = rows.filter("n > 0").join(named, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_setsketch_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
