"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a few bits each, the cells are numbered along a Hilbert curve, rows are
sorted by that number and the sorted table is cut into runs. Rows that are near in all the columns come to lie in few
runs, so a filter on any of them prunes most files. Numbers are quantised at approximate quantiles of the rows, strings
at even ranks of their distinct values, compared whole, so a common prefix costs nothing.

The sort is one range partitioning with the id as last key: a hot cell is split like any other range. A row's place in
the whole order is its place in its partition plus the rows of the partitions before it, a table of one row for each
partition.

Defined cases: null text has no bytes and the checksum of the empty text; null in a dimension comes first; repeated
rows are placed one by one; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, scratch_path, staged


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """For frame s and corner c of an n-dimensional cube, at ``s * 2**n + c``: the digit of the corner and the frame inside it.

    A frame is an entry corner e and a direction d, numbered ``e * n + d`` (Hamilton's compact formulation).
    """
    mask = (1 << n) - 1

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x >> k) | (x << (n - k))) & mask

    def trailing_ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    digit, inside = [], []
    for s in range(n << n):
        e, d = divmod(s, n)
        for corner in range(1 << n):
            gray, w = turn(corner ^ e, d + 1), 0
            while gray:
                w ^= gray
                gray >>= 1
            even = 2 * ((w - 1) // 2) if w else 0
            way = 0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % n
            digit.append(w)
            inside.append((e ^ turn(even ^ (even >> 1), -(d + 1))) * n + (d + way + 1) % n)
    return digit, inside


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of the cell with these whole coordinates of ``bits`` bits."""
    n = len(axes)
    digits, frames = (F.array(*[F.lit(x) for x in t]) for t in curve_tables(n))

    def step(a, level):
        corner = F.lit(0)
        for j, x in enumerate(axes):
            corner = corner + F.expr("0") + F.when(F.get(F.array(*[F.floor(x / F.lit(float(1 << k))).cast("int") % 2 for k in range(bits)]), level) == 1, 1 << j).otherwise(0)
        at = a["frame"] * (1 << n) + corner
        return F.struct(F.get(frames, at).alias("frame"), (a["place"] * (1 << n) + F.get(digits, at)).alias("place"))

    start = F.struct(F.lit(0).alias("frame"), F.lit(0).cast("long").alias("place"))
    return F.aggregate(F.array(*[F.lit(k) for k in reversed(range(bits))]), start, step, lambda a: a["place"])


def bounds_of(rows: DataFrame, dim: str, bits: int) -> list:
    """Ascending values that cut ``dim`` into at most ``2**bits`` cells; as many numbers or whole strings reach the driver."""
    cells = 1 << bits
    if dict(rows.dtypes)[dim] in ("string", "binary"):
        values = rows.select(dim).filter(F.col(dim).isNotNull()).distinct().repartitionByRange(cells, dim)
        # the largest value of each range but the last
        found = sorted(r[0] for r in values.groupBy(F.spark_partition_id()).agg(F.max(dim)).select(f"max({dim})").collect())
        return found[:-1]
    shares = [k / cells for k in range(1, cells)]
    return sorted(set(rows.agg(F.percentile_approx(F.col(dim).cast("double"), shares, 1000)).first()[0] or []))


def quantised(value: Column, kind: str, bounds: list) -> Column:
    """How many of the ascending ``bounds`` lie below ``value``; null is 0."""
    if not bounds:
        return F.lit(0)
    value = value if kind in ("string", "binary") else value.cast("double")
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < value)), F.lit(0))


def along_curve(rows: DataFrame, dims: list[str], bits: int = 5, tie: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``curve`` (the Hilbert index) and ``place`` (0 and up in curve order, then by ``tie``), written once.

    Bounds of the quantisation are ``2**bits - 1`` values for each dimension.
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    axes = [quantised(F.col(d), kinds[d], bounds_of(rows, d, bits)) for d in dims]
    cells = [f"axis{i}" for i in range(len(dims))]
    rows = rows.withColumns(dict(zip(cells, axes, strict=True)))
    rows = rows.withColumn("curve", hilbert_index([F.col(c) for c in cells], bits)).drop(*cells)
    order = ["curve", *tie]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "curve")
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the id holds the partition above its 33 low bits and the place in the partition in them
    sorted_rows.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumns({"part": F.shiftright("at", 33), "inside": F.col("at").bitwiseAND((1 << 33) - 1)})
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    # a row for each partition of the sort, so far below what a broadcast may hold
    return rows.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("inside")).drop("part", "inside", "at", "start")


def shards(rows: DataFrame, dims: list[str], n_shards: int, bits: int = 5, tie: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``curve``, ``shard`` (runs of the curve order whose row counts are at most one apart) and ``slot`` in it."""
    ordered = along_curve(rows, dims, bits, tie)
    total = F.lit(ordered.count()).cast("long")
    shard = F.expr(f"place * {n_shards}L") / F.greatest(total, F.lit(1))
    ordered = ordered.withColumn("shard", F.floor(shard).cast("int"))
    first = F.ceil(F.col("shard").cast("long") * total / F.lit(n_shards)).cast("long")
    return ordered.withColumn("slot", F.col("place") - first).drop("place")


def op7_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source", "lang")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    # written, so that the texts are read once and not for the bounds, the ranges and the rows
    rows = staged(rows, "sizes")
    out = shards(rows, ["source", "lang", "size", "doc_id"], 24, tie=("text_crc32", "size", "doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
