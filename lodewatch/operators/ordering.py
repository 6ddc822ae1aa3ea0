"""One running number over a whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Rows of a range, about.
RANGE_ROWS = 200_000


def ranked(rows: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in the order of ``keys``, nulls first; equal keys are numbered as they come.

    Rows are sorted by ranges, as many as their number asks for, and written once. The id of a row holds its range and its
    place there, and a range starts where the rows before it end; only the sizes of ranges are broadcast, a row each.
    """
    if ranges is None:
        ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    ordered = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    # the id holds the range above its 33 low bits
    parts = staged(ordered.withColumn("at", F.monotonically_increasing_id()), "ranked").withColumn("range", F.shiftright("at", 33))
    sizes = parts.groupBy("range").agg(F.count("*").alias("n"))
    starts = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return parts.join(F.broadcast(starts), "range").withColumn("rank", rank.cast("int")).drop("range", "at", "start")
