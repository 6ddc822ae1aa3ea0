"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b), label being the smallest node that it reaches.

    A large star joins a node's larger neighbours to its smallest one, a small star does so with the others. Both only
    take minima by node and join them back. Minima are summed up before the shuffle and written, so that the join can be
    split at a node of many links. Each round is written to the shared folder; the loop ends when a round changes nothing.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = staged(links.filter("a <> b").select(high, low).distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
