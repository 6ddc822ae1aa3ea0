"""Targets of equal content merged, and targets on the ignore list set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbours(path: Column, first: str, second: str) -> Column:
    """Whether the path has the one segment directly before the other."""
    return F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{first}/{second}/")


def path_rank(path: Column) -> Column:
    """Installed paths first, then caches, then marketplaces, then marketplace caches."""
    market, cache = neighbours(path, "plugins", "marketplaces"), neighbours(path, "plugins", "cache")
    return F.when(~market & ~cache, 0).when(~market, 1).when(~cache, 2).otherwise(3)


def merge_equal(targets: DataFrame) -> DataFrame:
    """``targets`` (agent_id, path, tree_sha256) with one row for each non-empty hash: its primary path, its agents and how many paths it has.

    Agents are few; paths may be many, so they are counted here and listed by ``member_paths``.
    """
    merged = targets.filter("tree_sha256 <> ''").groupBy("tree_sha256").agg(F.min_by("path", F.struct(path_rank(F.col("path")), "path")).alias("path"), F.array_sort(F.collect_set("agent_id")).alias("agent_ids"), F.count_distinct("path").cast("int").alias("n_paths"))
    alone = targets.filter("coalesce(tree_sha256, '') = ''").select(F.lit("").alias("tree_sha256"), "path", F.array("agent_id").alias("agent_ids"), F.lit(1).alias("n_paths"))
    return merged.unionByName(alone)


def member_paths(targets: DataFrame) -> DataFrame:
    """(tree_sha256, path): all paths of each non-empty hash, one a row."""
    return targets.filter("tree_sha256 <> ''").select("tree_sha256", "path").distinct()


def split_ignored(targets: DataFrame, ignored: DataFrame) -> DataFrame:
    """``targets`` with ``ignored``: whether the hash is on the list (tree_sha256)."""
    known = ignored.select("tree_sha256").filter("tree_sha256 <> ''").distinct().withColumn("on_list", F.lit(True))
    return targets.join(known, "tree_sha256", "left").withColumn("ignored", F.coalesce("on_list", F.lit(False))).drop("on_list")
