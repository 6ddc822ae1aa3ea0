"""Files as rows: a folder tree, and the hash of a target's tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import owners
from ..operators.ordering import ranked


def folder_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, bytes, sha256, modified) of each file under ``root``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of runs of lines that come in order; no more than a batch is held."""
    target, digest, done = None, None, []
    for batch in batches:
        for owner, line, lone in batch.itertuples(index=False):
            if digest is None or owner != target:
                if digest is not None:
                    done.append((target, digest if isinstance(digest, str) else digest.hexdigest()))
                target, digest = owner, lone if isinstance(lone, str) else hashlib.sha256(line.encode())
            elif not isinstance(digest, str):
                digest.update(b"\n" + line.encode())
        yield pd.DataFrame(done, columns=["target_id", "tree_sha256"])
        done = []
    if digest is not None:
        yield pd.DataFrame([(target, digest if isinstance(digest, str) else digest.hexdigest())], columns=["target_id", "tree_sha256"])


def tree_hash(files: DataFrame) -> DataFrame:
    """(target_id, tree_sha256): the hash of the sorted lines of each target's files (target_id, rel_path, sha256 and, if wanted, alias).

    A line is ``path:sha256``, or ``path:alias:place`` for a link to a folder of the target that is listed at ``alias``. A
    target that is one file (empty rel_path) has the hash of the file. Rows without a hash or alias can't be read and are left
    out; a target whose rows are all so has the hash ''. Repeated rows count once. A hash takes its lines one after the other, so a
    target's lines go through one task, sorted by Spark and read as a stream: that task holds one batch of them.
    """
    alias = F.col("alias") if "alias" in files.columns else F.lit(None).cast("string")
    line = F.when(alias.isNotNull(), F.concat("rel_path", F.lit(":alias:"), alias)).otherwise(F.concat("rel_path", F.lit(":"), F.col("sha256")))
    rows = files.select("target_id", line.alias("line"), F.when((F.col("rel_path") == "") & alias.isNull(), F.col("sha256")).alias("lone")).distinct()
    lines = rows.filter("line IS NOT NULL").repartition("target_id").sortWithinPartitions("target_id", F.col("lone").isNull(), "line")
    hashed = lines.mapInPandas(_fold, f"target_id {files.schema['target_id'].dataType.simpleString()}, tree_sha256 string")
    unread = files.groupBy("target_id").agg(F.count_if(line.isNotNull()).alias("n")).filter("n = 0").select("target_id", F.lit("").alias("tree_sha256"))
    return hashed.unionByName(unread)


def path_targets(files: DataFrame) -> DataFrame:
    """(target, path, nr) of the files of one tree (path, relative): each belongs to the deepest folder above that holds a manifest.

    ``target`` is that folder, '' for what lies outside all of them. ``nr`` orders targets: the root first, if it has
    files of its own, then by path. A tree without files has no targets.
    """
    owned = owners(files.select(F.lit("").alias("tree"), "path")).select("target", "path")
    targets = ranked(owned.select("target").distinct(), ["target"]).withColumnRenamed("rank", "nr")
    return owned.join(targets, "target")


def within_limit(files: DataFrame, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The files that can be read, and (path, error) of those beyond the limit: they make a scan incomplete, never clean."""
    return files.filter(F.col("bytes") <= most_bytes), files.filter(F.col("bytes") > most_bytes).select("path", F.concat(F.lit("larger than "), F.lit(most_bytes), F.lit(" bytes")).alias("error"))
