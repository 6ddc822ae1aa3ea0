"""Hashes of trees, folded in order."""

import hashlib

from pyspark.sql import functions as F

from lodewatch.sources.files import tree_hash

ROW = "target_id string, rel_path string, sha256 string, alias string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_lines_aliases_and_single_files(spark):
    rows = [("t", "b", "2", None), ("t", "a", "1", None), ("t", "l", None, "d"), ("t", "a", "1", None), ("t", "x", None, None), ("one", "", "77", None), ("none", "x", None, None), ("é", "ü", "3", None)]
    found = {r.target_id: r.tree_sha256 for r in tree_hash(spark.createDataFrame(rows, ROW)).collect()}
    assert found == {"t": sha("a:1\nb:2\nl:alias:d"), "one": "77", "none": "", "é": sha("ü:3")}
    assert tree_hash(spark.createDataFrame([], ROW)).collect() == []


def test_large_targets_are_a_stream_of_sorted_lines(spark):
    files = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("target_id"), F.concat(F.lit("f/"), F.xxhash64("id")).alias("rel_path"), F.hex("id").alias("sha256"))
    wanted = {}
    for r in files.collect():
        wanted.setdefault(r.target_id, []).append(f"{r.rel_path}:{r.sha256}")
    found = tree_hash(files)
    assert {r.target_id: r.tree_sha256 for r in found.collect()} == {t: sha("\n".join(sorted(lines))) for t, lines in wanted.items()}
    assert "collect_list" not in found._jdf.queryExecution().toString()
