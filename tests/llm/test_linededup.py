"""Sorted runs of line hashes: merges without a shuffle or sort, later batches, another session's runs, awkward tables."""

import collections
import re

from pyspark.sql import functions as F

from lodewatch.llm import linededup
from lodewatch.staging import staged


def test_runs_are_merged_in_order_and_opened_again(spark):
    keys = staged(spark.range(3000).selectExpr("id", "explode(sequence(0, 4)) AS j").selectExpr("id", "xxhash64((id * 7 + j * j * 31) % 2000) AS h1", "xxhash64(1, (id * 7 + j * j * 31) % 2000) AS h2").distinct(), "test-keys")
    tables = spark.sql("SHOW TABLES").count()
    runs = linededup.LineRuns.new(spark, fan_out=3)
    for b in range(7):
        if b == 4:  # a later session goes on
            runs = linededup.LineRuns.open(spark, runs.root)
        runs.add(keys.filter(f"id % 7 = {b}"))
        held = [runs._read(r).select("h1", "h2").collect() for r in runs.runs()]
        flat = [tuple(x) for run in held for x in run]
        assert len(flat) == len(set(flat))  # no key stands in two runs
    assert [len(level) for level in runs.levels] == [1, 2] and len(runs.changes) == 6
    wanted = {(r.h1, r.h2, r.last) for r in keys.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")).filter("n >= 6").collect()}
    assert wanted and sorted(map(tuple, runs.surplus(6).collect())) == sorted(wanted)
    with linededup.read_in_order(spark):
        one, two = (runs._read(r) for r in runs.runs()[:2])
        plan = one.hint("merge").join(two.select("h1", "h2"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert spark.sql("SHOW TABLES").count() == tables


def cleaned(rows, least, chars):
    """[(id, text, lines, dropped)] by a dictionary of keys."""
    lines = lambda t: (t or "").split("\n")
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in lines(t):
            if len(key(x)) >= chars:
                held[key(x)].add(i)
    last = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in held.items() if len(ids) >= least}
    out = []
    for i, t in rows:
        kept = [x for x in lines(t) if last.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines(t)), len(lines(t)) - len(kept)))
    return out


def test_lines_of_awkward_documents(spark):
    line, other, short = "A line that is long enough", "Éine andere Zeile, die lang ist", "short line"
    rows = [(1, f"{line}\nown\n{line}"), (2, f"\t{line.upper()} \r\nown two"), (3, line), (4, f"{other}\n{short}"), (5, f"  {other}"), (6, f"{other.replace('É', 'é')}\n{other}\n\n"), (7, None), (8, ""), (None, f"x\n{line}"), (2, line), (9, short), (10, short)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_lines string, lost int")
    got = linededup.dedup_lines(table, batches=3).collect()
    assert sorted(map(repr, ((r[0], r[1], r[2], r[3]) for r in got))) == sorted(map(repr, cleaned(rows, 3, 20)))
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_line_of_a_third_of_all_documents_is_split(spark, tmp_path):
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.files.maxPartitionBytes": "64k"}
    keys = spark.range(60_000).selectExpr("id", "if(id % 3 = 0, 1L, id * 7919) AS h1", "if(id % 3 = 0, 2L, id) AS h2")
    keys.write.parquet(f"{tmp_path}/keys")
    spark.createDataFrame([(1, 2, 59_997)], "h1 long, h2 long, last long").write.parquet(f"{tmp_path}/surplus")
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        lost = linededup.lost_keys(spark.read.parquet(f"{tmp_path}/keys"), spark.read.parquet(f"{tmp_path}/surplus"))
        rows = lost.collect()
        assert "isFinalPlan=true" in (plan := lost._jdf.queryExecution().executedPlan().toString()) and "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 19_999 and all(r.lost == [(1, 2)] for r in rows)
