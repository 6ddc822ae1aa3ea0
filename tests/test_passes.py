"""Names that select rules, and one finding of several passes."""

import pytest
from pyspark.sql import functions as F

from lodewatch.operators.passes import first_of_passes, interpreter_of, match_passes, passes

HEADS = [
    ("#!/bin/sh -e\nx", "sh"), ("#!/usr/bin/env -S bash -e\n", "bash"), ("#!/usr/bin/env A=1 python3.12\r\n", "python"), ("#! /usr/local/bin/node18", "node"),
    ("# no\n#!/bin/sh", None), ("", None), (None, None), ("#!/usr/bin/env -S", None), ("#!/opt/" + "x" * 300 + "/bash\n", "x" * 249),
]


@pytest.mark.parametrize("nr", range(len(HEADS)))
def test_interpreters(spark, nr):
    text, wanted = HEADS[nr]
    row = spark.createDataFrame([(text,)], "t string").select(interpreter_of(F.col("t"))).first()
    assert row[0] == wanted


def names(spark, rows, schema):
    return [(r.scan_path, r["pass"]) for r in passes(spark.createDataFrame(rows, schema)).orderBy("pass").collect()]


def test_names_of_files(spark):
    schema = "target_id string, path string, content string"
    assert names(spark, [("t", "a/setup", "#!/bin/bash\n")], schema) == [("a/setup", 0), ("a/setup.sh", 1)]
    assert names(spark, [("t", "run.sh", "#!/bin/bash\n")], schema) == [("run.sh", 0)]
    assert names(spark, [("t", "x.txt", "#!/usr/bin/perl\n")], schema) == [("x.txt", 0)]
    given = schema + ", scan_names array<string>, rule_scan_content string"
    assert names(spark, [("t", "d/hook", "#!/bin/bash\n", ["hook.py", "hook.sh", "hook.py"], None)], given) == [("d/hook.py", 0), ("d/hook.sh", 1)]
    assert names(spark, [("t", "d/.mcp.json", "#!/bin/bash\n", None, "#!/bin/sh\n{}")], given) == [("d/.mcp.json", 0)]


def test_scripts_without_extension_get_the_rules_of_their_language(spark):
    files = spark.createDataFrame([("t", "bin/tool", "#!/usr/bin/env python3\nresult = eval(x)\n"), ("t", "bin/other", "result = eval(x)\n")], "target_id string, path string, content string")
    assert [(r.path, r.rule_id, r.line, r["pass"]) for r in first_of_passes(match_passes(files)).collect()] == [("bin/tool", "CODEEXEC-PY-EVAL", 2, 1)]


def test_two_passes_give_one_finding(spark):
    rows = [("t", "hook", "os.system(c); eval(x)\ncat ~/.aws/credentials\n", ["hook.py", "hook.sh"], None), ("t", ".mcp.json", "eval(x)", ["a.py"], "y = 1\nz = eval(x)")]
    files = spark.createDataFrame(rows, "target_id string, path string, content string, scan_names array<string>, rule_scan_content string")
    matches = match_passes(files)
    found = first_of_passes(matches).collect()
    place = [(r.path, r.rule_id, r.line) for r in found]
    assert len(place) == len(set(place)) and ("hook", "FS-CREDSTORE", 2) in place and (".mcp.json", "CODEEXEC-PY-EVAL", 2) in place
    twice = [r for r in matches.filter("path = 'hook' AND rule_id = 'FS-CREDSTORE'").collect()]
    assert {r["pass"] for r in twice} == {0, 1} and {r["pass"] for r in found if r.rule_id == "FS-CREDSTORE"} == {0}
