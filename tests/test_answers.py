"""Answers of models, mended and read."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lodewatch.operators.answers import category_of, closed, mended, read_answers, says_nothing

GOOD = {"severity": " High", "category": "Shell command", "confidence": "0.75", "rationale": " runs curl ", "file": " a.sh ", "suggested_fix": "none"}
AS_READ = ("high", "code-execution", 0.75, "runs curl", "a.sh", None)


def read(spark, *answers):
    rows = read_answers(spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "nr int, answer string")).orderBy("nr").collect()
    return [(r.status, None if r.findings is None else [tuple(f) for f in r.findings]) for r in rows]


def wrapped(*findings):
    return json.dumps({"findings": list(findings)})


def test_mending():
    assert closed('{"a": [1') == '{"a": [1]}' and closed('{"a": [{"b": "]}"}') == '{"a": [{"b": "]}"}]}' and closed('{"a": [1}') == '{"a": [1]}'
    assert [closed(t) for t in ('{"a": "x', '{"a": 1,', '{"a": 1}', "[1", "{]", '{"a": "x\\', '{"a"}}')] == [None] * 7
    assert json.loads(mended('{\\"a\\": \\"b\\"}')) == {"a": "b"} and json.loads(mended('{"a": 1, "a": {"b": 2}')) == {"a": {"b": 2}}
    assert [mended(t) for t in (None, "", "no", "{'a': 1}", "NaN")] == [None] * 5


@pytest.mark.parametrize("text", ["{" * 200_000, '{"' + "\\" * 200_001, '{"a":' + " " * 200_000, "{" + '\\"' * 100_000, "{" + ", " * 100_000])
def test_hostile_answers_end_soon(text):
    began = time.time()
    mended(text)
    assert time.time() - began < 3


def test_answers(spark):
    cut = wrapped(GOOD)[:-2]
    found = read(spark, wrapped(GOOD), cut, wrapped(), wrapped(GOOD, {**GOOD, "rationale": "None."}), wrapped({**GOOD, "confidence": 1}), wrapped({k: v for k, v in GOOD.items() if k != "confidence"}), wrapped({**GOOD, "file": "", "file_path": "b"}))
    assert found[:4] == [("ok", [AS_READ]), ("ok", [AS_READ]), ("ok", []), ("ok", [AS_READ])]
    assert [f[1][0][2] for f in found[4:6]] == [1.0, 0.5] and found[6][1][0][4] == "b"
    bad = [{**GOOD, "severity": "huge"}, {**GOOD, "severity": 1}, {**GOOD, "category": "a|prompt"}, {**GOOD, "category": "tea"}, {**GOOD, "confidence": 2}, {**GOOD, "confidence": "1d"}, {**GOOD, "confidence": None}, {**GOOD, "file": 3}, {**GOOD, "file_path": None}, "x", None]
    assert read(spark, *[wrapped(GOOD, b) for b in bad], '{"findings": {}}', "[]", "", None) == [("invalid-response", None)] * (len(bad) + 4)


def test_normal_forms(spark):
    rows = spark.createDataFrame([(x,) for x in ("Prompt stuff", "git commit history", "history in git", "network", "secrets", "x|y", "credential file", "")], "t string")
    assert [r[0] for r in rows.select(category_of(F.col("t"))).collect()] == ["prompt-injection", "git-history", "git-history", "network", "secrets", None, "filesystem", None]
    rows = spark.createDataFrame([(x,) for x in ("", " None. ", "No unsafe things", "It is secure", "no risk was found", "notes found", "nothing")], "t string")
    assert [r[0] for r in rows.select(says_nothing(F.col("t"))).collect()] == [True, True, True, True, True, False, False]
