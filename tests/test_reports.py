"""Report documents: their lines in order are JSON that holds every target and finding."""

import json
from pathlib import Path

from lodewatch.operators.reports import KEY, json_report, sarif_report, write_document
from lodewatch.operators.scoring import risk_order, score_targets
from lodewatch.plans.catalog import RULES

FINDINGS = [
    ("a", "x/run.py", "CODEEXEC-PY-EVAL", "critical", 'say "x"\n<é>', 3, 1, "eval(x)"), ("a", "x/run.py", "CODEEXEC-PY-EVAL", "critical", "m", 9, 2, "eval(x)"),
    ("a", "x/a b#.sh", "NET-RAW-SOCKET", "medium", "m", 1, 1, "s"), ("b", "/abs/SKILL.md", "CTX-NOTE", "info", "note", 1, 1, "t"), ("b", "/abs/SKILL.md", "CTX-NOTE", "info", "note", 5, 1, "t"),
]


def tables(spark):
    findings = spark.createDataFrame(FINDINGS, "target_id string, path string, rule_id string, severity string, message string, line int, column int, snippet string")
    targets = spark.createDataFrame([(t, "") for t in "abc"], "target_id string, tree_sha256 string")
    return risk_order(score_targets(targets, findings)), findings


def text_of(lines):
    return "".join(r.text for r in sorted(lines.collect(), key=lambda r: tuple(r[k] for k in KEY)))


def test_scan_report(spark, tmp_path):
    targets, findings = tables(spark)
    agents = spark.createDataFrame([("two", False, 0), ("one", True, 3)], "id string, installed boolean, skills_scanned long")
    lines = json_report(targets, findings, agents, "2026-01-01T00:00:00.000Z", 5, "1")
    got = json.loads(text_of(lines))
    assert list(got) == ["schema_version", "scan", "agents", "skills", "summary"] and [a["id"] for a in got["agents"]] == ["one", "two"]
    assert [s["id"] for s in got["skills"]] == ["a", "b", "c"] and [len(s["findings"]) for s in got["skills"]] == [3, 2, 0]
    assert {(f["file"], f["rule_id"], f["line"], f["message"]) for f in got["skills"][0]["findings"]} == {(f[1], f[2], f[5], f[4]) for f in FINDINGS if f[0] == "a"}
    assert got["skills"][0]["summary"] == {"critical": 1, "high": 0, "medium": 1, "low": 0, "info": 0, "score": 72, "verdict": "REVIEW", "mandatory_fail": []}
    assert got["summary"] == {"skills_scanned": 3, "compromised": 0, "percent_compromised": 0.0, "verdict": "REVIEW"}
    write_document(lines, str(tmp_path / "report"))
    written = "".join(p.read_text() for p in sorted(Path(tmp_path / "report").glob("part-*")))
    assert json.loads(written) == got
    none = json.loads(text_of(json_report(targets.limit(0), findings.limit(0), agents.limit(0), "t", 0, "1")))
    assert none["skills"] == [] and none["summary"]["verdict"] == "PASS"


def test_sarif_log(spark):
    targets, findings = tables(spark)
    run = json.loads(text_of(sarif_report(targets, findings, "1.0.0", "file:///h/pro ject")))["runs"][0]
    rules = run["tool"]["driver"]["rules"]
    assert [r["id"] for r in rules] == [*(r.rule_id for r in RULES), "CTX-NOTE"] and rules[0]["defaultConfiguration"] == {"level": "error"}
    assert run["originalUriBaseIds"] == {"%SRCROOT%": {"uri": "file:///h/pro%20ject/"}} and run["columnKind"] == "utf16CodeUnits"
    results = run["results"]
    assert all(rules[r["ruleIndex"]]["id"] == r["ruleId"] for r in results) and [r["level"] for r in results] == ["warning", "error", "error", "note", "note"]
    where = [r["locations"][0]["physicalLocation"]["artifactLocation"] for r in results]
    assert where[0] == {"uri": "x/a%20b%23.sh", "uriBaseId": "%SRCROOT%"} and where[3] == {"uri": "file:///abs/SKILL.md"}
    assert ["partialFingerprints" in r for r in results] == [False, False, False, True, True]
    assert sorted(r["partialFingerprints"]["primaryLocationLineHash"][-2:] for r in results[3:]) == [":1", ":2"]
    assert json.loads(text_of(sarif_report(targets.limit(0), findings.limit(0), "1", "file:///h")))["runs"][0]["results"] == []
