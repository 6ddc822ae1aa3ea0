"""Failed and ignored targets, incomplete runs and the footer."""

from lodewatch.operators.outcomes import agent_scans, footer, kept_findings, of_agent, outcomes, run_state, withheld_if_incomplete

TARGET = "target_id string, agent_id string, agent_ids array<string>, state string, ignored boolean"
ROWS = [("a", "x", ["x", "y"], "installed", False), ("b", "x", ["x"], "marketplace", True), ("c", "y", ["y"], "installed", False), ("d", "y", ["x", "x"], "installed", False)]


def tables(spark, errors=(("c", "late"), ("c", "early"), ("b", "lost"))):
    targets = spark.createDataFrame(ROWS, TARGET)
    errors = spark.createDataFrame(list(errors), "target_id string, error string")
    return targets, errors, outcomes(targets, errors)


def test_errors_take_targets_out(spark):
    _, _, decided = tables(spark)
    assert {r.target_id: (r.outcome, r.error) for r in decided.collect()} == {"a": ("scanned", None), "b": ("ignored", None), "c": ("failed", "early"), "d": ("scanned", None)}
    assert {r.agent_id: (r.scanned, r.ignored) for r in agent_scans(decided).collect()} == {"x": (3, 1), "y": (1, 0)}
    assert {r.target_id for r in kept_findings(decided.select("target_id"), decided).collect()} == {"a", "d"}


def test_incomplete_runs_have_no_log(spark):
    verdicts = spark.createDataFrame([("a", "REVIEW"), ("b", "FAIL"), ("c", "FAIL")], "target_id string, verdict string")
    lines = spark.createDataFrame([(1, "x"), (2, "y")], "nr int, text string")
    for errors, state, left in (([("c", "e")], (3, 1, 1, True, "REVIEW", 3), 0), ([(None, "e")], (3, 0, 1, True, "FAIL", 1), 0), ([], (3, 0, 1, False, "FAIL", 1), 2), ([("b", "e")], (3, 0, 1, False, "FAIL", 1), 2)):
        _, failed, decided = tables(spark, errors)
        run = run_state(decided, verdicts, failed)
        assert tuple(run.first()) == state and withheld_if_incomplete(lines, run).count() == left
    nothing = spark.createDataFrame([], TARGET)
    empty = run_state(outcomes(nothing, failed), verdicts.limit(0), failed.limit(0))
    assert tuple(empty.first()) == (0, 0, 0, False, "PASS", 0)


def test_agents_before_and_after_merging(spark):
    targets, _, _ = tables(spark)
    ids = lambda *args: {r.target_id for r in of_agent(targets, *args).collect()}
    assert ids("y", False) == {"c", "d"} and ids("y", True) == {"c"} and ids(None, True) == set("abcd")


def test_footer(spark):
    _, _, decided = tables(spark)
    findings = spark.createDataFrame([("a", "low"), ("a", "high"), ("b", "critical"), ("c", "high"), ("d", "info")], "target_id string, severity string")
    summaries = spark.createDataFrame([("a", "FAIL"), ("b", "FAIL"), ("d", "PASS")], "target_id string, verdict string")
    lines = [r.text for r in footer(decided, summaries, findings, {"x": "Agent X"}).orderBy("nr").collect()]
    assert lines == ["  Targets scanned........... 3", "  Agents scanned............ Agent X: 3, y: 1", "  Install state............. installed: 2, marketplace: 1", "  Unique issues............. 2  (0 critical, 1 high, 0 medium, 0 low, 1 info)", "  Compromised targets....... 1   (33% of scanned)"]
    none = footer(decided.limit(0), summaries, findings).orderBy("nr").collect()
    assert [r.nr for r in none] == [1, 4, 5] and none[2].text.endswith(" 0")
