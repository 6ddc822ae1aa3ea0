"""What became of each target of a run, and what a run that missed some may say.

An error takes its target out of a run and makes the run incomplete; the others go on. Targets on the ignore list count for their
agents but aren't scanned, so an error can't take them out. Errors of no target (those of discovery) make a run incomplete, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import SEVERITIES
from .inventory import exit_code, percent_text

# fixed values: widths of the footer
LABEL_WIDTH = 26


def of_agent(targets: DataFrame, agent: str | None, merged: bool) -> DataFrame:
    """The targets of one agent: of its own before equal ones are merged, of the first agent named afterwards. All without one."""
    if agent is None:
        return targets
    return targets.filter((F.get("agent_ids", F.lit(0)) if merged else F.col("agent_id")) == agent)


def outcomes(targets: DataFrame, errors: DataFrame) -> DataFrame:
    """``targets`` (target_id, ignored) with ``outcome`` (scanned, ignored or failed) and the least ``error`` of ``errors`` (target_id, error)."""
    first = errors.filter("target_id IS NOT NULL").groupBy("target_id").agg(F.min(F.coalesce("error", F.lit(""))).alias("error"))
    rows = targets.join(first, "target_id", "left")
    outcome = F.when(F.col("ignored"), "ignored").when(F.col("error").isNotNull(), "failed").otherwise("scanned")
    return rows.withColumn("outcome", outcome).withColumn("error", F.when(outcome == "failed", F.col("error")))


def kept_findings(findings: DataFrame, decided: DataFrame) -> DataFrame:
    """The findings of the targets that were scanned."""
    return findings.join(decided.filter("outcome = 'scanned'").select("target_id"), "target_id", "left_semi")


def agent_scans(decided: DataFrame) -> DataFrame:
    """(agent_id, scanned, ignored): targets by agent, each once; failed ones don't count."""
    rows = decided.filter("outcome <> 'failed'").select(F.explode(F.array_distinct("agent_ids")).alias("agent_id"), "outcome")
    return rows.groupBy("agent_id").agg(F.count("*").alias("scanned"), F.count_if(F.col("outcome") == "ignored").alias("ignored"))


def run_state(decided: DataFrame, verdicts: DataFrame, errors: DataFrame, fail_on: str = "FAIL", strict: bool = False) -> DataFrame:
    """One row: tried (scanned and failed), failed, ignored, incomplete, verdict and exit_code; ``verdicts`` (target_id, verdict)."""
    counts = decided.agg(F.count_if(F.col("outcome") != "ignored").alias("tried"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "ignored").alias("ignored"))
    scanned = verdicts.join(decided.filter("outcome = 'scanned'").select("target_id"), "target_id", "left_semi")
    worst = scanned.agg(F.when(F.count_if(F.col("verdict") == "FAIL") > 0, "FAIL").when(F.count_if(F.col("verdict") == "REVIEW") > 0, "REVIEW").otherwise("PASS").alias("verdict"))
    elsewhere = errors.agg(F.count_if(F.col("target_id").isNull()).alias("elsewhere"))
    one = lambda df: df.withColumn("run", F.lit(0))  # noqa: E731  (one row each)
    rows = one(counts).join(one(worst), "run").join(one(elsewhere), "run")
    incomplete = (F.col("failed") > 0) | (F.col("elsewhere") > 0)
    code = F.when(incomplete, exit_code(F.col("verdict"), fail_on, strict, True)).otherwise(exit_code(F.col("verdict"), fail_on, strict))
    return rows.select("tried", "failed", "ignored", incomplete.alias("incomplete"), "verdict", code.alias("exit_code"))


def withheld_if_incomplete(lines: DataFrame, run: DataFrame) -> DataFrame:
    """The lines of a log, or none: an upload closes the alerts that a log doesn't hold, and an incomplete run's holds too few."""
    return lines.withColumn("run", F.lit(0)).join(run.filter("incomplete").select(F.lit(0).alias("run")), "run", "left_anti").drop("run")


def footer(decided: DataFrame, summaries: DataFrame, findings: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(nr, text): the lines below a table of results.

    ``decided`` is ``outcomes`` with agent_ids and state; ``summaries`` has target_id and verdict. Targets count by their most
    severe finding. Agents are few, so their line is gathered.
    """
    label = lambda text: F.lit("  " + text.ljust(LABEL_WIDTH, ".") + " ")
    shown = decided.filter("outcome <> 'failed'")
    scanned = decided.filter("outcome = 'scanned'").select("target_id")
    tried = decided.agg(F.count_if(F.col("outcome") != "ignored").alias("n"))
    title = F.create_map(*[F.lit(x) for pair in (names or {"": ""}).items() for x in pair])
    agents = agent_scans(decided).agg(F.array_sort(F.collect_list(F.struct("agent_id", "scanned"))).alias("a"))
    agents = agents.filter(F.size("a") > 0).select(F.lit(2).alias("nr"), F.concat(label("Agents scanned"), F.array_join(F.transform("a", lambda a: F.concat(F.coalesce(F.try_element_at(title, a["agent_id"]), a["agent_id"]), F.lit(": "), a["scanned"].cast("string"))), ", ")).alias("text"))
    market = F.count_if(F.col("state") == "marketplace")
    states = shown.agg(market.alias("m"), (F.count("*") - market).alias("i")).filter("m > 0").select(F.lit(3), F.concat(label("Install state"), F.format_string("installed: %d, marketplace: %d", "i", "m")))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    worst = findings.join(scanned, "target_id", "left_semi").groupBy("target_id").agg(F.min(rank).alias("r"))
    counts = worst.agg(F.count("*").alias("n"), *[F.count_if(F.col("r") == i + 1).alias(s) for i, s in enumerate(SEVERITIES)])
    listed = F.concat_ws(", ", *[F.concat(F.col(s).cast("string"), F.lit(f" {s}")) for s in SEVERITIES[:4]], F.when(F.col("info") > 0, F.concat(F.col("info").cast("string"), F.lit(" info"))))
    issues = counts.select(F.lit(4), F.concat(label("Unique issues"), F.col("n").cast("string"), F.lit("  ("), listed, F.lit(")")))
    one = lambda df: df.withColumn("run", F.lit(0))  # noqa: E731  (one row each)
    failed = summaries.join(scanned, "target_id", "left_semi").agg(F.count_if(F.col("verdict") == "FAIL").alias("bad"))
    both = one(failed).join(one(tried), "run").join(one(shown.agg(market.alias("m"))), "run")
    share = _percent(F.col("bad"), F.col("n"))
    text = F.when(F.col("bad") == 0, "0").otherwise(F.concat(F.col("bad").cast("string"), F.lit("   ("), percent_text(share), F.lit("% of "), F.when(F.col("m") > 0, "scanned").otherwise("installed"), F.lit(")")))
    head = tried.select(F.lit(1).alias("nr"), F.concat(label("Targets scanned"), F.col("n").cast("string")).alias("text"))
    return head.union(agents).union(states).union(issues).union(both.select(F.lit(5), F.concat(label("Compromised targets"), text)))


def _percent(part: Column, of: Column) -> Column:
    """Rounded to a whole number, below one to two decimals."""
    share = F.when(of > 0, part * 100.0 / of).otherwise(F.lit(0.0))
    return F.when((share > 0) & (share < 1), F.floor(share * 100 + 0.5) / 100).otherwise(F.floor(share + 0.5).cast("double"))
