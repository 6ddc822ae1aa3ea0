"""Scores, verdicts with compound triggers, and one total risk order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import FAIL_ALONE, PENALTIES, PIPE_RULES, SAME_LINE, SEVERITIES, STORE_RULES
from .ordering import ranked


def _first_of(ids: Column, wanted: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(F.array_contains(ids, w), F.lit(w)) for w in wanted])


def same_line_triggers(findings: DataFrame) -> DataFrame:
    """(target_id, ids) of injections that share a line with a credential store, by an equi-join over a small table of pairs."""
    pairs = F.broadcast(findings.sparkSession.createDataFrame([(a, b, i) for i, (a, b) in enumerate(SAME_LINE)], "rule_id string, store_id string, nr int"))
    stores = findings.select("target_id", "path", "line", F.col("rule_id").alias("store_id")).distinct()
    hits = findings.filter("severity <> 'info'").join(pairs, "rule_id").join(stores, ["target_id", "path", "line", "store_id"])
    first = hits.groupBy("target_id", "path", "line", "rule_id").agg(F.min_by("store_id", "nr").alias("store_id"))
    return first.groupBy("target_id").agg(F.array_union(F.collect_set("rule_id"), F.collect_set("store_id")).alias("same_line"))


def score_targets(targets: DataFrame, findings: DataFrame, allowlist: DataFrame | None = None) -> DataFrame:
    """One row a target: distinct rules by severity, score, verdict, ``mandatory_fail`` (sorted) and ``allowlisted``.

    ``targets`` has target_id and tree_sha256; ``findings`` target_id, path, line, rule_id, severity and, if wanted,
    ignored_for_verdict and seq. An allowlisted tree has its PI rules counted as info.
    """
    if allowlist is None:
        targets = targets.withColumn("allowlisted", F.lit(False))
    else:
        known = allowlist.select("tree_sha256", F.lit(True).alias("allowlisted")).filter(F.regexp_like("tree_sha256", F.lit("^[0-9a-f]{64}$")) & (F.col("tree_sha256") != "0" * 64)).distinct()
        targets = targets.join(known, "tree_sha256", "left").withColumn("allowlisted", F.coalesce("allowlisted", F.lit(False)))
    rows = findings.join(targets.select("target_id", "allowlisted"), "target_id")
    rows = rows.withColumn("severity", F.when(F.col("allowlisted") & F.col("rule_id").startswith("PI-"), F.lit("info")).otherwise(F.col("severity")))
    if "ignored_for_verdict" not in rows.columns:
        rows = rows.withColumn("ignored_for_verdict", F.lit(False))
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.struct("path", "line", "rule_id"))
    counts = [F.count_distinct(F.when(F.col("severity") == s, F.col("rule_id"))).cast("int").alias(s) for s in SEVERITIES]
    totals = rows.groupBy("target_id").agg(*counts)
    active = rows.filter(~F.col("ignored_for_verdict"))
    facts = active.groupBy("target_id").agg(
        F.collect_set("rule_id").alias("ids"),
        F.min_by("rule_id", F.when(F.col("rule_id").startswith("NET-"), F.col("seq"))).alias("first_net"),
        F.min_by("rule_id", F.when(F.col("rule_id").startswith("PI-") & (F.col("severity") == "critical"), F.col("seq"))).alias("first_injection"),
    )
    facts = facts.join(same_line_triggers(active), "target_id", "left")
    has = lambda r: F.array_contains("ids", r)
    none = F.array().cast("array<string>")
    both = lambda on, *parts: F.when(on, F.array(*parts)).otherwise(none)
    pipe, store = _first_of(F.col("ids"), PIPE_RULES), _first_of(F.col("ids"), STORE_RULES)
    triggers = F.array_sort(F.array_distinct(F.concat(
        F.array_intersect("ids", F.array(*map(F.lit, FAIL_ALONE))),
        both(has("DEPS-REMOTE-IMPORT") & pipe.isNotNull(), F.lit("DEPS-REMOTE-IMPORT"), pipe),
        both(has("FS-CREDSTORE") & F.col("first_net").isNotNull() & F.col("first_net").startswith("NET-"), F.lit("FS-CREDSTORE"), F.col("first_net")),
        both(F.col("first_injection").isNotNull() & store.isNotNull(), F.col("first_injection"), store),
        F.coalesce("same_line", none),
    )))
    out = targets.join(totals, "target_id", "left").join(facts.select("target_id", triggers.alias("mandatory_fail")), "target_id", "left")
    out = out.fillna(0, list(SEVERITIES)).withColumn("mandatory_fail", F.coalesce("mandatory_fail", none))
    score = F.greatest(F.lit(0), 100 - sum(F.col(s) * p for s, p in PENALTIES.items())).cast("int")
    out = out.withColumn("score", score)
    verdict = F.when(F.size("mandatory_fail") > 0, "FAIL").when(F.col("score") >= 85, "PASS").when(F.col("score") >= 50, "REVIEW").otherwise("FAIL")
    return out.withColumn("verdict", verdict)


def risk_order(summaries: DataFrame) -> DataFrame:
    """Summaries with ``rank``: score, verdict, most severe finding, then agent, name and path where there are any."""
    verdict = F.when(F.col("verdict") == "FAIL", 0).when(F.col("verdict") == "REVIEW", 1).otherwise(2)
    worst = F.coalesce(*[F.when(F.col(s) > 0, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(99))
    ties = [c for c in ("agent_id", "name", "path", "target_id") if c in summaries.columns]
    rows = summaries.withColumns({"verdict_rank": verdict, "severity_rank": worst})
    return ranked(rows, ["score", "verdict_rank", "severity_rank", *ties]).drop("verdict_rank", "severity_rank")


def run_summary(summaries: DataFrame) -> DataFrame:
    """One row: targets, failed ones, their percentage (two decimals below one per cent), the worst verdict and the mean score."""
    total, failed = F.count("*"), F.count_if(F.col("verdict") == "FAIL")
    percent = F.when(total == 0, F.lit(0.0)).otherwise(failed * 100.0 / total)
    percent = F.when((percent > 0) & (percent < 1), F.floor(percent * 100 + 0.5) / 100).otherwise(F.floor(percent + 0.5).cast("double"))
    worst = F.when(failed > 0, "FAIL").when(F.count_if(F.col("verdict") == "REVIEW") > 0, "REVIEW").otherwise("PASS")
    return summaries.agg(total.alias("scanned"), failed.alias("compromised"), percent.alias("percent_compromised"), worst.alias("verdict"), F.coalesce(F.floor(F.avg("score") + 0.5), F.lit(100)).cast("int").alias("mean_score"))


def severity_buckets(findings: DataFrame) -> DataFrame:
    """(severity, targets): targets by their most severe finding."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    worst = findings.groupBy("target_id").agg(F.min(rank).alias("r"))
    return worst.groupBy(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("r").cast("int")).alias("severity")).agg(F.count("*").alias("targets"))
