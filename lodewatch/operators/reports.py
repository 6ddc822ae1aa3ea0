"""Reports as documents that are never held in one place.

A document is a table of lines with a key; in the order of the key they are its text. Commas stand before a line, so a
line needs to know only whether it is the first of its list. ``write_document`` sorts by range and writes part files
that, one after the other, are the document.
"""

from __future__ import annotations

import json
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.advice import cwe_of, fix_of
from ..plans.catalog import RULES, SEVERITIES, Rule
from .inventory import basename
from .matching import fingerprints

KEY = ["block", "rank", "part", "path", "rule_id", "line"]
# fixed values: levels of results by severity, and the schema of the log
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
TOP = 20
AGENT_PATHS = "array<struct<id: string, path: string>>"


def write_document(lines: DataFrame, path: str) -> None:
    """Part files whose texts in order of their names are the document."""
    lines.orderBy(*KEY).select("text").write.text(path)


def _whole(spark: SparkSession, block: int, text: Column) -> DataFrame:
    return spark.range(1).select(F.lit(block).alias("block"), F.lit(0).alias("rank"), F.lit(0).alias("part"), *[F.lit("").alias(k) for k in KEY[3:5]], F.lit(0).alias("line"), text.alias("text"))


def _keyed(rows: DataFrame, block: int, part: int, text: Column) -> DataFrame:
    own = {"path": F.lit(""), "rule_id": F.lit(""), "line": F.lit(0)}
    return rows.select(F.lit(block).alias("block"), "rank", F.lit(part).alias("part"), *[(F.col(k) if part == 1 else v).alias(k) for k, v in own.items()], text.alias("text"))


def _first_marked(findings: DataFrame) -> DataFrame:
    """``findings`` with ``first``: whether each is the first of its target, by path, rule and line. No target is gathered."""
    place = F.struct("path", "rule_id", "line")
    firsts = findings.groupBy("rank").agg(F.min(place).alias("p")).select("rank", "p.*", F.lit(True).alias("first"))
    return findings.join(firsts, ["rank", "path", "rule_id", "line"], "left").withColumn("first", F.coalesce("first", F.lit(False)))


def _json(**fields: Column) -> Column:
    """Keys in order; nulls are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def with_advice(findings: DataFrame) -> DataFrame:
    """``findings`` with the category, fix and cwe (array) of their rules; kinds of findings that are no rule have the category "other"."""
    known = [(r.rule_id, r.category, fix_of(r.rule_id), cwe_of(r.rule_id)) for r in RULES]
    advice = findings.sparkSession.createDataFrame(known, "rule_id string, category string, fix string, cwe array<string>")
    own = findings.drop("category", "fix", "cwe").join(F.broadcast(advice), "rule_id", "left")  # a row a rule
    return own.withColumns({"category": F.coalesce("category", F.lit("other")), "fix": F.coalesce("fix", F.lit("")), "cwe": F.coalesce("cwe", F.array().cast("array<string>"))})


def json_report(targets: DataFrame, findings: DataFrame, agents: DataFrame, started_at: str, duration_ms: int, version: str) -> DataFrame:
    """The lines of a scan report: run, agents, targets in risk order with their findings, and the summary.

    ``targets`` has target_id, rank, verdict, score, mandatory_fail, allowlisted, a count for each severity and, if
    known, name, install_state, modified_at, tree_sha256, ignored, agent_paths (array<struct<id, path>>) and llm_reviews
    (array of structs as they shall be written); ``findings`` has target_id, path, rule_id,
    severity, message, line, column and snippet; ``agents`` id, installed and skills_scanned, one row an agent.
    """
    spark, c = targets.sparkSession, F.col
    has = lambda name, other: c(name) if name in targets.columns else other
    head = json.dumps({"schema_version": "1.0", "scan": {"started_at": started_at, "duration_ms": duration_ms, "tool_version": version}})[:-1]
    agents = agents.withColumn("rank", F.row_number().over(Window.orderBy("id")))  # a dozen rows
    ignored = F.coalesce(has("ignored", F.lit(False)), F.lit(False))
    opening = _json(id=c("target_id"), agents=F.coalesce(has("agent_paths", F.lit(None)).cast(AGENT_PATHS), F.array().cast(AGENT_PATHS)), name=has("name", c("target_id")), install_state=has("install_state", F.lit("installed")), modified_at=has("modified_at", F.lit(None).cast("string")), tree_sha256=F.coalesce(has("tree_sha256", F.lit("")), F.lit("")), allowlisted=c("allowlisted"), ignored=ignored)
    counts = _json(**{s: c(s) for s in SEVERITIES}, score=c("score"), verdict=c("verdict"), mandatory_fail=c("mandatory_fail"))
    comma = F.when(c("rank") > 1, F.lit(",")).otherwise(F.lit(""))
    found = _first_marked(with_advice(findings).join(targets.select("target_id", "rank"), "target_id"))
    finding = _json(rule_id=c("rule_id"), severity=c("severity"), category=c("category"), file=c("path"), line=c("line"), column=c("column"), snippet=c("snippet"), message=c("message"), fix=c("fix"), cwe=c("cwe"))
    reviews = F.concat(F.lit(', "llm_reviews": '), F.to_json("llm_reviews")) if "llm_reviews" in targets.columns else F.lit("")
    active = targets.filter(~ignored)
    total, failed = F.count("*"), F.count_if(c("verdict") == "FAIL")
    percent = F.when(total == 0, F.lit(0.0)).otherwise(failed * 100.0 / total)
    percent = F.when((percent > 0) & (percent < 1), F.floor(percent * 100 + 0.5) / 100).otherwise(F.floor(percent + 0.5).cast("double"))
    worst = F.when(failed > 0, "FAIL").when(F.count_if(c("verdict") == "REVIEW") > 0, "REVIEW").otherwise("PASS")
    end = active.agg(F.concat(F.lit('], "summary": '), _json(skills_scanned=total, compromised=failed, percent_compromised=percent, verdict=worst), F.lit("}")).alias("text"))
    parts = [
        _whole(spark, 0, F.lit(head + ', "agents": [')),
        _keyed(agents, 1, 0, F.concat(comma, _json(id=c("id"), installed=c("installed"), skills_scanned=c("skills_scanned")))),
        _whole(spark, 2, F.lit('], "skills": [')),
        _keyed(targets, 3, 0, F.concat(comma, F.regexp_replace(opening, r"\}$", ""), F.lit(', "findings": ['))),
        _keyed(found, 3, 1, F.concat(F.when(c("first"), "").otherwise(","), finding)),
        _keyed(targets, 3, 2, F.concat(F.lit("]"), F.coalesce(reviews, F.lit("")), F.lit(', "summary": '), counts, F.lit("}"))),
        end.select(F.lit(4).alias("block"), F.lit(0).alias("rank"), F.lit(0).alias("part"), F.lit("").alias("path"), F.lit("").alias("rule_id"), F.lit(0).alias("line"), "text"),
    ]
    return reduce(_joined, parts)


def sarif_report(targets: DataFrame, findings: DataFrame, version: str, root_uri: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The lines of a SARIF 2.1.0 log: the rules, with those that only findings name, and results in risk order.

    Paths that begin with a slash or a drive stand outside the root and get a fingerprint; others are relative to it.
    """
    spark, c = findings.sparkSession, F.col
    shipped = spark.createDataFrame([(i, r.rule_id, r.category, r.severity, r.message, fix_of(r.rule_id), cwe_of(r.rule_id)) for i, r in enumerate(rules)], "rank int, rule_id string, category string, severity string, message string, fix string, cwe array<string>")
    more = findings.join(F.broadcast(shipped.select("rule_id")), "rule_id", "left_anti").groupBy("rule_id").agg(F.min("severity").alias("severity"), F.min("message").alias("message"))
    more = more.withColumn("rank", F.row_number().over(Window.orderBy("rule_id")) + len(rules) - 1).withColumns({"category": F.lit("other"), "fix": F.lit(""), "cwe": F.array().cast("array<string>")})  # kinds of findings, not findings
    catalog = shipped.unionByName(more)
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    comma = lambda first: F.when(first, F.lit("")).otherwise(F.lit(","))
    descriptor = _json(id=c("rule_id"), shortDescription=F.struct(c("message").alias("text")), help=F.struct(F.concat("message", F.when(c("fix") != "", F.concat(F.lit("\n\nFix: "), "fix")).otherwise("")).alias("text")), defaultConfiguration=F.struct(level[c("severity")].alias("level")), properties=F.struct(F.concat(F.array(F.lit("security"), c("category")), c("cwe")).alias("tags")))
    encoded = F.replace(F.replace(F.url_encode("path"), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    inside = ~F.regexp_like("path", F.lit(r"^(/|[A-Za-z]:)"))
    rows = fingerprints(findings.join(targets.select("target_id", "rank"), "target_id"))
    rows = rows.join(F.broadcast(catalog.select("rule_id", c("rank").alias("rule_index"))), "rule_id")  # one row a rule
    first = rows.agg(F.min(F.struct("rank", "path", "rule_id", "line")).alias("first"))
    rows = rows.join(F.broadcast(first))  # one row
    place = F.struct(F.struct(F.when(inside, encoded).otherwise(F.concat(F.lit("file://"), encoded)).alias("uri"), F.when(inside, F.lit("%SRCROOT%")).alias("uriBaseId")).alias("artifactLocation"), F.struct(c("line").alias("startLine"), c("column").alias("startColumn")).alias("region"))
    result = _json(ruleId=c("rule_id"), ruleIndex=c("rule_index"), level=level[c("severity")], message=F.struct(c("message").alias("text")), locations=F.array(F.struct(place.alias("physicalLocation"))), partialFingerprints=F.when(~inside, F.struct(c("line_hash").alias("primaryLocationLineHash"))))
    head = json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0"})[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps({"name": "lodewatch", "semanticVersion": version})[:-1] + ', "rules": ['
    middle = ']}}, "originalUriBaseIds": ' + json.dumps({"%SRCROOT%": {"uri": quote(root_uri.rstrip("/") + "/", safe=":/%")}}) + ', "columnKind": "utf16CodeUnits", "results": ['
    parts = [
        _whole(spark, 0, F.lit(head)),
        _keyed(catalog, 1, 0, F.concat(comma(c("rank") == 0), descriptor)),
        _whole(spark, 2, F.lit(middle)),
        _keyed(rows, 3, 1, F.concat(comma(F.struct("rank", "path", "rule_id", "line") == c("first")), result)),
        _whole(spark, 4, F.lit("]}]}")),
    ]
    return reduce(_joined, parts)


def redacted_paths(path: Column) -> Column:
    """A path with its folders hidden."""
    return F.regexp_replace(path, r".*/", "[redacted]/")


def html_escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def table_rows(ranked: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of the targets by rank, each with how many are not shown."""
    shown = ranked.filter(F.col("rank") <= top)
    more = ranked.agg(F.greatest(F.count("*") - top, F.lit(0)).alias("more"))
    return shown.join(F.broadcast(more))  # one row


def list_json(ordered: DataFrame) -> DataFrame:
    """(rank, text): the inventory list, one JSON object a target (agent_id, name, path, tree_sha256, scope, state, format)."""
    c = F.col
    return ordered.select("rank", _json(agent=c("agent_id"), name=c("name"), path=c("path"), tree_sha256=c("tree_sha256"), scope=c("scope"), install_state=c("state"), format=c("format")).alias("text"))


def explained(findings: DataFrame, target_id: str) -> DataFrame:
    """One target's findings with ``nr``: most severe first, then by path, line and rule; with their snippet, fix and cwe."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    w = Window.orderBy(rank, "path", "line", "rule_id")  # the findings of one target
    rows = with_advice(findings.filter(F.col("target_id") == target_id)).withColumn("nr", F.row_number().over(w))
    return rows.select("nr", "severity", "rule_id", F.concat_ws(":", basename(F.col("path")), "line").alias("place"), "message", "snippet", "fix", F.array_join("cwe", ", ").alias("cwe"))
