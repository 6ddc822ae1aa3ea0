"""Queries over the operators, and the SQL that they agree with. ``seeded_`` queries add rule lines to the documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import SPACE_CHARS, portable, re2_pattern
from ..functions.text import DOCS_NAME, DOCS_SEGMENTS, SECRETS, is_documentation, redacted
from ..operators.dedupe import merge_equal, path_rank, split_ignored
from ..operators.matching import fingerprints, first_per_line, match_all
from ..operators.scoring import risk_order, run_summary, score_targets, severity_buckets
from ..operators.remote_loads import remote_loads
from ..staging import staged
from .catalog import FAIL_ALONE, PIPE_RULES, RULES, SAME_LINE, SEVERITIES, STORE_RULES
from .seeds import EVERY, NAMES, SEEDS, TARGET_FILES, seeded_files

#: Rules with the patterns that SQL can match too, on whole texts.
PORTABLE = tuple(replace(r, patterns=own) for r in RULES if (own := tuple(p for p in r.patterns if portable(p))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def seeded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_per_line(match_all(seeded_files(spark, sf_dir), PORTABLE, masked=False))


def summaries(spark: SparkSession, sf_dir: str, findings: DataFrame) -> DataFrame:
    targets = seeded_files(spark, sf_dir).select("target_id", F.lit("").alias("tree_sha256")).distinct()
    return score_targets(targets, findings)


def seeded_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written, as scores read findings several times
    return summaries(spark, sf_dir, staged(seeded_findings(spark, sf_dir), "findings"))


def viewed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over their views; without SQL, as views are lexers and Java's patterns look around."""
    files = seeded_files(spark, sf_dir)
    return first_per_line(match_all(files).unionByName(remote_loads(files)))


def loading_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as comments of scripts, each with a chain of names up to seven long, at an address or at a local file, that a loader reads."""
    docs = documents(spark, sf_dir).select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("")).alias("text"))
    start = F.when(F.col("doc_id") % 3 == 0, "const v0 = 'https://x.example/a.js';").otherwise("const v0 = './a.js', home = 'https://x.example';")
    names = F.transform(F.slice(F.sequence(F.lit(0), F.lit(7)), 2, (F.col("doc_id") % 8).cast("int")), lambda i: F.concat(F.lit("const v"), i, F.lit(" = v"), i - 1, F.lit(";")))
    code = F.concat_ws("\n", start, F.array_join(F.concat(names, F.array(F.concat(F.lit("  import(v"), F.col("doc_id") % 8, F.lit(");")))), "\n"))
    return docs.select(F.lit("t").alias("target_id"), F.concat("doc_id", F.lit("/app.js")).alias("path"), F.concat(F.lit("/*"), "text", F.lit("*/\n"), code).alias("content"))


def v22_remote_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remote_loads(loading_files(spark, sf_dir)).select("path", "rule_id", "severity", "line", "column", "snippet")


def viewed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(spark, sf_dir, staged(viewed_findings(spark, sf_dir), "findings"))


def ranked_targets(scored: DataFrame) -> DataFrame:
    # written, as ranks are counted in two steps
    return risk_order(staged(scored, "summaries")).select("target_id", *SEVERITIES, "score", "verdict", F.array_join("mandatory_fail", ",").alias("mandatory_fail"), "rank")


def targets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as targets: language as agent, equal texts as equal trees."""
    place = F.element_at(F.array(F.lit("skills"), F.lit("plugins/cache"), F.lit("plugins/marketplaces")), (F.col("doc_id") % 3 + 1).cast("int"))
    return documents(spark, sf_dir).select(F.col("lang").alias("agent_id"), F.concat_ws("/", F.col("source"), place, F.col("doc_id").cast("string")).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("tree_sha256"))


def a11_dedupe_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_equal(targets_of(spark, sf_dir)).select("tree_sha256", "path", F.array_join("agent_ids", ",").alias("agent_ids"), "n_paths")


def f8_ignore_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = targets_of(spark, sf_dir)
    ignored = documents(spark, sf_dir).filter("doc_id % 10 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("tree_sha256"))
    return split_ignored(targets, ignored).select("path", "tree_sha256", "ignored")


def f11_docs_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_files(spark, sf_dir).select("path", is_documentation(F.col("path")).alias("docs"))


def f22_redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(redacted(F.col("text")).cast("binary"), 256).alias("redacted_sha256"))


def sarif_rows(findings: DataFrame) -> DataFrame:
    rows = fingerprints(findings)
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    return rows.select("path", "rule_id", level.alias("level"), F.col("line").alias("start_line"), F.col("column").alias("start_column"), "line_hash")


QUERIES = {
    "v22_remote_loads": v22_remote_loads,
    "m6_seeded_findings": seeded_findings,
    "m6_viewed_findings": viewed_findings,
    "o1_seeded_risk_order": lambda spark, d: ranked_targets(seeded_summaries(spark, d)),
    "o1_viewed_risk_order": lambda spark, d: ranked_targets(viewed_summaries(spark, d)),
    "a16_seeded_run_summary": lambda spark, d: run_summary(seeded_summaries(spark, d)),
    "a16_viewed_run_summary": lambda spark, d: run_summary(viewed_summaries(spark, d)),
    "a17_seeded_severity_buckets": lambda spark, d: severity_buckets(seeded_findings(spark, d)),
    "a17_viewed_severity_buckets": lambda spark, d: severity_buckets(viewed_findings(spark, d)),
    "a11_dedupe_by_hash": a11_dedupe_by_hash,
    "a12_path_rank": lambda spark, d: targets_of(spark, d).select("path", path_rank(F.col("path")).alias("path_rank")),
    "f8_ignore_list": f8_ignore_list,
    "f11_docs_path": f11_docs_path,
    "f22_redact_secrets": f22_redact_secrets,
    "k2_sarif_rows": lambda spark, d: sarif_rows(seeded_findings(spark, d)),
    "k2_viewed_sarif_rows": lambda spark, d: sarif_rows(viewed_findings(spark, d)),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits_sql(rule, nr: int, pattern: str) -> str:
    name, pattern = "string_split(path, '/')[-1]", _quoted(re2_pattern(pattern))
    globs = [f"{name} = {_quoted(g)}" if "*" not in g else f"starts_with({name}, {_quoted(g.split('*', 1)[0])}) AND ends_with({name}, {_quoted(g.rsplit('*', 1)[1])})" for g in rule.names]
    return rf"""SELECT *, {_quoted(rule.rule_id)} AS rule_id, {_quoted(rule.severity)} AS severity, {_quoted(rule.message)} AS message, {nr} AS pattern_idx,
    string_split(regexp_replace(content, {pattern}, chr(57344) || '\0', 'g'), chr(57344)) AS pieces
  FROM files WHERE ({' OR '.join(globs)}) AND regexp_matches(content, {pattern})"""


def _first_of(ids: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN list_contains(ids, '{i}') THEN '{i}'" for i in ids) + " END"


def _findings_sql() -> str:
    seeds = " ".join(f"WHEN {k} THEN chr(10) || {_quoted(line)}" for k, line in enumerate(SEEDS))
    names = ", ".join(map(_quoted, NAMES))
    hits = "\n  UNION ALL ".join(_hits_sql(r, i, p) for r in PORTABLE for i, p in enumerate(r.patterns))
    spaces = " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS)
    pairs = ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(SAME_LINE))
    seq = "{'path': path, 'line': line, 'rule_id': rule_id}"
    return rf"""
WITH files AS MATERIALIZED (
  SELECT 't' || (doc_id // {TARGET_FILES}) AS target_id, doc_id::VARCHAR || '/' || ([{names}])[doc_id % {len(NAMES)} + 1] AS path, text || CASE doc_id % {EVERY} {seeds} ELSE '' END AS content FROM documents
), hits AS ({hits}
), places AS (SELECT *, unnest(range(1, len(pieces))) AS nr FROM hits
), starts AS (SELECT *, string_split(array_to_string(pieces[1:nr], ''), chr(10)) AS before FROM places
), matches AS (
  SELECT target_id, path, rule_id, severity, message, pattern_idx, len(before)::INTEGER AS line, (length(before[-1]) + 1)::INTEGER AS col,
         substr(trim(string_split(content, chr(10))[len(before)], {spaces}), 1, 120) AS snippet FROM starts
), findings AS MATERIALIZED (
  SELECT target_id, path, rule_id, severity, message, line, col AS "column", snippet FROM matches
  QUALIFY row_number() OVER (PARTITION BY target_id, path, rule_id, line ORDER BY pattern_idx, col) = 1
), counts AS (
  SELECT t.target_id, {', '.join(f"count(DISTINCT CASE WHEN severity = '{s}' THEN rule_id END)::INTEGER AS {s}" for s in SEVERITIES)}
  FROM (SELECT DISTINCT target_id FROM files) t LEFT JOIN findings f ON t.target_id = f.target_id GROUP BY t.target_id
), together AS (
  SELECT DISTINCT f.target_id, f.path, f.line, f.rule_id, arg_min(p.store, p.nr) AS store FROM findings f JOIN (VALUES {pairs}) p(rule_id, store, nr) ON f.rule_id = p.rule_id AND f.severity <> 'info'
  JOIN findings s ON s.target_id = f.target_id AND s.path = f.path AND s.line = f.line AND s.rule_id = p.store GROUP BY ALL
), same_line AS (
  SELECT target_id, list_distinct(list(rule_id) || list(store)) AS pair FROM together GROUP BY target_id
), facts AS (
  SELECT target_id, list(DISTINCT rule_id) AS ids, arg_min(rule_id, {seq}) FILTER (starts_with(rule_id, 'NET-')) AS net, arg_min(rule_id, {seq}) FILTER (starts_with(rule_id, 'PI-') AND severity = 'critical') AS injection
  FROM findings GROUP BY target_id
), parts AS (SELECT *, {_first_of(PIPE_RULES)} AS pipe, {_first_of(STORE_RULES)} AS store FROM facts
), forced AS (
  SELECT target_id, array_to_string(list_sort(list_distinct(list_filter(ids, lambda x: list_contains({list(FAIL_ALONE)!r}, x))
    || CASE WHEN list_contains(ids, 'DEPS-REMOTE-IMPORT') AND pipe IS NOT NULL THEN ['DEPS-REMOTE-IMPORT', pipe] ELSE [] END
    || CASE WHEN list_contains(ids, 'FS-CREDSTORE') AND net IS NOT NULL THEN ['FS-CREDSTORE', net] ELSE [] END
    || CASE WHEN injection IS NOT NULL AND store IS NOT NULL THEN [injection, store] ELSE [] END || coalesce(pair, []))), ',') AS mandatory_fail
  FROM parts LEFT JOIN same_line USING (target_id)
), scored AS (
  SELECT c.*, greatest(0, 100 - 25 * critical - 10 * high - 3 * medium - low)::INTEGER AS score, coalesce(mandatory_fail, '') AS mandatory_fail FROM counts c LEFT JOIN forced USING (target_id)
), summaries AS (SELECT *, CASE WHEN mandatory_fail <> '' THEN 'FAIL' WHEN score >= 85 THEN 'PASS' WHEN score >= 50 THEN 'REVIEW' ELSE 'FAIL' END AS verdict FROM scored)
"""


_TARGETS = """
WITH targets AS (
  SELECT lang AS agent_id, source || '/' || (['skills', 'plugins/cache', 'plugins/marketplaces'])[doc_id % 3 + 1] || '/' || doc_id::VARCHAR AS path,
         sha256(text) AS tree_sha256, doc_id FROM documents
), ranked AS (
  SELECT *, CASE WHEN path LIKE '%/plugins/marketplaces/%' THEN 2 WHEN path LIKE '%/plugins/cache/%' THEN 1 ELSE 0 END AS path_rank FROM targets)
"""


def _redaction_sql() -> str:
    out = "text"
    for p in SECRETS:
        out = f"regexp_replace({out}, {_quoted(re2_pattern(p))}, '[REDACTED]', 'g')"
    return f"SELECT doc_id, sha256({out}) AS redacted_sha256 FROM documents"


ORACLES = {
    "v22_remote_loads": """
WITH d AS (SELECT doc_id, doc_id % 8 AS n, replace(coalesce(text, ''), '*/', '') AS text FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id || '/app.js' AS path, 'DEPS-REMOTE-IMPORT' AS rule_id, 'critical' AS severity, (len(string_split(text, chr(10))) + 2 + n)::INTEGER AS line, 3 AS "column", 'import(v' || n || ');' AS snippet FROM d""",
    "m6_seeded_findings": _findings_sql() + "SELECT * FROM findings",
    "o1_seeded_risk_order": _findings_sql()
    + f"""SELECT target_id, {', '.join(SEVERITIES)}, score, verdict, mandatory_fail, (row_number() OVER (ORDER BY score, CASE verdict WHEN 'FAIL' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END,
  CASE WHEN critical > 0 THEN 0 WHEN high > 0 THEN 1 WHEN medium > 0 THEN 2 WHEN low > 0 THEN 3 WHEN info > 0 THEN 4 ELSE 99 END, target_id))::INTEGER AS rank FROM summaries""",
    "a16_seeded_run_summary": _findings_sql()
    + """, p AS (SELECT count(*) AS scanned, count(*) FILTER (verdict = 'FAIL') AS compromised, count(*) FILTER (verdict = 'FAIL') * 100.0::DOUBLE / count(*) AS pc, avg(score) AS mean,
  CASE WHEN count(*) FILTER (verdict = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (verdict = 'REVIEW') > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM summaries)
SELECT scanned, compromised, CASE WHEN pc > 0 AND pc < 1 THEN floor(pc * 100 + 0.5) / 100 ELSE floor(pc + 0.5) END AS percent_compromised, verdict, floor(mean + 0.5)::INTEGER AS mean_score FROM p""",
    "a17_seeded_severity_buckets": _findings_sql()
    + f""", w AS (SELECT target_id, min(list_position({list(SEVERITIES)!r}, severity)) AS r FROM findings GROUP BY target_id)
SELECT ({list(SEVERITIES)!r})[r] AS severity, count(*) AS targets FROM w GROUP BY r""",
    "a11_dedupe_by_hash": _TARGETS
    + """SELECT tree_sha256, arg_min(path, (path_rank, path)) AS path, array_to_string(list_sort(list_distinct(list(agent_id))), ',') AS agent_ids,
  count(DISTINCT path)::INTEGER AS n_paths FROM ranked GROUP BY tree_sha256""",
    "a12_path_rank": _TARGETS + "SELECT path, path_rank::INTEGER AS path_rank FROM ranked",
    "f8_ignore_list": _TARGETS + "SELECT path, tree_sha256, tree_sha256 IN (SELECT tree_sha256 FROM targets WHERE doc_id % 10 = 0) AS ignored FROM targets",
    "f11_docs_path": _findings_sql()
    + f"""SELECT path, list_has_any(list_transform(string_split(path, '/'), lambda x: lower(x)), {list(DOCS_SEGMENTS)!r})
  OR regexp_matches(string_split(path, '/')[-1], {_quoted(DOCS_NAME)}) AS docs FROM files""",
    "f22_redact_secrets": _redaction_sql(),
    "k2_sarif_rows": _findings_sql()
    + rf""", h AS (SELECT *, substr(sha256(rule_id || chr(0) || path || chr(0) || regexp_replace(snippet, {_quoted(re2_pattern(r'\s+'))}, ' ', 'g')), 1, 16) AS digest FROM findings)
SELECT path, rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, line AS start_line, "column" AS start_column,
  digest || ':' || (row_number() OVER (PARTITION BY digest ORDER BY line, "column"))::VARCHAR AS line_hash FROM h""",
}
