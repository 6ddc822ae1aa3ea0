"""Queries over reports, configuration files and trees, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.context import CONTEXT_CHARS, CONTEXT_FILES, EDUCATION_WORDS, NOTE_ID, with_context_notes
from ..operators.inventory import list_order
from ..operators.matching import first_per_line, match_all
from ..operators.reports import explained, html_escaped, json_report, list_json, redacted_paths, sarif_report, table_rows
from ..operators.scoring import risk_order
from ..operators.servers import mcp_servers
from ..sources.files import path_targets
from ..staging import staged
from .advice import ADVICE, cwe_of, fix_of
from .catalog import RULES, SEVERITIES
from .inventory import _FILES, _TARGETS, files, targets
from .queries import _findings_sql, _quoted, ranked_targets, seeded_findings, seeded_summaries, summaries, viewed_findings
from .seeds import seeded_files

#: Settings of a project, by remainder of the id: what they hold on their second line.
SETTINGS = ('"enableAllProjectMcpServers": true', '"enabledMcpjsonServers" : ["a"]', '"apiKeyHelper": "sh x"', '"permissions": {}', '"env": {"ANTHROPIC_BASE_URL": "https://evil.example"}')
SCOPE_RULES = tuple(r for r in RULES if r.scopes and r.rule_id in ("MCP-PROJECT-AUTO-APPROVE", "SEC-PROJECT-CREDENTIAL-HELPER"))
EXPLAINED = "t3"


def settings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings file for each document, in the project's or the user's scope, with the document's text as a note."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    name = F.when(F.col("doc_id") % 4 == 3, "settings.local.json").otherwise("settings.json")
    held = F.get(F.array(*map(F.lit, SETTINGS)), (F.col("doc_id") % len(SETTINGS)).cast("int"))
    note = F.regexp_replace(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("note"))), r"^\{|\}$", "")
    content = F.concat(F.lit("{\n  "), held, F.lit(",\n"), note, F.lit("}"))
    scope = F.when(F.col("doc_id") % 3 == 0, "user").otherwise("project")
    installed = F.array(F.struct(F.lit("agent-config").alias("format"), scope.alias("scope"), name.alias("scan_name")))
    return docs.select(F.lit("t").alias("target_id"), F.concat_ws("/", F.col("doc_id").cast("string"), name).alias("path"), content.alias("content"), installed.alias("installations"))


def server_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of servers for each page: its address is one, and pages of even id have a command too."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    web = F.to_json(F.struct("url"))
    tool = F.concat(F.lit('{"command": "run", "args": ["'), F.col("page_id").cast("string"), F.lit('"]}'))
    both = F.concat(F.lit('{"mcpServers": {"web": '), web, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(', "tool": '), tool)).otherwise(F.lit("")), F.lit("}}"))
    content = F.when(F.col("page_id") % 7 == 6, "{broken").when(F.col("page_id") % 7 == 5, '{"other": {}}').otherwise(both)
    return pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/.mcp.json")).alias("path"), content.alias("content"))


def f3_project_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = first_per_line(match_all(settings_files(spark, sf_dir), SCOPE_RULES))
    return found.select("path", "rule_id", "line", "column", "snippet")


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = staged(viewed_findings(spark, sf_dir), "findings")
    return risk_order(staged(summaries(spark, sf_dir, found), "summaries")), found


def k1_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, found = _scored(spark, sf_dir)
    agents = scored.agg(F.count("*").alias("skills_scanned")).select(F.lit("cross-agent").alias("id"), F.lit(True).alias("installed"), "skills_scanned")
    return json_report(scored, found, agents, "1970-01-01T00:00:00.000Z", 0, "1.0.0")


def k2_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sarif_report(*_scored(spark, sf_dir), "1.0.0", "file:///project")


def s1_path_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trees as one: the files of a tree lie in a folder of its name."""
    return path_targets(files(spark, sf_dir).select(F.concat_ws("/", "tree", "path").alias("path")))


QUERIES = {
    "s1_path_targets": s1_path_targets,
    "s6_mcp_servers": lambda s, d: mcp_servers(server_files(s, d)),
    "f3_project_rules": f3_project_rules,
    "m10_context_notes": lambda s, d: with_context_notes(staged(seeded_findings(s, d), "findings"), seeded_files(s, d)).filter(F.col("rule_id") == NOTE_ID).select("target_id", "path", "line", "severity"),
    "f21_redacted_paths": lambda s, d: seeded_files(s, d).select("path", redacted_paths(F.col("path")).alias("shown")),
    "c_html_escape": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(html_escaped(F.coalesce("html", F.lit(""))).cast("binary")).alias("escaped_md5")),
    "k1_report_lines": k1_report_lines,
    "k2_log_lines": k2_log_lines,
    "k3_table_rows": lambda s, d: table_rows(ranked_targets(seeded_summaries(s, d))).select("target_id", "score", "verdict", "rank", "more"),
    "k6_list_json": lambda s, d: list_json(list_order(targets(s, d))),
    "k7_explained": lambda s, d: explained(seeded_findings(s, d), EXPLAINED),
}

_ADVICE = ", ".join(f"({_quoted(r)}, {_quoted(fix_of(r))}, {_quoted(', '.join(cwe_of(r)))})" for r in ADVICE)
_CASES = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SETTINGS))
ORACLES = {
    "s1_path_targets": _FILES
    + """, f AS (SELECT tree || '/' || path AS path FROM files
), roots AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM f WHERE path LIKE '%/SKILL.md'
), o AS (SELECT path, coalesce((SELECT arg_max(folder, length(folder)) FROM roots WHERE starts_with(f.path, folder || '/')), '') AS target FROM f)
SELECT target, path, (dense_rank() OVER (ORDER BY target))::INTEGER AS nr FROM o""",
    "s6_mcp_servers": """
WITH f AS (SELECT 'p' || page_id || '/.mcp.json' AS path, page_id, url FROM pages WHERE page_id % 7 < 5)
SELECT path, 'web' AS server, NULL::VARCHAR AS command, url FROM f UNION ALL SELECT path, 'tool', 'run', NULL FROM f WHERE page_id % 2 = 0""",
    "f3_project_rules": f"""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'settings.local.json' ELSE 'settings.json' END AS name, CASE doc_id % {len(SETTINGS)} {_CASES} END || ',' AS line FROM documents WHERE doc_id % 3 <> 0
), r AS (
  SELECT *, 'MCP-PROJECT-AUTO-APPROVE' AS rule_id FROM s WHERE name = 'settings.json' AND regexp_matches(line, '"enableAllProjectMcpServers"\\s*:\\s*true\\b|"enabledMcpjsonServers"\\s*:\\s*\\[\\s*"')
  UNION ALL SELECT *, 'SEC-PROJECT-CREDENTIAL-HELPER' FROM s WHERE regexp_matches(line, '"(?:apiKeyHelper|awsAuthRefresh|awsCredentialExport|gcpAuthRefresh)"\\s*:\\s*"\\s*[^"\\s]'))
SELECT doc_id || '/' || name AS path, rule_id, 2 AS line, 3 AS "column", line AS snippet FROM r""",
    "m10_context_notes": _findings_sql()
    + f""", a AS (SELECT target_id, arg_min(path, {{'p': path, 'l': line, 'r': rule_id}}) AS path FROM findings WHERE severity <> 'info' GROUP BY target_id
), t AS (SELECT DISTINCT target_id FROM files WHERE string_split(path, '/')[-1] IN {CONTEXT_FILES!r} AND regexp_matches(substr(content, 1, {CONTEXT_CHARS}), '{EDUCATION_WORDS}'))
SELECT target_id, path, 1 AS line, 'info' AS severity FROM a SEMI JOIN t USING (target_id)""",
    "f21_redacted_paths": _findings_sql() + "SELECT path, '[redacted]/' || string_split(path, '/')[-1] AS shown FROM files",
    "c_html_escape": "SELECT page_id, md5(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages",
    "k3_table_rows": _findings_sql()
    + """, o AS (SELECT target_id, score, verdict, (row_number() OVER (ORDER BY score, CASE verdict WHEN 'FAIL' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END,
  CASE WHEN critical > 0 THEN 0 WHEN high > 0 THEN 1 WHEN medium > 0 THEN 2 WHEN low > 0 THEN 3 WHEN info > 0 THEN 4 ELSE 99 END, target_id))::INTEGER AS rank, greatest(count(*) OVER () - 20, 0) AS more FROM summaries)
SELECT * FROM o WHERE rank <= 20""",
    "k6_list_json": _TARGETS
    + """SELECT (row_number() OVER (ORDER BY list_position(['project', 'managed', 'user'], scope), state, agent_id, name, path))::INTEGER AS rank,
  to_json({'agent': agent_id, 'name': name, 'path': path, 'tree_sha256': tree_sha256, 'scope': scope, 'install_state': state, 'format': format})::VARCHAR AS text FROM targets""",
    "k7_explained": _findings_sql()
    + f"""SELECT (row_number() OVER (ORDER BY list_position({list(SEVERITIES)!r}, severity), path, line, rule_id))::INTEGER AS nr, severity, rule_id, string_split(path, '/')[-1] || ':' || line AS place, message,
       snippet, a.fix, a.cwe
FROM findings JOIN (VALUES {_ADVICE}) a(rule_id, fix, cwe) USING (rule_id) WHERE target_id = '{EXPLAINED}'""",
}
