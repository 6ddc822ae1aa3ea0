"""Queries over the inventory of targets and over reviews, and their SQL. Documents stand for targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import agent_counts, agent_paths, distinct_installations, exit_code, fallback_name, install_state, list_order, look_up, owners, percent_text, source_label, top_issues
from ..operators.matching import matches_glob
from ..operators.reviews import compare_models, consensus, file_budget, top_consensus
from ..operators.scoring import risk_order
from ..staging import staged
from .catalog import RULES, SEVERITIES
from .queries import _findings_sql, _quoted, seeded_findings, seeded_summaries, viewed_findings, viewed_summaries
from .seeds import seeded_files

# Where documents stand, by remainder of the id.
FOLDERS = ("skills", ".claude/plugins/cache/market/pack", ".codex/plugins/tools/skills", "x/plugins/marketplaces/m", ".cursor/plugins/kit", "v1.2.3", "deep/skills")
FORMATS = ("SKILL.md", "plugin.json", "mcp-json", "agents-md", "gemini-extension-json")
SCOPES = ("user", "project", "managed")


def _pick(values: tuple[str, ...]):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    path = F.concat_ws("/", "source", _pick(FOLDERS), F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("agent_id"), path.alias("path"), F.concat(F.lit("Tool "), (F.col("doc_id") % 50).cast("string")).alias("name"), _pick(FORMATS).alias("format"), _pick(SCOPES).alias("scope"), F.sha2(F.col("text").cast("binary"), 256).alias("tree_sha256"))
    return rows.withColumn("state", install_state(F.col("path")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of trees; every ninth is a manifest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    name = F.when(F.col("doc_id") % 9 == 0, "SKILL.md").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")))
    folder = F.concat_ws("/", F.concat(F.lit("a"), (F.col("doc_id") % 40).cast("string")), F.when(F.col("doc_id") % 2 == 0, F.lit("b")), F.when(F.col("doc_id") % 3 == 0, F.lit("c")))
    return docs.select(F.col("source").alias("tree"), F.concat_ws("/", folder, name).alias("path")).distinct()


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' reviews of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    rows = docs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    file = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("f"), (F.col("doc_id") % 4).cast("string")))
    severity = F.element_at(F.array(*map(F.lit, ("high", "low", "info"))), (F.col("doc_id") % 3 + 1).cast("int"))
    found = F.array(F.struct(file.alias("file"), F.col("lang").alias("category"), severity.alias("severity")))
    status = F.when(F.col("doc_id") % 7 == 0, "timeout").when(F.col("doc_id") % 11 == 0, "invalid-response").otherwise("ok")
    return rows.select(F.col("source").alias("name"), F.concat(F.lit("m"), ((F.col("doc_id") + F.col("k")) % 3).cast("string")).alias("model_name"), status.alias("status"), found.alias("findings"))


def glob_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that apply to each target's manifest name."""
    name = _pick(("run.py", "requirements-dev.txt", "SKILL.md", "a.b.mjs", ".cursorrules"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", name.alias("file_name"))
    hits = F.array_compact(F.array(*[F.when(_any_glob(r.names), F.lit(r.rule_id)) for r in RULES]))
    return docs.select("doc_id", "file_name", F.size(hits).alias("n_rules"), F.array_join(F.array_sort(hits), ",").alias("rules"))


def _any_glob(names: tuple[str, ...]):
    out = F.lit(False)
    for glob in names:
        out = out | matches_glob(F.col("file_name"), glob)
    return out


def a14_installations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_installations(targets(spark, sf_dir).withColumn("scan_name", F.col("format")))


def a15_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = targets(spark, sf_dir).groupBy("tree_sha256").agg(F.collect_set("agent_id").alias("agent_ids"))
    return agent_counts(merged)


def a24_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("doc_id") % 1000
    shown = F.when(p < 100, F.round(p / 100.0, 2)).otherwise(p.cast("double"))
    return targets(spark, sf_dir).select("doc_id", percent_text(shown).alias("percent"))


def f18_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return targets(spark, sf_dir).select("path", source_label(c("path"), c("format"), c("name"), c("state")).alias("label"))


def f19_issues(spark: SparkSession, sf_dir: str, findings=seeded_findings) -> DataFrame:
    found = findings(spark, sf_dir)
    known = seeded_files(spark, sf_dir).select("target_id").distinct()
    return top_issues(known.withColumn("allowlisted", F.lit(False)), found).select("target_id", "top_issue")


def f20_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return targets(spark, sf_dir).select("path", fallback_name(folder).alias("name"))


def k9_exit(spark: SparkSession, sf_dir: str, summaries=seeded_summaries) -> DataFrame:
    rows = summaries(spark, sf_dir)
    return rows.select("target_id", exit_code(F.col("verdict")).alias("plain"), exit_code(F.col("verdict"), strict=True).alias("strict"), exit_code(F.col("verdict"), incomplete=True).alias("incomplete"))


def o5_highlight(spark: SparkSession, sf_dir: str, summaries=seeded_summaries) -> DataFrame:
    # written, as ranks are counted in two steps
    return risk_order(staged(summaries(spark, sf_dir), "summaries")).filter("verdict <> 'PASS'").orderBy(F.expr("verdict = 'FAIL'").desc(), "rank").limit(1).select("target_id", "verdict")


def o7_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(F.col("tree").alias("target_id"), "path", F.col("path").endswith("SKILL.md").alias("is_entry"))
    return file_budget(rows).select("target_id", "path", "nr")


QUERIES = {
    "a13_agent_paths": lambda s, d: agent_paths(targets(s, d)),
    "a14_installations": a14_installations,
    "a15_agent_counts": a15_agents,
    "a18_install_states": lambda s, d: targets(s, d).groupBy("state").agg(F.count("*").alias("targets")),
    "a20_model_comparison": lambda s, d: compare_models(reviews(s, d)),
    "a21_model_consensus": lambda s, d: consensus(reviews(s, d)).withColumn("models", F.array_join("models", ",")),
    "a23_agent_count": lambda s, d: targets(s, d).agg(F.count_distinct("agent_id").alias("agents")),
    "a24_percent_text": a24_percent,
    "f1_glob_rules": glob_rules,
    "f5_look_up": lambda s, d: look_up(targets(s, d), " tool 7 ").select("id", "name", "path"),
    "f6_installed_only": lambda s, d: targets(s, d).filter("state <> 'marketplace'").select("path"),
    "f9_owners": lambda s, d: owners(files(s, d)),
    "f18_source_label": f18_labels,
    "f19_seeded_top_issue": f19_issues,
    "f19_viewed_top_issue": lambda s, d: f19_issues(s, d, viewed_findings),
    "f20_fallback_name": f20_names,
    "k9_seeded_exit_code": k9_exit,
    "k9_viewed_exit_code": lambda s, d: k9_exit(s, d, viewed_summaries),
    "o2_list_order": lambda s, d: list_order(targets(s, d)).select("path", "rank"),
    "o5_seeded_highlight": o5_highlight,
    "o5_viewed_highlight": lambda s, d: o5_highlight(s, d, viewed_summaries),
    "o6_top_consensus": lambda s, d: top_consensus(consensus(reviews(s, d))),
    "o7_file_budget": o7_budget,
}


def _list(values: tuple[str, ...]) -> str:
    return f"([{', '.join(map(_quoted, values))}])[doc_id % {len(values)} + 1]"


_TARGETS = f"""
WITH placed AS (
  SELECT doc_id, doc_id::VARCHAR AS id, lang AS agent_id, source || '/' || {_list(FOLDERS)} || '/t' || doc_id::VARCHAR AS path, 'Tool ' || (doc_id % 50)::VARCHAR AS name,
         {_list(FORMATS)} AS format, {_list(SCOPES)} AS scope, sha256(text) AS tree_sha256 FROM documents
), targets AS (
  SELECT *, CASE WHEN path LIKE '%/plugins/marketplaces/%' THEN 'marketplace' ELSE 'installed' END AS state,
         CASE WHEN path LIKE '%/plugins/marketplaces/%' THEN 2 WHEN path LIKE '%/plugins/cache/%' THEN 1 ELSE 0 END AS path_rank FROM placed)
"""
_FILES = """
WITH files AS (
  SELECT DISTINCT source AS tree, 'a' || (doc_id % 40)::VARCHAR || CASE WHEN doc_id % 2 = 0 THEN '/b' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '/c' ELSE '' END || '/' ||
         CASE WHEN doc_id % 9 = 0 THEN 'SKILL.md' ELSE 'f' || doc_id::VARCHAR || '.md' END AS path FROM documents)
"""
_REVIEWS = """
WITH reviews AS (
  SELECT source AS name, 'm' || ((doc_id + k) % 3)::VARCHAR AS model_name, CASE WHEN doc_id % 7 = 0 THEN 'timeout' WHEN doc_id % 11 = 0 THEN 'invalid-response' ELSE 'ok' END AS status,
         CASE WHEN doc_id % 4 > 0 THEN 'f' || (doc_id % 4)::VARCHAR ELSE 'unknown file' END AS file, lang AS category, (['high', 'low', 'info'])[doc_id % 3 + 1] AS severity
  FROM documents, (VALUES (0), (1)) t(k))
"""


def _globs_sql() -> str:
    globs = ", ".join(f"({_quoted(r.rule_id)}, {_quoted(g.split('*', 1)[0])}, {_quoted(g.rsplit('*', 1)[-1])}, {'*' not in g})" for r in RULES for g in r.names)
    return f"""
WITH globs(rule_id, head, tail, whole) AS (VALUES {globs}
), named AS (SELECT doc_id, (['run.py', 'requirements-dev.txt', 'SKILL.md', 'a.b.mjs', '.cursorrules'])[doc_id % 5 + 1] AS file_name FROM documents
), hits AS (SELECT DISTINCT file_name, rule_id FROM (SELECT DISTINCT file_name FROM named), globs WHERE CASE WHEN whole THEN file_name = head ELSE starts_with(file_name, head) AND ends_with(file_name, tail) END
), by_name AS (SELECT file_name, count(*)::INTEGER AS n_rules, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM hits GROUP BY file_name)
SELECT doc_id, file_name, n_rules, rules FROM named JOIN by_name USING (file_name)"""


_STATUS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s.replace('-', '_')}" for s in ("ok", "unavailable", "timeout", "invalid-response", "skipped-offline", "not-run"))
_SEVERITY = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))

ORACLES = {
    "a13_agent_paths": _TARGETS + "SELECT tree_sha256, agent_id, arg_min(path, (path_rank, path)) AS path FROM targets GROUP BY ALL",
    "a14_installations": _TARGETS + "SELECT DISTINCT tree_sha256, scope, format, format AS scan_name FROM targets",
    "a15_agent_counts": _TARGETS + "SELECT agent_id, count(DISTINCT tree_sha256) AS targets FROM targets GROUP BY agent_id",
    "a18_install_states": _TARGETS + "SELECT state, count(*) AS targets FROM targets GROUP BY state",
    "a20_model_comparison": _REVIEWS
    + f"""SELECT model_name, {_STATUS}, count(*) AS findings, {_SEVERITY},
  CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' WHEN low > 0 THEN 'low' ELSE 'info' END AS highest_severity,
  mode(status) AS dominant_status FROM reviews GROUP BY model_name""",
    "a21_model_consensus": _REVIEWS + "SELECT name, file, category, severity, string_agg(DISTINCT model_name, ',' ORDER BY model_name) AS models FROM reviews WHERE status = 'ok' GROUP BY ALL HAVING count(DISTINCT model_name) > 1",
    "o6_top_consensus": _REVIEWS
    + f""", g AS (SELECT name, file, category, severity, count(DISTINCT model_name) AS n FROM reviews WHERE status = 'ok' GROUP BY ALL HAVING count(DISTINCT model_name) > 1
), o AS (SELECT *, (row_number() OVER (ORDER BY list_position({list(SEVERITIES)!r}, severity), name, file, category))::INTEGER AS nr, greatest(count(*) OVER () - 2, 0) AS more FROM g)
SELECT nr, CASE WHEN file = 'unknown file' THEN name ELSE name || '/' || file END || ' ' || severity || ' (' || n || ' models)' AS text, more FROM o WHERE nr <= 2""",
    "a23_agent_count": _TARGETS + "SELECT count(DISTINCT agent_id) AS agents FROM targets",
    "a24_percent_text": "SELECT doc_id, CASE WHEN p > 0 AND p < 100 THEN printf('0.%02d', p) WHEN p < 100 THEN '0' ELSE p::VARCHAR END AS percent FROM (SELECT doc_id, doc_id % 1000 AS p FROM documents)",
    "f1_glob_rules": _globs_sql(),
    "f5_look_up": _TARGETS + "SELECT id, name, path FROM targets WHERE lower(name) = 'tool 7' ORDER BY path LIMIT 1",
    "f6_installed_only": _TARGETS + "SELECT path FROM targets WHERE state <> 'marketplace'",
    "f9_owners": _FILES
    + r""", roots AS (SELECT DISTINCT tree, regexp_replace(path, '/?SKILL\.md$', '') AS folder FROM files WHERE path = 'SKILL.md' OR path LIKE '%/SKILL.md')
SELECT f.tree, f.path, coalesce(arg_max(folder, length(folder)), '') AS target FROM files f LEFT JOIN roots r ON f.tree = r.tree AND (folder = '' OR starts_with(f.path, folder || '/')) GROUP BY ALL""",
    "f18_source_label": _TARGETS
    + r"""SELECT path, CASE WHEN state = 'marketplace' THEN 'Marketplace' WHEN format = 'mcp-json' THEN 'MCP' WHEN format = 'gemini-extension-json' THEN 'Extension'
  WHEN format = 'plugin.json' THEN 'Plugin - ' || name WHEN path LIKE '%/.claude/plugins/cache/%' THEN 'Plugin - ' || regexp_extract(path, '/cache/[^/]+/([^/]+)', 1)
  WHEN path LIKE '%/.codex/plugins/%' THEN 'Plugin - ' || regexp_extract(path, '/([^/]+)/skills/', 1) WHEN path LIKE '%/.cursor/plugins/%' THEN 'Plugin' ELSE 'Direct' END AS label FROM targets""",
    "f19_seeded_top_issue": _findings_sql()
    + r""", worst AS (
  SELECT *, regexp_replace(regexp_replace(string_split_regex(trim(regexp_replace(message, '\s+', ' ', 'g')), '\s+[-—]\s+')[1], '[.!?]+$', ''), '(?i)\s+detected$', '') AS short FROM findings
  QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY list_position(['critical', 'high', 'medium', 'low', 'info'], severity), path, line, rule_id) = 1)
SELECT t.target_id, coalesce(CASE WHEN length(short) <= 56 THEN short ELSE rtrim(short[1:53]) || '...' END || ' (' || string_split(path, '/')[-1] || ':' || line::VARCHAR || ')', '—') AS top_issue
FROM (SELECT DISTINCT target_id FROM files) t LEFT JOIN worst w ON t.target_id = w.target_id""",
    "f20_fallback_name": _TARGETS + "SELECT path, CASE WHEN path LIKE '%/v1.2.3/t%' THEN string_split(path, '/')[-3] ELSE string_split(path, '/')[-2] END AS name FROM targets",
    "k9_seeded_exit_code": _findings_sql()
    + "SELECT target_id, (verdict = 'FAIL')::INTEGER AS plain, (verdict <> 'PASS')::INTEGER AS strict, CASE WHEN verdict = 'FAIL' THEN 1 ELSE 3 END::INTEGER AS incomplete FROM summaries",
    "o2_list_order": _TARGETS + "SELECT path, (row_number() OVER (ORDER BY list_position(['project', 'managed', 'user'], scope), state, agent_id, name, path))::INTEGER AS rank FROM targets",
    "o5_seeded_highlight": _findings_sql()
    + """SELECT target_id, verdict FROM summaries WHERE verdict <> 'PASS' ORDER BY verdict <> 'FAIL', score,
  CASE WHEN critical > 0 THEN 0 WHEN high > 0 THEN 1 WHEN medium > 0 THEN 2 WHEN low > 0 THEN 3 WHEN info > 0 THEN 4 ELSE 99 END, target_id LIMIT 1""",
    "o7_file_budget": _FILES
    + "SELECT tree AS target_id, path, (row_number() OVER (PARTITION BY tree ORDER BY path LIKE '%SKILL.md' DESC, path))::INTEGER AS nr FROM files QUALIFY nr <= 50",
}
