"""Queries over what agents of machines load, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.discovery import discovered, installed_agents
from .queries import _quoted, documents
from .trees import _CASE

HOME, CWD = "/home/u", "/home/u/w/p"
#: Sixteen documents in a row are a machine; a document is a file of it, by remainder of the id. ``{n}`` stands for its source and id.
FILES = (
    f"{HOME}/.claude/skills/{{n}}/SKILL.md", f"{CWD}/.claude/rules/deep/{{n}}.md", f"{CWD}/AGENTS.md", f"{HOME}/.agents/skills/{{n}}/SKILL.md", f"{HOME}/.cursor/agents/{{n}}/a.md", f"{HOME}/w/CLAUDE.md", f"{HOME}/.codex/prompts/{{n}}.md", f"{CWD}/.git/HEAD",
    f"{HOME}/.claude/plugins/cache/{{n}}/SKILL.md", f"{HOME}/.claude/plugins/marketplaces/{{n}}/SKILL.md", f"{HOME}/.copilot/hooks/{{n}}.json", f"{HOME}/{{n}}.txt", f"{CWD}/.opencode/agents/{{n}}.md", f"{CWD}/.vscode/mcp.json", f"{HOME}/.claude/plugins/{{n}}/SKILL.md", f"{CWD}/.mcp.json",
)
#: What each of these files is: its number, agent, scope, format and the name that selects rules (that of the file without one).
MEANT = (
    (0, "claude-code", "user", "SKILL.md", ""), (0, "copilot", "user", "SKILL.md", ""), (1, "claude-code", "project", "agents-md", ""), (2, "cross-agent", "project", "agents-md", ""), (3, "codex", "user", "SKILL.md", ""), (3, "cursor", "user", "SKILL.md", ""), (3, "copilot", "user", "SKILL.md", ""),
    (4, "cursor", "user", "agents-md", ""), (6, "codex", "user", "prompt-md", ""), (10, "copilot", "user", "agent-config", "hooks.json"), (13, "copilot", "project", "mcp-json", ".mcp.json"), (14, "claude-code", "user", "SKILL.md", ""), (15, "claude-code", "project", "mcp-json", ""),
)
#: The file that shows that an agent is there; on every third machine the files of one of them are elsewhere.
SIGNS = (("claude-code", (0, 8, 9, 14)), ("cursor", (4,)), ("codex", (6,)), ("copilot", (10,)))


def listing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir).select("doc_id", F.replace(F.coalesce("source", F.lit("")), F.lit("/"), F.lit("_")).alias("source"))
    nr, machine = F.col("doc_id") % len(FILES), F.floor(F.col("doc_id") / len(FILES))
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"))
    path = F.replace(F.get(F.array(*map(F.lit, FILES)), nr.cast("int")), F.lit("{n}"), name)
    path = F.when((machine % 3 == 1) & (nr == 10), F.concat(F.lit("/opt/"), name)).otherwise(path)
    files = docs.select(F.concat(F.lit("m"), machine).alias("machine"), path.alias("path"))
    return files, files.select("machine").distinct().withColumns({"home": F.lit(HOME), "cwd": F.lit(CWD)})


def s2_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovered(*listing(spark, sf_dir)).drop("path")


def s2_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return installed_agents(*listing(spark, sf_dir))


QUERIES = {"s2_discovered": s2_discovered, "s2_installed": s2_installed}

_ROWS = f"""
WITH d AS (SELECT doc_id, doc_id % {len(FILES)} AS nr, 'm' || doc_id // {len(FILES)} AS machine, doc_id // {len(FILES)} % 3 = 1 AS third, replace(coalesce(source, ''), '/', '_') || '-' || doc_id AS name FROM documents
), f AS (SELECT machine, nr, CASE WHEN third AND nr = 10 THEN '/opt/' || name ELSE replace({_CASE("nr", FILES)}, '{{n}}', name) END AS path, third AND nr = 10 AS elsewhere FROM d
), i AS (SELECT DISTINCT machine, agent_id FROM f JOIN (VALUES {", ".join(f"({_quoted(a)}, {n})" for a, nrs in SIGNS for n in nrs)}) s(agent_id, nr) USING (nr) WHERE NOT elsewhere UNION ALL SELECT DISTINCT machine, 'cross-agent' FROM f)
"""
ORACLES = {
    "s2_installed": _ROWS + "SELECT machine, agent_id FROM i",
    "s2_discovered": _ROWS
    + f"""SELECT DISTINCT machine, agent_id, scope, format, path AS manifest_path, CASE WHEN scan_name = '' THEN string_split(path, '/')[-1] ELSE scan_name END AS scan_name
FROM f JOIN (VALUES {", ".join(f"({n}, {_quoted(a)}, {_quoted(s)}, {_quoted(k)}, {_quoted(w)})" for n, a, s, k, w in MEANT)}) x(nr, agent_id, scope, format, scan_name) USING (nr) JOIN i USING (machine, agent_id) WHERE NOT elsewhere""",
}
