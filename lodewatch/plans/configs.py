"""Queries over configuration files made of documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.configs import command_values, config_values, hook_scripts, split_servers
from .queries import documents
from .trees import _CASE, PATHS

#: How a document is written as settings, by remainder of its id: file, quote, what stands before and behind its lines, and
#: the keys above them.
FORMS = (
    ("settings.json", '"', '{"hooks": {"args": [', ']}, "n": 1}', "hooks.args"),
    (".vscode/mcp.json", '"', '// "c"\n{"a": [{"args": [', ",]}, /* ] */], }", "a.0.args"),
    ("opencode.json", "'", "{x: .5, args: [", ",], /* ' */ }", "args"),
    ("config.toml", '"', '# "c"\n[a."b.c"]\nargs = [', "] # ]\n", "a.b.c.args"),
    ("hooks.json", '"', '{"args": [', ",]}", ""),  # a comma that strict JSON doesn't take
)
SEPARATOR = ",\n"


def _of(values: tuple | list, n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def settings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_id, path, content): each document's lines as arguments in one of the forms."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quote, nr = _of([f[1] for f in FORMS], F.col("doc_id")), F.col("doc_id")
    clean = F.replace(F.regexp_replace("text", r"[\x00-\x09\x0b-\x1f\x7f]", " "), F.lit("\\"), F.lit("\\\\"))
    lines = F.split(F.replace(clean, quote, F.concat(F.lit("\\"), quote)), "\n")
    body = F.array_join(F.transform(lines, lambda x: F.concat(quote, x, quote)), SEPARATOR)
    content = F.concat(_of([f[2] for f in FORMS], nr), body, _of([f[3] for f in FORMS], nr))
    return docs.select(nr.cast("string").alias("target_id"), _of([f[0] for f in FORMS], nr).alias("path"), content.alias("content"))


def s12_config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What agents would run of these files, with places."""
    found = command_values(config_values(settings_files(spark, sf_dir)))
    return found.select("target_id", "path", F.array_join("keys", ".").alias("keys"), F.md5(F.col("value").cast("binary")).alias("value_md5"), "start", "end")


def s12_invalid_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_values(settings_files(spark, sf_dir)).filter("kind = 'invalid'").select("target_id", "path", "dialect")


#: Commands of hooks, by number of the tree, with the file that each runs and the names that it gives the file.
HOOKS = (
    ("bash -o pipefail docs/guide.md", "docs/guide.md", "guide.md.sh"), ("python3 -W ignore docs/run.py -v", "docs/run.py", "run.py"), ("cat x; '$CLAUDE_PROJECT_DIR'/notes.md", "notes.md", "notes.md.sh"),
    ("node ./docs/deep/../guide.md && true", "docs/guide.md", "guide.md.js"), ("nohup docs/run.py", "docs/run.py", "run.py"), ("../docs/run.py", "", ""), ("echo $(. notes.md)", "notes.md", "notes.md.sh"),
)


def s8_hook_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents in a row are a tree, whose settings have a hook and, as a comment of theirs, the text of its first file."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tree = F.floor(F.col("doc_id") / len(PATHS))
    files = docs.select(F.concat(F.lit("t"), tree).alias("target_id"), _of(PATHS, F.col("doc_id")).alias("path"), F.concat(F.lit("\n"), "text").alias("content"))
    hooks = F.to_json(F.struct("text", F.array(F.struct(_of([h[0] for h in HOOKS], tree).alias("command"))).alias("hooks")))
    settings = docs.filter(F.col("doc_id") % len(PATHS) == 0).select(F.concat(F.lit("t"), tree).alias("target_id"), F.lit(".claude/settings.json").alias("path"), hooks.alias("content"))
    found = hook_scripts(files.unionByName(settings))
    return found.select("target_id", "path", F.array_join("scan_names", ",").alias("scan_names"))


def s7_server_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file with one server for each of its lines; every seventh has a server twice."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    clean = F.replace(F.replace(F.regexp_replace("text", r"[\x00-\x09\x0b-\x1f]", " "), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    servers = F.transform(F.split(clean, "\n"), lambda x, i: F.concat(F.lit('"s'), i.cast("string"), F.lit('": {"command": "'), x, F.lit('"}')))
    again = F.when(F.col("doc_id") % 7 == 3, ',\n"s0": {}').otherwise("")
    content = F.concat(F.lit('{"a": [1],\n"mcpServers": {'), F.array_join(servers, SEPARATOR), again, F.lit('},\n"z": {}}'))
    parts = split_servers(docs.select(F.col("doc_id").cast("string").alias("target_id"), F.lit("settings.json").alias("path"), content.alias("content")))
    return parts.select("target_id", "server", "first_line", F.md5(F.col("rule_scan_content").cast("binary")).alias("text_md5"))


QUERIES = {"s12_config_values": s12_config_values, "s12_invalid_configs": s12_invalid_configs, "s8_hook_scripts": s8_hook_scripts, "s7_server_parts": s7_server_parts}

_FORM = lambda nr: _CASE(f"doc_id % {len(FORMS)}", [f[nr] for f in FORMS])
_HOOK = lambda nr: _CASE(f"doc_id // {len(PATHS)} % {len(HOOKS)}", [h[nr] for h in HOOKS])
ORACLES = {
    "s12_config_values": rf"""
WITH d AS (SELECT doc_id, {_FORM(0)} AS path, {_FORM(1)} AS quote, length({_FORM(2)}) AS head, {_FORM(4)} AS above, string_split(regexp_replace(coalesce(text, ''), '[\x00-\x09\x0b-\x1f\x7f]', ' ', 'g'), chr(10)) AS lines
           FROM documents WHERE doc_id % {len(FORMS)} <> 4
), l AS (SELECT doc_id, path, above, head, quote, unnest(lines) AS line, unnest(range(len(lines))) AS nr FROM d
), s AS (SELECT *, length(line) + length(line) - length(replace(line, quote, '')) + length(line) - length(replace(line, '\', '')) + 2 AS size FROM l
), p AS (SELECT *, head + coalesce(sum(size + 2) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s)
SELECT doc_id::VARCHAR AS target_id, path, above || '.' || nr AS keys, md5(line) AS value_md5, pos::INTEGER AS start, (pos + size)::INTEGER AS "end" FROM p""",
    "s12_invalid_configs": f"SELECT doc_id::VARCHAR AS target_id, 'hooks.json' AS path, 'json' AS dialect FROM documents WHERE doc_id % {len(FORMS)} = 4",
    "s8_hook_scripts": f"""SELECT 't' || doc_id // {len(PATHS)} AS target_id, {_HOOK(1)} AS path, {_HOOK(2)} AS scan_names FROM documents m
WHERE doc_id % {len(PATHS)} = 0 AND EXISTS (FROM documents f WHERE f.doc_id // {len(PATHS)} = m.doc_id // {len(PATHS)} AND {_CASE(f"f.doc_id % {len(PATHS)}", PATHS)} = {_CASE(f"m.doc_id // {len(PATHS)} % {len(HOOKS)}", [h[1] for h in HOOKS])})""",
    "s7_server_parts": rf"""
WITH d AS (SELECT doc_id, string_split(replace(replace(regexp_replace(coalesce(text, ''), '[\x00-\x09\x0b-\x1f]', ' ', 'g'), '\', '\\'), '"', '\"'), chr(10)) AS lines FROM documents
), m AS (SELECT doc_id, list_transform(lines, lambda x, i: '"s' || (i - 1) || '": {{"command": "' || x || '"}}') AS members FROM d
), u AS (SELECT doc_id, unnest(members) AS member, unnest(range(len(members))) AS nr FROM m WHERE doc_id % 7 <> 3)
SELECT doc_id::VARCHAR AS target_id, 's' || nr AS server, (nr + 2)::INTEGER AS first_line, md5('{{ "mcpServers": {{ ' || member || ' }} }}') AS text_md5 FROM u
UNION ALL
SELECT doc_id::VARCHAR, NULL, 1, md5('{{"a": [1],' || chr(10) || '"mcpServers": {{' || CASE WHEN doc_id % 7 = 3 THEN list_aggregate(members, 'string_agg', ',' || chr(10)) || ',' || chr(10) || '"s0": {{}}'
  ELSE regexp_replace(list_aggregate(members, 'string_agg', ',' || chr(10)), '[^\n\r]', ' ', 'g') END || '}},' || chr(10) || '"z": {{}}}}') FROM m""",
}
