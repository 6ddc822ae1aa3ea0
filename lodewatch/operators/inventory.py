"""Targets as an inventory: their owners in folder trees, labels, look-up, counts and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import SEVERITIES
from .dedupe import neighbours, path_rank
from .ordering import ranked

MANIFEST = "SKILL.md"
# fixed values: formats of servers, folders in plugins, order of scopes, folders of agents
SERVER_FORMATS = ("mcp-server", "mcp-toml", "mcp-json")
PAYLOAD_FOLDERS = ("agents", "commands", "skills")
SCOPES = ("project", "managed", "user")
AGENT_FOLDERS = (".claude", ".codex", ".cursor")
VERSION_NAME = r"^v?[0-9]+\.[0-9]+\.[0-9]+(?:[-+].*)?$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^([\s\S]*)/[^/]*$", 1)).otherwise("")


def ancestors(path: Column) -> Column:
    """The folders above a path, from the top one to its own; the empty one is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def owners(files: DataFrame) -> DataFrame:
    """``files`` (tree, path) with ``target``: the deepest folder above that holds a manifest, else the root ('').

    An equi-join on the folders above, so no file meets all targets. Nested targets thereby keep their files to
    themselves.
    """
    roots = files.filter(basename(F.col("path")) == MANIFEST).select("tree", dirname(F.col("path")).alias("folder")).distinct().withColumn("is_root", F.lit(True))
    files = files.withColumn("folders", ancestors(F.col("path")))
    above = files.select("tree", "path", F.explode("folders").alias("folder")).distinct()
    deepest = above.join(roots, ["tree", "folder"]).groupBy("tree", "path").agg(F.max_by("folder", F.length("folder")).alias("target"))
    return files.drop("folders").join(deepest, ["tree", "path"], "left").withColumn("target", F.coalesce("target", F.lit("")))


def fallback_name(path: Column) -> Column:
    """The folder's name, or its parent's if the name is a version."""
    name, parent = basename(path), basename(dirname(path))
    return F.when(F.regexp_like(name, F.lit(VERSION_NAME)) & (parent != ""), parent).otherwise(name)


def source_label(path: Column, fmt: Column, name: Column, state: Column) -> Column:
    """Where a target comes from: a marketplace, a server, an extension, a plugin or the user's own folders."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")
    joined = F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/"))
    in_plugins = F.lit(False)
    for folder in AGENT_FOLDERS:
        in_plugins = in_plugins | joined.contains(f"/{folder}/plugins/")
    plugin = (fmt == "plugin.json") | in_plugins | F.array_contains(parts, ".claude-plugin") | F.array_contains(parts, ".codex-plugin")
    at = F.array_min(F.filter(F.array(*[F.when(F.locate(f"/{f}/plugins/", joined) > 0, F.size(F.split(F.substring_index(joined, f"/{f}/plugins/", 1), "/"))) for f in AGENT_FOLDERS[:2]]), lambda n: n.isNotNull()))
    rest = F.slice(parts, at + 2, F.greatest(F.size(parts), F.lit(1)))  # segments after "plugins"
    payload = F.array_min(F.filter(F.transform(F.array(*map(F.lit, PAYLOAD_FOLDERS)), lambda s: F.array_position(rest, s)), lambda n: n > 0))
    found = F.when(at.isNull(), F.lit(None)).when(F.get(rest, F.lit(0)) == "cache", F.get(rest, F.lit(2))).when(payload > 1, F.get(rest, (payload - 2).cast("int"))).otherwise(F.element_at(parts, -1))
    owner = F.when(fmt == "plugin.json", name).otherwise(found)
    label = F.when(owner.isNull(), "Plugin").otherwise(F.concat(F.lit("Plugin - "), owner))
    return F.when(state == "marketplace", "Marketplace").when(fmt.isin(*SERVER_FORMATS), "MCP").when(fmt == "gemini-extension-json", "Extension").when(plugin, label).otherwise("Direct")


def install_state(path: Column) -> Column:
    return F.when(neighbours(path, "plugins", "marketplaces"), "marketplace").otherwise("installed")


def list_order(targets: DataFrame) -> DataFrame:
    """``targets`` (scope, state, agent_id, name, path) with ``rank`` of the inventory list."""
    rows = targets.withColumn("scope_rank", F.array_position(F.array(*map(F.lit, SCOPES)), F.col("scope")))
    return ranked(rows, ["scope_rank", "state", "agent_id", "name", "path"]).drop("scope_rank")


def look_up(targets: DataFrame, wanted: str) -> DataFrame:
    """The first of ``targets`` (id, name, path) that has the name, else the id, else holds the text in its name; by path."""
    raw = wanted.strip()
    name = F.lower("name")
    rank = F.when(name == raw.lower(), 0).when(F.col("id") == raw, 1).when(name.contains(raw.lower()), 2)
    return targets.withColumn("found", rank).filter(F.col("found").isNotNull() & F.lit(raw != "")).orderBy("found", "path").limit(1).drop("found")


def agent_paths(targets: DataFrame) -> DataFrame:
    """(tree_sha256, agent_id, path): each agent's primary path to a tree."""
    return targets.filter("tree_sha256 <> ''").groupBy("tree_sha256", "agent_id").agg(F.min_by("path", F.struct(path_rank(F.col("path")), "path")).alias("path"))


def agent_counts(merged: DataFrame) -> DataFrame:
    """(agent_id, targets): merged targets (agent_ids) by agent, each once."""
    return merged.select(F.explode(F.array_distinct("agent_ids")).alias("agent_id")).groupBy("agent_id").agg(F.count("*").alias("targets"))


def distinct_installations(installs: DataFrame) -> DataFrame:
    """``installs`` (tree_sha256, scope, format, scan_name) without repetition."""
    return installs.select("tree_sha256", "scope", "format", "scan_name").distinct()


def percent_text(percent: Column) -> Column:
    """Two decimals below one per cent, else a whole number."""
    return F.when((percent > 0) & (percent < 1), F.format_string("%.2f", percent)).otherwise(percent.cast("long").cast("string"))


def short_message(message: Column, rule_id: Column) -> Column:
    """A message without its detail, end mark and "detected", of 56 characters at most; a rule's words if nothing is left."""
    text = F.element_at(F.split(F.trim(F.regexp_replace(message, r"\s+", " ")), r"\s+[-—]\s+"), 1)
    text = F.regexp_replace(F.regexp_replace(text, r"[.!?]+$", ""), r"(?i)\s+detected$", "")
    words = F.array_join(F.filter(F.split(F.lower(rule_id), "-"), lambda w: w != ""), " ")
    label = F.when(F.length(text) > 0, text).otherwise(words)
    return F.when(F.length(label) <= 56, label).otherwise(F.concat(F.rtrim(F.substring(label, 1, 53)), F.lit("...")))


def top_issues(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """``targets`` (target_id, allowlisted) with ``top_issue``: the first of the most severe findings (by path, line, rule) and its place."""
    severity = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    label = F.concat(short_message(F.col("message"), F.col("rule_id")), F.when(F.col("line") > 0, F.format_string(" (%s:%d)", basename(F.col("path")), F.col("line"))).otherwise(""))
    first = findings.groupBy("target_id").agg(F.min_by(label, F.struct(severity, "path", "line", "rule_id")).alias("label"))
    return targets.join(first, "target_id", "left").withColumn("top_issue", F.when(F.col("allowlisted"), "allowlisted ✓").otherwise(F.coalesce("label", F.lit("—")))).drop("label")


def exit_code(verdict: Column, fail_on: str = "FAIL", strict: bool = False, incomplete: bool = False) -> Column:
    """1 if the verdict reaches the threshold, else 3 for an incomplete run, else 0."""
    bad = verdict != "PASS" if strict or fail_on.upper() == "REVIEW" else verdict == "FAIL"
    return F.when(bad, 1).otherwise(3 if incomplete else 0)
