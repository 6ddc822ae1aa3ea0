"""Servers and settings that configuration files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mcp_servers(files: DataFrame, key: str = "mcpServers") -> DataFrame:
    """(path, server, command, url) of each entry of the map ``key`` in JSON ``files`` (path, content).

    Files that are no JSON, or hold no such map, give no rows. A server is scanned by itself and never merged with
    another, so it has no hash.
    """
    rows = files.select("path", F.try_parse_json("content").alias("v")).filter(F.col("v").isNotNull())
    rows = rows.select("path", F.try_variant_get("v", f"$.{key}", "map<string, variant>").alias("servers"))
    rows = rows.select("path", F.explode("servers").alias("server", "own"))
    return rows.select("path", "server", F.try_variant_get("own", "$.command", "string").alias("command"), F.try_variant_get("own", "$.url", "string").alias("url"))
