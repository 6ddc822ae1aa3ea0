"""Plugin folders that are loaded: install records whose plugin is switched on where the record applies.

Settings are layers of rows; of those that hold for a project (the user's own, the project's, the project's local ones) the
last layer that names a plugin wins. The layers of a project meet its records by plugin and project, the user's by plugin.

Defined cases: broken documents and records without a path give no rows; values that are no booleans say nothing; a plugin
that no layer names is on; a record installed by managed settings stays on; repeated rows don't multiply folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER, PROJECT, LOCAL = 1, 2, 3
MANAGED = "managed"


def install_records(files: DataFrame) -> DataFrame:
    """(plugin_id, scope, install_path, project_path) of record documents (content): a map of plugins to lists of installs."""
    plugins = F.try_variant_get(F.try_parse_json("content"), "$.plugins", "map<string, variant>")
    rows = files.select(F.explode(plugins).alias("plugin_id", "installs")).select("plugin_id", F.explode(F.try_variant_get("installs", "$", "array<variant>")).alias("i"))
    text = lambda name: F.when(F.schema_of_variant(F.try_variant_get("i", f"$.{name}", "variant")) == "STRING", F.try_variant_get("i", f"$.{name}", "string"))
    return rows.select("plugin_id", text("scope").alias("scope"), text("installPath").alias("install_path"), text("projectPath").alias("project_path")).filter("install_path IS NOT NULL")


def enabled_plugins(files: DataFrame) -> DataFrame:
    """(layer, project, plugin_id, enabled) of settings documents (layer, project, content); the user's have no project."""
    plugins = F.try_variant_get(F.try_parse_json("content"), "$.enabledPlugins", "map<string, variant>")
    rows = files.select("layer", "project", F.explode(plugins).alias("plugin_id", "value"))
    return rows.filter(F.schema_of_variant("value") == "BOOLEAN").select("layer", "project", "plugin_id", F.try_variant_get("value", "$", "boolean").alias("enabled"))


def below(folder: Column, path: Column) -> Column:
    """Whether a path without steps upwards lies in the folder."""
    return path.startswith(F.concat(folder, F.lit("/"))) & ~F.regexp_like(path, F.lit(r"(?:^|/)\.\.(?:/|$)"))


def active_installs(records: DataFrame, settings: DataFrame, cache: str, here: str) -> DataFrame:
    """(install_path) of the folders below ``cache`` that are loaded; records without a project apply to ``here``."""
    rows = records.withColumn("project", F.coalesce("project_path", F.lit(here))).filter(below(F.lit(cache), F.col("install_path")))
    rows = rows.select("plugin_id", "scope", "install_path", "project").distinct()
    # one row a plugin and layer; equal layers that disagree count as switched on
    layers = settings.filter("enabled IS NOT NULL").groupBy("layer", "project", "plugin_id").agg(F.bool_or("enabled").alias("enabled"))
    own = layers.filter(F.col("layer") > USER).groupBy("project", "plugin_id").agg(F.max_by("enabled", "layer").alias("theirs"))
    user = layers.filter(F.col("layer") == USER).groupBy("plugin_id").agg(F.bool_or("enabled").alias("users"))
    rows = rows.join(own, ["project", "plugin_id"], "left").join(user, "plugin_id", "left")
    on = F.coalesce("theirs", "users", F.lit(True)) | F.coalesce(F.col("scope") == MANAGED, F.lit(False))
    return rows.filter(on).select("install_path").distinct()
