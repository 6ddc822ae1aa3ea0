"""What the agents of a machine load: places as data, met with a listing of files.

Each place is a folder below a root and a pattern for the rest. Files meet places by an equi-join on the folders above them, so
no file is tried against all places. Inputs: ``listing`` (machine, path), absolute paths of files; ``machines`` (machine, home, cwd).

Defined cases: a machine without files has no targets; repeated rows count once; null paths are left out; extra columns are
left alone; a place that two patterns of an agent find is one target in each scope.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.places import HOOK, INSTALLED, NEVER, PLACES, SKILL
from .dedupe import neighbours
from .inventory import ancestors, basename, dirname


def glob_regex(glob: str) -> str:
    """A pattern of Java for a glob: ``**/`` is any folders, ``*`` a part of a name, ``[..]`` a choice."""
    parts = re.split(r"(\*\*/|\*|\[[a-z]+\])", glob)
    return r"\A" + "".join({"**/": "(?:.*/)?", "*": "[^/]*"}.get(p) or (p if p.startswith("[") else re.sub(r"([^\w/-])", r"\\\1", p)) for p in parts) + r"\z"


def split_glob(glob: str) -> tuple[str, str]:
    """The folder that a glob names, with a slash before it, and the pattern of the rest."""
    names = glob.split("/")
    n = next((i for i, name in enumerate(names) if "*" in name or "[" in name), len(names) - 1)
    n = min(n, len(names) - 1)
    return "".join("/" + x for x in names[:n]), glob_regex("/".join(names[n:]))


def roots(listing: DataFrame, machines: DataFrame, plugins: DataFrame | None = None) -> DataFrame:
    """(machine, root, folder, scope): the folders in which places are looked for; ``plugins`` (machine, folder) are active ones.

    The repository's root is the deepest folder at or above the working one that holds ``.git``; without it all folders count.
    """
    machines = machines.select("machine", "home", "cwd")
    above = machines.select("machine", "home", "cwd", F.explode(F.array_distinct(F.concat(ancestors(F.col("cwd")), F.array("cwd")))).alias("folder"))
    marked = listing.filter(F.regexp_like("path", F.lit(r"/\.git(/|\z)"))).select("machine", F.regexp_extract("path", r"\A(.*?)/\.git(?:/|\z)", 1).alias("folder")).distinct().withColumn("git", F.lit(True))
    above = above.join(marked, ["machine", "folder"], "left")
    tops = above.groupBy("machine").agg(F.max(F.when(F.col("git"), F.length("folder"))).alias("top"))
    above = above.join(tops, "machine").withColumn("inside", F.length("folder") >= F.coalesce("top", F.lit(0)))
    below_home = (F.length("folder") > F.length("home")) | ~F.startswith(F.concat("home", F.lit("/")), F.concat("folder", F.lit("/")))
    kinds = F.array_compact(F.array(F.when(F.col("folder") == F.col("cwd"), "project"), F.lit("above"), F.when(F.col("inside"), "parents"), F.when(F.col("inside") & below_home, "inner parents")))
    out = above.select("machine", F.explode(kinds).alias("root"), "folder", F.lit("project").alias("scope"))
    out = out.unionByName(machines.select("machine", F.lit("home").alias("root"), F.col("home").alias("folder"), F.lit("user").alias("scope")))
    if plugins is not None:
        out = out.unionByName(plugins.select("machine", F.lit("plugin").alias("root"), "folder", F.lit("user").alias("scope")))
    return out.distinct()


def installed_agents(listing: DataFrame, machines: DataFrame) -> DataFrame:
    """(machine, agent_id): the agents of which a file lies in a folder of theirs, at home or in the working folder; instructions of all agents are always read."""
    spark = listing.sparkSession
    signs = F.broadcast(spark.createDataFrame(list(INSTALLED), "agent_id string, at string, below string"))  # a dozen constant rows
    wanted = machines.join(signs).select("machine", "agent_id", F.concat(F.when(F.col("at") == "home", F.col("home")).otherwise(F.col("cwd")), F.lit("/"), "below").alias("folder"))
    found = _folders(listing).join(wanted, ["machine", "folder"]).select("machine", "agent_id")
    return found.unionByName(machines.select("machine", F.lit("cross-agent").alias("agent_id"))).distinct()


def _folders(listing: DataFrame) -> DataFrame:
    rows = listing.filter("path IS NOT NULL").select("machine", "path")
    return rows.select("machine", "path", F.explode(F.array_distinct(ancestors(F.col("path")))).alias("folder"))


def discovered(listing: DataFrame, machines: DataFrame, plugins: DataFrame | None = None, agent: str | None = None, marketplaces: bool = False) -> DataFrame:
    """(machine, agent_id, scope, format, path, manifest_path, scan_name) of all that installed agents load.

    A target of a skill or hook is its folder, any other its file. Caches and bins of plugins are never read, but for active
    ``plugins``; what lies in marketplaces only with ``marketplaces``. ``agent`` asks for one alone.
    """
    spark = listing.sparkSession
    rows = [(a, root, *split_glob(glob), kind, name) for a, root, glob, kind, name in PLACES if agent in (None, a)]
    places = F.broadcast(spark.createDataFrame(rows, "agent_id string, root string, below string, rest string, format string, scan_name string"))  # constant rows, under 200
    wanted = roots(listing, machines, plugins).join(places, "root").join(installed_agents(listing, machines), ["machine", "agent_id"], "left_semi")
    wanted = wanted.select("machine", "agent_id", "scope", "format", "scan_name", "rest", F.col("root") == "plugin", F.concat("folder", "below").alias("folder")).toDF("machine", "agent_id", "scope", "format", "scan_name", "rest", "active", "folder")
    found = _folders(listing).join(wanted, ["machine", "folder"])
    found = found.filter(F.regexp_like(F.substring(F.col("path"), F.length("folder") + 2, F.length("path")), F.col("rest")))
    never = F.lit(False)
    for part in NEVER:
        never = never | F.contains(F.col("path"), F.lit(part))
    found = found.filter(F.col("active") | ~never)
    if not marketplaces:
        found = found.filter(F.col("active") | ~neighbours(F.col("path"), "plugins", "marketplaces"))
    path = F.when(basename(F.col("path")).isin(SKILL, HOOK), dirname(F.col("path"))).otherwise(F.col("path"))
    rows = found.select("machine", "agent_id", "scope", "format", path.alias("path"), F.col("path").alias("manifest_path"), F.coalesce("scan_name", basename(F.col("path"))).alias("scan_name"))
    return rows.distinct()
