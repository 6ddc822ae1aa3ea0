"""Supporting documents: which markdown files a target's manifests name, and what findings in the others count for.

A manifest (a target's SKILL.md, or one in a folder above it) names files and folders in links, in paths of its prose and in
phrases such as "in the docs folder". Names are cut out by built-in patterns, one row each, and made relative to the
target. Whether a named folder holds a file is a join by equality: each file stands once for every folder above it. So a
manifest may name any number of paths, and nothing is gathered by target.

A markdown file below a folder of documents, examples or tests that no manifest names is inert: its findings become notes
that don't count for the verdict. Defined cases: null content names nothing; a target without a SKILL.md of its own has
operative files only; a file known by further paths is inert only if all of them are; repeated rows don't multiply files;
extra columns of findings are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import SPACE_CHARS, java_pattern
from .inventory import basename

# fixed values: names that are operative wherever they stand, folders of supporting material, phrases and paths in prose
OPERATIVE_NAMES = ("SKILL.md", "AGENTS.md", "AGENTS.override.md", "CLAUDE.md", "GEMINI.md", "CONVENTIONS.md", ".cursorrules", ".windsurfrules", "plugin.json", "gemini-extension.json", "README.md", "COMMAND.md", "config.toml", "settings.json", ".mcp.json", "mcp.json")
SUPPORTING_FOLDERS = ("doc", "docs", "documentation", "example", "examples", "fixture", "fixtures", "reference", "references", "test", "tests")
EVERYTHING = r"(?i)\b(?:nearby files|bundled resources|all supporting (?:files|docs|documents)|all docs)\b"
LINK = r"\]\(([^)\s]+)(?:\s+[\"'][^\"']*[\"'])?\)"
PATH = r"(?:\A|[\s`\"'(])((?:\./)?[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.{}*?\[\]-]+)+(?:/)?|(?:\./)?[A-Za-z0-9_.-]+\.(?:md|mdc|txt|json|toml|ya?ml|js|ts|mjs|cjs|py|sh|bash))(?:[\s`\"',).;:]|\z)"
FOLDER = r"(?i)\b(?:in|under|from|inside|within)\s+(?:the\s+)?(docs?|documentation|examples?|references?)\b"
INERT, OPERATIVE, NOTE = "inert-supporting-docs", "operative", "Inert supporting docs: "


def normalised(raw: Column) -> Column:
    """A named path relative to its manifest, with slashes; null for anything that is no path below it."""
    out = F.btrim(raw, F.lit(SPACE_CHARS))
    out = F.regexp_replace(F.regexp_replace(out, r"\A<|>\z", ""), r"[),.;:]+\z", "")
    out = F.substring_index(F.substring_index(out, "#", 1), "?", 1)
    out = F.regexp_replace(out, r"\A\./", "")
    away = (out == "") | out.startswith("/") | out.startswith("../") | F.regexp_like(out, F.lit(r"(?i)\A[a-z][a-z0-9+.-]*:"))
    return F.when(~away, F.translate(out, "\\", "/"))


def references(manifests: DataFrame) -> DataFrame:
    """(target_id, ref, folder): what ``manifests`` (target_id, below, content) name, relative to the target.

    ``below`` is the target's folder as seen from the manifest, with a slash at its end, or empty. A folder ends with a
    slash too; an empty one is the whole target.
    """
    c = F.col
    found = lambda p, i=1: F.regexp_extract_all("content", F.lit(java_pattern(p)), F.lit(i))
    named = F.concat(found(LINK), found(PATH), F.transform(found(FOLDER), lambda x: F.concat(x, F.lit("/"))))
    rows = manifests.filter("content IS NOT NULL").select("target_id", "below", F.explode(F.array_distinct(named)).alias("raw"))
    rows = rows.select("target_id", "below", normalised(c("raw")).alias("ref")).filter("ref IS NOT NULL")
    before = F.regexp_extract("ref", r"\A([^*?\[{]*)", 1)
    within = F.regexp_extract(before, r"\A(.*/)?", 1)
    plain = ~F.regexp_like("ref", F.lit(r"\.[^/]*\z")) | F.regexp_like("ref", F.lit(r"(?:\A|/)\.[^./]*\z"))  # no extension
    folder = F.when(before != c("ref"), within).when(c("ref").endswith("/"), c("ref")).when(plain, F.concat("ref", F.lit("/")))
    rows = rows.withColumn("named_folder", folder).filter("named_folder IS NULL OR named_folder <> ''")
    inside = F.coalesce("named_folder", "ref").startswith(c("below"))
    whole = c("named_folder").isNotNull() & c("below").startswith(c("named_folder"))
    rest = F.when(inside, F.expr("substring(coalesce(named_folder, ref), length(below) + 1)")).when(whole, F.lit(""))
    return rows.select("target_id", rest.alias("ref"), c("named_folder").isNotNull().alias("folder")).filter("ref IS NOT NULL").distinct()


def name_everything(manifests: DataFrame) -> DataFrame:
    """(target_id): targets of which a manifest names all documents."""
    return manifests.filter(F.regexp_like("content", F.lit(java_pattern(EVERYTHING)))).select("target_id").distinct()


def manifests_of(roots: DataFrame, files: DataFrame) -> DataFrame:
    """(target_id, below, content): the SKILL.md of each root, if it has one, and those of the folders above it and above its copies.

    ``roots`` has target_id and root, a row for each place where the target lies, and ``own``, whether it is the first
    of them; ``files`` has path and content.
    """
    skills = files.filter(F.col("path").endswith("/SKILL.md")).select(F.regexp_replace("path", r"/SKILL\.md$", "").alias("dir"), "content").dropDuplicates(["dir"])
    own = roots.filter("own").join(skills, F.col("root") == F.col("dir")).select("target_id", F.lit("").alias("below"), "content")
    parts = F.split("root", "/")
    above = roots.join(own.select("target_id").distinct(), "target_id", "left_semi")
    above = above.filter(F.size(parts) > 1).select("target_id", "root", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    outer = above.join(skills, "dir").select("target_id", F.expr("substring(root, length(dir) + 2) || '/'").alias("below"), "content")
    return own.unionByName(outer)


def _reached(paths: DataFrame, named: DataFrame) -> DataFrame:
    """(target_id, path): the paths that stand in ``named`` themselves or below one of its folders."""
    by_name = paths.join(named.filter("NOT folder").select("target_id", F.col("ref").alias("path")), ["target_id", "path"], "left_semi").select("target_id", "path")
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    below = paths.select("target_id", "path", F.explode(folders).alias("ref"))
    by_folder = below.join(named.filter("folder").select("target_id", "ref"), ["target_id", "ref"], "left_semi").select("target_id", "path")
    return by_name.unionByName(by_folder).distinct()


def supporting(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, SUPPORTING_FOLDERS)))


def file_roles(files: DataFrame, manifests: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(target_id, path, role) of ``files`` (target_id, path), paths relative to their targets.

    ``aliases`` has target_id, path and alias: further paths of a file. ``manifests`` is read three times and best written.
    """
    own = files.select("target_id", "path").distinct()
    named = references(manifests)
    indexed = manifests.filter("below = '' AND content IS NOT NULL").select("target_id").distinct().withColumn("indexed", F.lit(True))
    everything = name_everything(manifests).withColumn("everything", F.lit(True))
    paths = own.select("target_id", "path", F.col("path").alias("known"))
    if aliases is not None:
        paths = paths.unionByName(own.join(aliases.select("target_id", "path", F.col("alias").alias("known")), ["target_id", "path"]))
    reached = _reached(paths.select("target_id", F.col("known").alias("path")).distinct(), named).select("target_id", F.col("path").alias("known"), F.lit(True).alias("reached"))
    known = paths.join(reached, ["target_id", "known"], "left")
    live = known.groupBy("target_id", "path").agg(F.bool_or(F.coalesce("reached", F.lit(False)) | ~supporting(F.col("known"))).alias("live"))
    rows = live.join(indexed, "target_id", "left").join(everything, "target_id", "left")
    is_text = F.col("path").endswith(".md") | F.col("path").endswith(".mdc")
    inert = F.col("indexed").isNotNull() & F.col("everything").isNull() & is_text & ~basename(F.col("path")).isin(*OPERATIVE_NAMES) & ~F.col("live")
    return rows.select("target_id", "path", F.when(inert, INERT).otherwise(OPERATIVE).alias("role"))


def demoted(findings: DataFrame, roles: DataFrame) -> DataFrame:
    """``findings`` with ``file_role`` (null where operative) and ``ignored_for_verdict``; those of inert files are notes."""
    inert = roles.filter(F.col("role") == INERT).select("target_id", "path", F.col("role").alias("file_role"))
    rows = findings.drop("file_role").join(inert, ["target_id", "path"], "left")
    note = F.col("file_role").isNotNull()
    ignored = F.coalesce(F.col("ignored_for_verdict"), F.lit(False)) if "ignored_for_verdict" in findings.columns else F.lit(False)
    return rows.withColumns({"severity": F.when(note, "info").otherwise(F.col("severity")), "message": F.when(note, F.concat(F.lit(NOTE), "message")).otherwise(F.col("message")), "ignored_for_verdict": note | ignored})
