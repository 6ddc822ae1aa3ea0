"""Rules matched over whole texts; matches mapped to line and column, one finding a rule and line.

A file meets the patterns of its name that its text may match: a search for the words that a pattern requires leaves few.
Views are made for these files alone. All of this is one narrow stage; only findings are shuffled.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import SPACE_CHARS, java_pattern, recurses, required
from ..functions.views import DECODING, VIEWS, views
from ..plans.catalog import RULES, Rule
from ..plans.linear import linear_forms

#: Private-use characters that mark the starts of matches and the ends of groups; taken out of texts first.
MARK, GROUP = "\ue000", "\ue001"


def matches_glob(name: Column, glob: str) -> Column:
    """A glob is a whole name, or what stands before its first and after its last star; the two may overlap."""
    if "*" not in glob:
        return name == glob
    return name.startswith(glob.split("*", 1)[0]) & name.endswith(glob.rsplit("*", 1)[1])


def applies(name: Column, rule: Rule) -> Column:
    return reduce(lambda a, b: a | b, [matches_glob(name, g) for g in rule.names])


PATTERNS = "array<struct<rule_id: string, severity: string, message: string, pattern_idx: int, view: string, pattern: string, placed: boolean, always: boolean, scopes: array<string>, words: array<string>, globs: array<struct<head: string, tail: string, whole: boolean>>>>"


@lru_cache(maxsize=8)
def _rows(rules: tuple[Rule, ...]) -> str:
    """All patterns as JSON. A pattern on which Java would recurse over the text is refused."""
    rows = []
    for rule in rules:
        globs = [{"head": g.split("*", 1)[0], "tail": g.rsplit("*", 1)[-1], "whole": "*" not in g} for g in rule.names]
        for i, p in enumerate(rule.patterns):
            if any(map(recurses, forms := linear_forms(p))):
                raise ValueError(f"pattern {i} of {rule.rule_id} repeats a group without bound; make the repeat possessive")
            # patterns of the escalated view come before all others
            tried = [(rule.severity, rule.view, i)] + ([(*rule.escalated, i - len(rule.patterns))] if rule.escalated else [])
            for (severity, view, nr), form in product(tried, forms):
                rows.append({"rule_id": rule.rule_id, "severity": severity, "message": rule.message, "pattern_idx": nr, "view": view, "pattern": java_pattern(form), "placed": "(?<finding>" in form, "always": view in DECODING, "scopes": rule.scopes, "words": required(p), "globs": globs})
    return json.dumps(rows)


def _patterns(rules: tuple[Rule, ...]) -> Column:
    """One constant; building it column by column would take longer than matching."""
    return F.from_json(F.lit(_rows(rules)), PATTERNS)


def candidates(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(target_id, path, content, patterns): each file that may match, with the patterns that may match it.

    Masked text holds no word that the whole text doesn't hold, so the whole text decides. A pattern that requires no
    word is tried, and so is one whose view decodes escapes. Rules of a scope ask for ``installations`` of the file,
    array<struct<format, scope, scan_name>>; files without that column meet none of them.
    """
    text = F.translate(F.coalesce("content", F.lit("")), MARK + GROUP, "")
    # one row in an array, so that the text is made and lowered once and not for each word
    bound = F.array(F.struct(text.alias("content"), F.lower(text).alias("lowered"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("installations").alias("installations") if "installations" in files.columns else F.lit(None).cast("array<struct<format: string, scope: string, scan_name: string>>").alias("installations")))
    glob = lambda g, name: F.when(g["whole"], name == g["head"]).otherwise(name.startswith(g["head"]) & name.endswith(g["tail"]))

    def of_file(t: Column) -> Column:
        named = lambda p: F.exists(p["globs"], lambda g: glob(g, t["name"]))
        installed = lambda p: F.coalesce(F.exists(t["installations"], lambda i: (i["format"] == "agent-config") & F.array_contains(p["scopes"], i["scope"]) & F.exists(p["globs"], lambda g: glob(g, i["scan_name"]))), F.lit(False))
        held = lambda p: F.when(p["always"], F.lit(True)).when(F.size(p["words"]) == 0, F.regexp_like(t["content"], p["pattern"])).otherwise(F.exists(p["words"], lambda w: t["lowered"].contains(w)))
        fitting = F.filter(_patterns(rules), lambda p: F.when(~named(p), F.lit(False)).when((F.size(p["scopes"]) > 0) & ~installed(p), F.lit(False)).otherwise(held(p)))
        return F.struct(t["content"].alias("content"), F.transform(fitting, lambda p: p.dropFields("words", "globs", "scopes", "always")).alias("patterns"))

    found = F.filter(F.transform(bound, of_file), lambda x: F.size(x["patterns"]) > 0)
    return files.select("target_id", "path", F.explode(found).alias("x")).select("target_id", "path", "x.content", "x.patterns")


def _marked(text: Column, p: Column) -> Column:
    """The text with ``MARK`` where each match is placed: at its start, or where the text of its group ``finding`` first stands in it."""
    at_start = F.regexp_replace(text, p["pattern"], F.lit(MARK + "$0"))
    pieces = F.split(F.regexp_replace(text, p["pattern"], F.lit(MARK + "${finding}" + GROUP + "$0")), MARK)

    def placed(piece: Column) -> Column:
        found, rest = F.substring_index(piece, GROUP, 1), F.substring_index(piece, GROUP, -1)
        at = F.instr(rest, found)
        return F.when(F.contains(piece, F.lit(GROUP)), F.concat(F.substring(rest, F.lit(1), at - 1), F.lit(MARK), F.substring(rest, at, F.length(rest)))).otherwise(piece)

    return F.when(p["placed"], F.array_join(F.transform(pieces, placed), "")).otherwise(at_start)


def dealt(files: DataFrame) -> DataFrame:
    """``files`` over as many tasks as there are cores, where the scan has fewer: matching is one narrow stage, and a table of
    few row groups, or a few heavy ones, would leave most cores idle. Texts move once; findings are small."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    if files.rdd.getNumPartitions() >= cores:
        return files
    return files.repartition(4 * cores, F.xxhash64("target_id", "path"))


def match_all(files: DataFrame, rules: tuple[Rule, ...] = RULES, masked: bool = True) -> DataFrame:
    """(target_id, path, rule_id, severity, message, pattern_idx, line, column, snippet): the first match of each pattern on each line of ``files`` (target_id, path, content).

    A rule reads the view that it names, or with ``masked`` off the whole content. Views keep lines, so places carry over.
    Null content holds no match; repeated files are matched one by one; extra columns are left alone.
    """
    rows = candidates(dealt(files), rules)
    text = F.col("content")
    if masked:
        wanted = F.array_distinct(F.transform("patterns", lambda p: p["view"]))
        rows = rows.withColumn("views", views(F.col("content"), F.col("path"), wanted))
        for view in VIEWS:
            text = F.when(F.col("p.view") == view, F.translate(F.col(f"views.{view}"), MARK + GROUP, "")).otherwise(text)
    rows = rows.withColumn("p", F.explode("patterns"))

    def hits(marked: Column) -> Column:
        lines = F.arrays_zip(F.split(marked, "\n").alias("marked"), F.split("content", "\n").alias("own"))
        lines = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x["marked"].alias("marked"), x["own"].alias("own")))
        return F.when(F.contains(marked, F.lit(MARK)), F.filter(lines, lambda x: F.contains(x["marked"], F.lit(MARK))))

    rows = rows.select("target_id", "path", "p", F.explode(F.element_at(F.transform(F.array(_marked(text, F.col("p"))), hits), 1)).alias("hit"))
    # columns count UTF-16 units
    column = F.octet_length(F.encode(F.substring_index("hit.marked", MARK, 1), "UTF-16BE")) / 2 + 1
    snippet = F.substring(F.btrim("hit.own", F.lit(SPACE_CHARS)), 1, 120)
    return rows.select("target_id", "path", "p.rule_id", "p.severity", "p.message", "p.pattern_idx", F.col("hit.line").alias("line"), column.cast("int").alias("column"), snippet.alias("snippet"))


def first_per_line(matches: DataFrame) -> DataFrame:
    """One finding a file, rule and line: of the first pattern, at its first place."""
    w = Window.partitionBy("target_id", "path", "rule_id", "line").orderBy("pattern_idx", "column")
    return matches.withColumn("nr", F.row_number().over(w)).filter("nr = 1").drop("nr", "pattern_idx")


def fingerprints(findings: DataFrame) -> DataFrame:
    """Findings with ``line_hash``, which names rule, file and line text, and counts equal ones."""
    digest = F.substring(F.sha2(F.concat_ws("\u0000", "rule_id", "path", F.regexp_replace("snippet", java_pattern(r"\s+"), " ")), 256), 1, 16)
    w = Window.partitionBy("digest").orderBy("line", "column")
    return findings.withColumn("digest", digest).withColumn("line_hash", F.concat_ws(":", "digest", F.row_number().over(w))).drop("digest")
