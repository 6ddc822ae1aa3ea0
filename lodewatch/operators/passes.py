"""Several passes over one file: the names that select its rules, each with the view that the name stands for.

A file is matched under its own name and, if its first line names an interpreter, under that name with the extension of the
interpreter's language; or under the names that discovery gave it, and then under no other. A file may come with a text of its
own instead of its content, as one server's definition cut out of a shared file does. Passes are rows, so they are matched
as files are; of the matches of a rule on a line the first pass's stays.

Defined cases: null content has no passes that match; an unknown interpreter adds none; a name given twice counts once;
repeated files are matched one by one; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import SPACE_CHARS
from ..plans.catalog import RULES, Rule
from .inventory import basename
from .matching import match_all

# fixed values: interpreters and the extensions of their languages, and how far a first line is read
INTERPRETERS = {"sh": ".sh", "bash": ".sh", "dash": ".sh", "zsh": ".sh", "ksh": ".sh", "python": ".py", "node": ".js", "ruby": ".rb", "deno": ".ts", "bun": ".ts"}
HEAD_BYTES = 256


def interpreter_of(content: Column) -> Column:
    """The program of a first line ``#!``, without folder and version; what ``env`` runs, if that is named. Else null."""
    head = F.substring(content.cast("binary"), 1, HEAD_BYTES).cast("string")
    words = F.split(F.btrim(F.regexp_extract(head, r"\A#!([^\n]*)", 1), F.lit(SPACE_CHARS)), r"\s+")
    program = F.get(words, F.lit(0))
    run = F.get(F.filter(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: ~w.startswith("-") & ~F.contains(w, F.lit("="))), F.lit(0))
    named = F.when(basename(program) == "env", run).otherwise(program)
    return F.when(head.startswith("#!"), F.regexp_replace(basename(named), r"\d[\d.]*\z", ""))


def language_of(program: Column) -> Column:
    """The extension of the language that a program runs, whatever its folder and version; null for others."""
    extensions = F.create_map(*[F.lit(x) for pair in INTERPRETERS.items() for x in pair])
    return F.try_element_at(extensions, F.regexp_replace(basename(program), r"\d[\d.]*\z", ""))


def shebang_name(path: Column, content: Column) -> Column:
    """The file's name with the extension of the language that runs it, if that isn't its own."""
    extension = language_of(interpreter_of(content))
    name = basename(path)
    return F.when(extension.isNotNull() & ~name.endswith(extension), F.concat(name, extension))


def passes(files: DataFrame) -> DataFrame:
    """(target_id, path, pass, scan_path, content, installations) of ``files`` (target_id, path, content).

    ``files`` may have scan_names (array of names that discovery gave), rule_scan_content (a text that stands for the
    content) and installations.
    """
    has = lambda name, kind: F.col(name) if name in files.columns else F.lit(None).cast(kind)
    given = has("scan_names", "array<string>")
    text = F.coalesce(has("rule_scan_content", "string"), F.col("content"))
    # a text of its own has no first line that a system would read
    own = F.array_compact(F.array(basename(F.col("path")), F.when(has("rule_scan_content", "string").isNull(), shebang_name(F.col("path"), F.col("content")))))
    names = F.array_distinct(F.when(F.size(given) > 0, given).otherwise(own))
    rows = files.select("target_id", "path", text.alias("content"), has("installations", "array<struct<format: string, scope: string, scan_name: string>>").alias("installations"), F.posexplode(names).alias("pass", "scan_name"))
    folder = F.regexp_extract("path", r"\A(.*/)?", 1)
    return rows.select("target_id", "path", "pass", F.concat(folder, "scan_name").alias("scan_path"), "content", "installations")


def match_passes(files: DataFrame, rules: tuple[Rule, ...] = RULES, masked: bool = True) -> DataFrame:
    """What ``match_all`` finds in each pass, with ``pass``, at the files' own paths."""
    rows = passes(files)
    key = F.struct("target_id", "path", "pass").alias("target_id")
    found = match_all(rows.select(key, F.col("scan_path").alias("path"), "content", "installations"), rules, masked)
    own = [c for c in found.columns if c not in ("target_id", "path")]
    return found.select("target_id.target_id", "target_id.path", "target_id.pass", *own)


def first_of_passes(matches: DataFrame) -> DataFrame:
    """One finding a file, rule and line: of the first pass, its first pattern, at its first place."""
    w = Window.partitionBy("target_id", "path", "rule_id", "line").orderBy("pass", "pattern_idx", "column")
    return matches.withColumn("nr", F.row_number().over(w)).filter("nr = 1").drop("nr", "pattern_idx")
