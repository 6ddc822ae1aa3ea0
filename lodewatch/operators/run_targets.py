"""Files that a target's manifest tells the agent to run, or that a command of its settings names.

Manifests meet the names of their target's files first, so only lines that hold a name are cut into words with places, each
with the end of what stands before it; every second part of a text that is cut at marks of fences is fenced. A word counts as a command word if a verb such as "run" stands before it in the sentence, if a
program that runs files stands right before it, or if it begins a command inside a fence. Words meet files by equality:
a word is taken with each of its ends that begins behind a slash, a file with each shorter path that still has a folder.
File names that hold a character at which words are cut are looked up in the texts of their target instead.

Defined cases: null content names nothing; a word counts however often it stands; a negation doesn't matter, so a sample may
be shown but nothing is hidden; repeated rows don't multiply files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import java_pattern
from ..staging import staged

# fixed values: verbs, programs, and where words and sentences begin and end
VERBS = r"(?i)\b(?:run|runs|running|execute|executes|executing|exec|invoke|invokes|invoking|launch|launches|launching)\b"
PROGRAM = r"(?i)(?:^|[\s;&|(`])(?:\.|source|exec|sudo|env|nohup|bash|sh|zsh|dash|ksh|fish|python[\d.]*|node|deno|bun|bunx|npx|tsx|ts-node|uv|uvx|ruby|perl|php|pwsh|powershell|osascript)(?:\s+-[\w=.-]+)*+\s+[\"'`]?$"
LINE_START = r"^\s*(?:[$>]\s+)?(?:\w+=\S*\s+)*+[\"']?$"
BEHIND_SEPARATOR = r"(?:&&|\|\||[;|&(`])\s*(?:\w+=\S*\s+)*+[\"']?$"
FENCE_START = r"[^\S\n]*(?:```|~~~)"
SENTENCE_END = r"[.!?](?=\s|$)"
SHELL_WORD = r"[^\s;&|(`]*$"
CONTEXT_CHARS = 200
#: What no file name that is met by equality holds: words begin behind or end before these.
EDGES = r"[\s\"'`(=<\[);&|,:>\]]"
#: Names of a target that one row holds. A target of more files meets its manifest once for each such row.
NAMES_AT_ONCE = 1000
#: As many names are searched for one by one.
FEW = 16


def _names(path: Column) -> Column:
    """A path, and its ends that still have a folder."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda n: F.array_join(F.slice(parts, n + 1, F.size(parts)), "/"))


def _commanded(before: Column, at: Column, fenced: Column) -> Column:
    """Whether what stands before a word of a line, ``at`` characters long in all, makes it a command."""
    sentence = F.element_at(F.split(before, java_pattern(SENTENCE_END)), -1)
    command = F.regexp_replace(before, java_pattern(SHELL_WORD), "")
    starts = ((at <= CONTEXT_CHARS) & F.regexp_like(command, F.lit(java_pattern(LINE_START)))) | F.regexp_like(command, F.lit(java_pattern(BEHIND_SEPARATOR)))
    return F.regexp_like(sentence, F.lit(java_pattern(VERBS))) | F.regexp_like(command, F.lit(java_pattern(PROGRAM))) | (fenced & starts)


def _ends(piece: Column, deep: Column) -> Column:
    """A piece without a full stop behind it, and its ends behind a slash: those of ``deep`` parts at most."""
    parts = F.split(F.regexp_replace(piece, r"\.$", ""), "/")
    return F.transform(F.sequence(F.greatest(F.size(parts) - deep, F.lit(0)), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, n + 1, F.size(parts)), "/"))


def _words_of(text: Column, deep: Column) -> Column:
    """The different words of a text, with the ends of those that hold a slash."""
    words = F.array_distinct(F.split(F.regexp_replace(text, rf"\.(?=[\x{{85}}\x{{2028}}\x{{2029}}]?(?:{EDGES}|\z))", ""), EDGES))
    return F.concat(words, F.flatten(F.transform(F.filter(words, lambda x: F.contains(x, F.lit("/"))), lambda x: _ends(x, deep))))


def _held(names: Column, text: Column, deep: Column) -> Column:
    """Those of ``names`` that may be words of the text: a few are searched for, many meet all its words at once."""
    return F.when(F.size(names) <= FEW, F.filter(names, lambda n: F.contains(text, n))).otherwise(F.array_intersect(_words_of(text, deep), names))


def file_names(own: DataFrame) -> DataFrame:
    """(target_id, names, odd, deep): the names of the files of a target, at most ``NAMES_AT_ONCE`` in a row; ``odd`` are those
    that are looked up in texts, with their paths, and ``deep`` is the most parts that a name has."""
    rows = own.select("target_id", "path", F.explode(_names(F.col("path"))).alias("name")).filter("name <> ''")
    nr = F.row_number().over(Window.partitionBy("target_id").orderBy("name")) - 1
    odd = F.when(F.regexp_like("path", F.lit(EDGES)), F.struct("path", "name"))
    return rows.withColumn("part", F.floor(nr / NAMES_AT_ONCE)).groupBy("target_id", "part").agg(F.collect_set("name").alias("names"), F.collect_list(odd).alias("odd"), F.max(F.size(F.split("name", "/"))).alias("deep")).drop("part")


def naming_lines(manifests: DataFrame, names: DataFrame) -> DataFrame:
    """(target_id, line, fenced, words, odd, deep): the lines of ``manifests`` (target_id, content) that may hold a name, with the names
    that they may hold. The lines of fences themselves aren't inside.

    All of it is one narrow stage behind the join, and texts without a name are left before they are cut into lines.
    """
    rows = manifests.filter("content IS NOT NULL").join(names, "target_id")
    texts = F.transform(F.array(F.struct("content", "names", "odd", "deep")), lambda t: F.struct(t["content"].alias("content"), _held(t["names"], t["content"], t["deep"]).alias("words"), F.filter(t["odd"], lambda o: F.contains(t["content"], o["name"])).alias("odd"), t["deep"].alias("deep")))
    texts = F.filter(texts, lambda t: (F.size(t["words"]) > 0) | (F.size(t["odd"]) > 0))

    def lines(t: Column) -> Column:
        # every second part begins with the mark that opens a fence; the first part has a line break of its own
        parts = F.split(F.concat(F.lit("\n"), t["content"]), rf"(?<=\n)(?={java_pattern(FENCE_START)})")
        cut = F.flatten(F.transform(parts, lambda x, i: F.transform(F.split(x, "\n"), lambda line, nr: F.struct(line.alias("line"), ((nr > 0) & (i % 2 == 1)).alias("fenced")))))
        held = lambda x: F.struct(x["line"].alias("line"), x["fenced"].alias("fenced"), _held(t["words"], x["line"], t["deep"]).alias("words"), F.filter(t["odd"], lambda o: F.contains(x["line"], o["name"])).alias("odd"), t["deep"].alias("deep"))
        return F.filter(F.transform(cut, held), lambda x: (F.size(x["words"]) > 0) | (F.size(x["odd"]) > 0))

    return rows.select("target_id", F.explode(F.flatten(F.transform(texts, lines))).alias("x")).select("target_id", "x.*")


def _preceded(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``context``: the end of what the units before one are together, one character longer than what counts.

    A unit holds a character at least. Ends are joined with those twice as far before them each time, so none is made of more than two.
    """
    w, reach = Window.partitionBy(*key).orderBy("place"), 1
    rows = rows.withColumn("context", F.right("unit", F.lit(CONTEXT_CHARS + 1)))
    while reach <= CONTEXT_CHARS:
        rows = rows.withColumn("context", F.right(F.concat(F.lag("context", reach, "").over(w), "context"), F.lit(CONTEXT_CHARS + 1)))
        reach *= 2
    return rows.withColumn("context", F.lag("context", 1, "").over(w))


def _is_command(own: Column) -> Column:
    """Whether what stands before ``own`` and ``own`` itself, up to the word, make the word a command."""
    before = F.right(F.concat("context", own), F.lit(CONTEXT_CHARS + 1))
    return _commanded(F.right(before, F.lit(CONTEXT_CHARS)), F.length(before), F.col("fenced"))


def command_words(lines: DataFrame) -> DataFrame:
    """(target_id, word): words of ``lines`` that the agent shall run, among them all that are names."""
    cut = F.filter(F.split("line", rf"(?<={EDGES})|(?={EDGES})"), lambda x: x != "")
    few = F.when(F.size("words") <= FEW, F.col("words"))  # other words meet no file in the end, so many names need not be carried along
    rows = lines.filter(F.size("words") > 0).select("id", "target_id", "fenced", "deep", few.alias("few"), F.posexplode(cut).alias("place", "unit"))
    rows = _preceded(rows, ["id"]).withColumn("whole", F.length(F.regexp_replace("unit", r"\.$", "")))
    ends = F.filter(_ends(F.col("unit"), F.col("deep")), lambda w: (w != "") & F.coalesce(F.array_contains("few", w), F.lit(True)))
    rows = rows.filter(~F.regexp_like("unit", F.lit(f"^{EDGES}$"))).select("target_id", "fenced", "context", "unit", "whole", F.explode(ends).alias("word"))
    return rows.filter(_is_command(F.left("unit", F.col("whole") - F.length("word")))).select("target_id", "word").distinct()


def _looked_up(lines: DataFrame) -> DataFrame:
    """(target_id, path) of the ``odd`` files of ``lines``, whose names hold an edge."""
    rows = lines.select("id", "target_id", "line", "fenced", F.explode("odd").alias("o")).select("id", "target_id", "line", "fenced", "o.*")
    cut = F.expr("split(line, concat('\\\\Q', replace(name, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E'))")
    key = ["id", "path", "name"]
    rows = rows.select(*key, "target_id", "fenced", F.posexplode(cut).alias("place", "piece"))
    rows = _preceded(rows.withColumn("unit", F.concat("piece", "name")), key)
    rows = rows.withColumn("after", F.left(F.lead("piece").over(Window.partitionBy(*key).orderBy("place")), F.lit(3))).filter("after IS NOT NULL")
    whole = F.regexp_like(F.right(F.concat("context", "piece"), F.lit(CONTEXT_CHARS)), F.lit(r"(?:^|[\s\"'`(=/<\[])$")) & F.regexp_like("after", F.lit(r"^(?:$|[\s\"'`);&|,:>\]]|\.(?:\s|$))"))
    return rows.filter(whole & _is_command(F.col("piece"))).select("target_id", "path").distinct()


def run_targets(files: DataFrame, manifests: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """(target_id, path) of ``files`` (target_id, path) that the agent runs.

    ``manifests`` has target_id and content, one a target; ``commands`` target_id and command: what settings run.
    """
    own = files.select("target_id", "path").distinct()
    lines = staged(naming_lines(manifests, file_names(own)), "naming-lines").withColumn("id", F.monotonically_increasing_id())
    words = command_words(lines)
    looked = _looked_up(lines)
    if commands is not None:
        # a word that a command names counts wherever it stands
        cut = commands.filter("command IS NOT NULL").select("target_id", F.explode(F.split("command", EDGES)).alias("piece"))
        parts = F.split(F.regexp_replace("piece", r"\.$", ""), "/")
        ends = cut.select("target_id", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, n + 1, F.size(parts)), "/"))).alias("word"))
        words = words.unionByName(ends.filter("word <> ''")).distinct()
    named = own.select("target_id", "path", F.explode(_names(F.col("path"))).alias("word")).join(words, ["target_id", "word"], "left_semi").select("target_id", "path")
    return named.unionByName(looked).distinct()
