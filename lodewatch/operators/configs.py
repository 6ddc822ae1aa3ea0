"""Configuration files as tables of values, and what hangs on them: commands, hook scripts, servers of their own.

Each file is read by one task in one pass; all else is joins and aggregates over the values. Files are (target_id, path,
content). Null content and what an agent would not load is one row of kind "invalid"; repeated files are read one by one,
but count once where files are joined; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.commands import COMMAND_KEYS, CONFIG_NAMES, command_view, named_files
from ..functions.configs import split_members, values_of
from ..plans.catalog import RULES, Rule
from .inventory import basename
from .matching import match_all
from .passes import interpreter_of, language_of, shebang_name

VALUES = "target_id string, path string, dialect string, nr int, keys array<string>, name string, kind string, value string, key_start int, start int, end int"
BATCH = 20_000
# fixed values: the name under which commands are matched, the key of servers, and extensions of scripts
COMMANDS_NAME, SERVERS, SERVER_NAME = "agent-config-commands.sh", "mcpServers", ".mcp.json"
SCRIPT_EXTENSIONS = (".sh", ".bash", ".zsh", ".ps1", ".py", ".rb", ".php", ".js", ".mjs", ".cjs", ".ts", ".jsx", ".tsx")
JSON5_NAMES = ("opencode.json", "opencode.jsonc", "openclaw.json")


def dialect(path: Column) -> Column:
    """How the agent that owns a file reads it; null for files that are no configuration."""
    name, folder = basename(path), F.element_at(F.split(F.concat(F.lit("/"), path), "/"), -2)
    return (
        F.when(name.endswith(".toml"), "toml").when(name.isin(*JSON5_NAMES) | name.endswith(".json5"), "json5")
        .when((folder == ".gemini") & (name == "settings.json"), "commented")
        .when((folder == ".vscode") | name.endswith(".jsonc"), "jsonc").when(name.endswith(".json"), "json")
    )


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in VALUES.split(", ")]
    for batch in batches:
        for target, path, text, kind in batch.itertuples(index=False):
            found = values_of(text, kind)
            rows = [(target, path, kind, 0, None, None, "invalid", None, None, None, None)] if found is None else [(target, path, kind, i, list(v.keys), *v[1:]) for i, v in enumerate(found)]
            for at in range(0, len(rows), BATCH):
                frame = pd.DataFrame(rows[at : at + BATCH], columns=columns)
                for c in ("key_start", "start", "end"):
                    frame[c] = frame[c].astype("Int32")
                yield frame


def config_values(files: DataFrame) -> DataFrame:
    """(target_id, path, dialect, nr, keys, name, kind, value, key_start, start, end): the values of configuration ``files``.

    ``keys`` are the keys above and indexes, ``name`` the nearest key, ``kind`` string, scalar, object, array, table or
    invalid; places count code points from 0 and ``key_start`` is where the value's key begins.
    """
    rows = files.select("target_id", "path", "content", dialect(F.col("path")).alias("dialect")).filter("dialect IS NOT NULL")
    return rows.mapInPandas(_read, VALUES)


def command_values(values: DataFrame) -> DataFrame:
    """The ``values`` that agents run or send data to."""
    return values.filter((F.col("kind") == "string") & F.col("name").isin(*COMMAND_KEYS))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.ArrayType(T.IntegerType()))]))
def _views(content: pd.Series, path: pd.Series, in_one_line: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([command_view(*x) for x in zip(content, path, in_one_line)], columns=["text", "lines"])


def command_texts(files: DataFrame) -> DataFrame:
    """(target_id, path, layout, text, lines): the commands of settings ``files`` as shell lines (0) and in one line (1).

    ``lines`` holds for each line of ``text`` the line of the file that it is from.
    """
    rows = files.filter(basename(F.col("path")).isin(*CONFIG_NAMES) & F.col("content").isNotNull())
    rows = rows.select("target_id", "path", "content", F.explode(F.array(F.lit(0), F.lit(1))).alias("layout"))
    return rows.select("target_id", "path", "layout", _views("content", "path", F.col("layout") == 1).alias("v")).select("target_id", "path", "layout", "v.*")


def match_commands(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What ``match_all`` finds in the commands of settings as in a shell script, at the files' own lines; ``layout`` says in which text.

    The column is that of the text. One finding of both layouts: ``first_of_layouts``.
    """
    texts = command_texts(files)
    key = F.struct("target_id", "path", "layout").alias("target_id")
    found = match_all(texts.select(key, F.lit(COMMANDS_NAME).alias("path"), F.col("text").alias("content")), rules).drop("path")
    found = found.select("target_id.*", *[c for c in found.columns if c != "target_id"])
    # a line of the text is one of the file: an equi-join of findings with places
    places = texts.select("target_id", "path", "layout", F.posexplode("lines").alias("at", "own")).select("target_id", "path", "layout", (F.col("at") + 1).alias("line"), "own").distinct()
    return found.join(places, ["target_id", "path", "layout", "line"]).drop("line").withColumnRenamed("own", "line")


def first_of_layouts(matches: DataFrame) -> DataFrame:
    """One finding a file, rule and line: of the first layout, its first pattern, at its first place."""
    first = F.min_by(F.struct("layout", "severity", "message", "column", "snippet"), F.struct("layout", "pattern_idx", "column"))
    return matches.groupBy("target_id", "path", "rule_id", "line").agg(first.alias("x")).select("target_id", "path", "rule_id", "line", "x.*")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("program", T.StringType())])))
def _named(command: pd.Series, placeholder: pd.Series, working_dir: pd.Series) -> pd.Series:
    return pd.Series([[{"path": p, "program": w} for p, w in named_files(*x)] for x in zip(command, placeholder, working_dir)], dtype=object)


def hook_scripts(files: DataFrame, placeholder: str = "CLAUDE_PROJECT_DIR", working_dir: bool = True) -> DataFrame:
    """(target_id, path, scan_names): the ``files`` that commands of settings of the same target run, and the names that select their rules.

    Paths are relative to the target's root, which commands call ``placeholder``; with ``working_dir`` bare paths start there,
    too. Words that name no listed file, or lead out of the root, run nothing here. Names are sorted; a file that several
    programs run has a name for each of their languages.
    """
    settings = basename(F.col("path")).isin(*CONFIG_NAMES)
    # in hooks no dialect has comments
    commands = command_values(config_values(files.filter(settings)).filter("dialect = 'json'"))
    words = commands.select("target_id", F.explode(_named("value", F.lit(placeholder), F.lit(working_dir))).alias("w")).select("target_id", "w.*").distinct()
    listed = files.filter(~settings).select("target_id", "path", "content").dropDuplicates(["target_id", "path"])
    heads = listed.select("target_id", "path", interpreter_of(F.col("content")).alias("own"), shebang_name(F.col("path"), F.col("content")).alias("own_name"), F.substring(F.coalesce("content", F.lit("")), 1, 256).alias("head"))
    rows = heads.join(words, ["target_id", "path"])
    name = basename(F.col("path"))
    bare = F.contains(F.col("head"), F.lit("\u0000")) | F.regexp_extract(name, r"(\.[^.]*)\z", 1).isin(*SCRIPT_EXTENSIONS)
    direct = F.when(F.col("head").startswith("#!"), F.col("own")).when(~bare, "sh")
    extension = language_of(F.coalesce("program", direct))
    as_run = F.when(extension.isNotNull() & ~name.endswith(extension), F.concat(name, extension)).otherwise(name)
    unknown = F.col("program").isNotNull() & language_of(F.col("program")).isNull()
    names = F.when(unknown, F.array_compact(F.array(name, F.col("own_name")))).otherwise(F.array(as_run))
    return rows.select("target_id", "path", F.explode(names).alias("scan_name")).groupBy("target_id", "path").agg(F.sort_array(F.collect_set("scan_name")).alias("scan_names"))


def with_hook_names(files: DataFrame, scripts: DataFrame) -> DataFrame:
    """``files`` with ``scan_names`` where a hook runs them, as ``passes`` takes them."""
    return files.join(scripts, ["target_id", "path"], "left")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("server", T.StringType()), T.StructField("first_line", T.IntegerType()), T.StructField("rule_scan_content", T.StringType())])))
def _parts(content: pd.Series) -> pd.Series:
    def of(text: str | None) -> list[dict]:
        members, rest = split_members(text, SERVERS) or ([], text)
        servers = [{"server": name, "first_line": line, "rule_scan_content": f'{{ "{SERVERS}": {{ {own} }} }}'} for name, line, own in members]
        return [*servers, {"server": None, "first_line": 1, "rule_scan_content": rest}]

    return pd.Series([of(x) for x in content], dtype=object)


def split_servers(files: DataFrame) -> DataFrame:
    """(target_id, path, server, first_line, rule_scan_content): settings in parts, each matched by itself.

    Each server is a document of one server, whose first line is line ``first_line`` of the file. ``server`` is null for what
    is left of the file, in which the servers are blank. A file that isn't strict JSON, has no map of servers, or gives the
    map or a server twice stays whole, as one part. The parts together are no longer than the file and one line a server.
    """
    return files.select("target_id", "path", F.explode(_parts("content")).alias("part")).select("target_id", "path", "part.*")


def match_parts(parts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What ``match_all`` finds in each part, with ``server``, at the lines of the file. A server has the rules of its own kind of file."""
    key = F.struct("target_id", "path", "server", "first_line").alias("target_id")
    scan_path = F.when(F.col("server").isNull(), F.col("path")).otherwise(SERVER_NAME)
    found = match_all(parts.select(key, scan_path.alias("path"), F.col("rule_scan_content").alias("content")), rules).drop("path")
    own = [c for c in found.columns if c not in ("target_id", "line")]
    return found.select("target_id.target_id", "target_id.path", "target_id.server", (F.col("line") + F.col("target_id.first_line") - 1).alias("line"), *own)
