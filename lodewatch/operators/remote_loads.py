"""Code that loads code from the network: loader calls whose address comes through names, or whose file the code downloads.

Each file is one text in which comments are blank and strings are moved to private characters, so patterns tell code from
strings. It is cut into facts, one row each: assignments, loader calls, brackets, downloads, writes, network calls. Then

- an as-of window over the facts of one name finds the assignment that a use reads: the last one before it, and for a
  loader, which may stand in a function, else the first one after it;
- an assignment whose value begins with a name points to the assignment that this name reads. Pointers are doubled, a join a
  round, until each is at an address or at something else, so a chain of a hundred thousand names takes 17 rounds;
- running counts of brackets pair each opening with its closing one, and so tell which commands stand inside a call that
  runs commands;
- a loader that names a downloaded file meets it by an equi-join on file and stem.

Cost is in proportion to the text, and rows are dealt by file and name. Defined cases: null content has no facts; other
files than Python and JavaScript are left out; repeated files are matched together, and a finding stands once; extra columns
are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import SPACE_CHARS, java_pattern
from ..functions.views import QUOTED, tagged_code
from ..staging import staged
from .matching import MARK

RULE_ID, SEVERITY = "DEPS-REMOTE-IMPORT", "critical"
# fixed values: the message, and the calls that load, download, write and run
MESSAGE = "Remote URL import detected — code fetched from the network with no integrity check."
EXTENSIONS = ("js", "ts", "mjs", "cjs", "jsx", "tsx", "py")
HINTS = ("http://", "https://", "curl", "wget", "urlretrieve", "writeFile", "appendFile", "createWriteStream", "httpimport")
OPENS = r"\bopen\s*\("
JS_WRITES = "writeFileSync|writeFile|appendFileSync|appendFile|createWriteStream"
JS_NETWORK = r"(?<![\w$])(?:fetch|got|axios(?:\.\w+)?)\s*\(|\bhttps?\.(?:get|request)\s*\("
PY_NETWORK = r"\b(?:urlopen|urlretrieve)\s*\(|\b(?:requests|httpx)\.\w+\s*\("
COMMANDS = "exec|execSync|execFile|execFileSync|spawn|spawnSync|execa|execaSync|system|popen|run|call|Popen|check_call|check_output|getoutput|getstatusoutput"
ASSIGNING_WORDS = "const|let|var|return|else|throw|yield|await|case|do"
CODE_FILE = r"\.(?:[mc]?js|[mc]?ts|jsx|tsx|py)$"

_PLAIN = "".join(map(chr, range(128)))
_MOVED = "".join(chr(QUOTED + c) for c in range(128))
_INSIDE = f"[^'\"`\n\\x{{{QUOTED + 10:X}}}]"


def _in_string(text: str) -> str:
    """A pattern for these plain characters inside a string."""
    return "".join(rf"\x{{{QUOTED + ord(c):X}}}" for c in text)


def _any_in_string(chars: str) -> str:
    return "[" + "".join(rf"\x{{{QUOTED + ord(c):X}}}" for c in chars) + "]"


_BLANKS = _any_in_string(" \t") + "*"
_ADDRESS = rf"[\"'`]{_in_string('http')}{_in_string('s')}?{_in_string('://')}"
_PREFIX = "[rRbBuUfF]{0,2}"
_FETCHES = rf"{_BLANKS}(?:{_in_string('sudo')}{_any_in_string(' ' + chr(9))}+)?(?:{_in_string('curl')}|{_in_string('wget')})(?!{_any_in_string('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_')})"
_DOWNLOAD = rf"{_PREFIX}[\"'`]{_FETCHES}|(?:{_in_string('&&')}|{_in_string('|')}{{1,2}}|{_in_string(';')}|{_in_string('$(')}){_FETCHES}"
_PY_FIRST = r"[^,()\n" + "".join(rf"\x{{{QUOTED + ord(c):X}}}" for c in ",()") + r"]*,\s*"
_NAME = r"[A-Za-z_$][\w$]*+"

#: Facts by kind, for each language; where two fit, the first.
JS_FACTS = {
    "static": rf"\bfrom(?=\s*{_ADDRESS})|(?<![.$])\bimport(?=\s*{_ADDRESS})",
    "load": r"(?<![\w$.])(?:import|require)\s*\(",
    "write": rf"(?<![\w$])(?:{JS_WRITES})\s*\(",
    "network": JS_NETWORK,
    "command": rf"(?<![\w$])(?:{COMMANDS})\s*\(",
    "assign": rf"(?<![\w$.]){_NAME}\s*(?::\s*[\w$]+\s*)?=(?![=>])\s*",
    "download": _DOWNLOAD,
    "open": r"[(\[{]",
    "close": r"[)\]}]",
}
PY_FACTS = {
    "static": rf"\bimportlib\.import_module\s*\((?=\s*{_PREFIX}{_ADDRESS})|(?<![\w.])(?:import[ \t][\w., \t]{{0,200}}?|from[ \t]+)\bhttpimport\b",
    "import": r"(?<![\w.])(?:from[ \t]+[\w.]+[ \t]+import\b|import[ \t][\w., \t]+)",
    "module": r"\b(?:import_module|__import__)\s*\(",
    "path": rf"\brun_path\s*\(|\b(?:spec_from_file_location|SourceFileLoader)\s*\((?={_PY_FIRST})",
    "retrieve": r"\burlretrieve\s*\(",
    "file": r"(?<![\w.])open\s*\(",
    "network": PY_NETWORK,
    "command": rf"(?<![\w$])(?:{COMMANDS})\s*\(",
    "download": _DOWNLOAD,
    "open": r"[(\[{]",
    "close": r"[)\]}]",
}


#: Where a fact may begin: a word, or a character of strings and brackets. Most places are neither, and there no fact is tried.
MAY_BEGIN = rf"(?:(?<![A-Za-z0-9_])(?=[A-Za-z_$])|(?=[rRbBuUfF\"'`()\[\]{{}}{_any_in_string('&|;$')[1:-1]}]))"


def _hinted(text: Column) -> Column:
    """Whether the text may download or load from the network; words are searched for, which takes less time than a pattern."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in HINTS]) | (F.contains(text, F.lit("open")) & F.regexp_like(text, F.lit(OPENS)))


def _plain(text: Column) -> Column:
    return F.translate(text, _MOVED, _PLAIN)


def _stem(path: Column) -> Column:
    """``./lib/format.js`` and ``lib/format`` both load ``format``."""
    return F.regexp_replace(F.regexp_extract(path, r"([^\\/]*)$", 1), CODE_FILE, "")


def _code_stem(path: Column) -> Column:
    return F.when(F.regexp_like(path, F.lit(CODE_FILE)), _stem(path))


def _after(piece: Column, head: str) -> Column:
    """The plain text of the string that follows ``head`` in a piece; empty if there is none."""
    return _plain(F.regexp_extract(piece, java_pattern(rf"^(?:{head})\s*{_PREFIX}(['\"`])({_INSIDE}+)\1"), 2))


FILE = ["target_id", "path"]


def facts(files: DataFrame) -> DataFrame:
    """(target_id, path, python, seq, kind, piece, last, next, line, column): what stands in each file, in order.

    A piece goes from a fact to the next one; ``last`` is the word or mark that stands before it, ``next`` the piece behind it.
    """
    rows = files.select("target_id", "path", "content").filter(F.regexp_extract("path", r"\.(\w+)$", 1).isin(*EXTENSIONS) & _hinted(F.col("content")))
    # dealt by file, so that repeated files meet without another move of the texts
    rows = rows.repartition(*FILE).distinct()
    rows = rows.select("target_id", "path", F.col("path").endswith(".py").alias("python"), tagged_code(F.col("content"), F.col("path")).alias("text"))
    every = {True: PY_FACTS, False: JS_FACTS}
    cut = lambda python: F.split(F.regexp_replace("text", f"{MAY_BEGIN}(?:{java_pattern('|'.join(f'(?:{p})' for p in every[python].values()))})", F.lit(MARK + "$0")), MARK)
    rows = rows.select("target_id", "path", "python", F.posexplode(F.when(F.col("python"), cut(True)).otherwise(cut(False))).alias("seq", "piece"))
    of_file = Window.partitionBy("target_id", "path").orderBy("seq")
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    size, tail = F.length("piece"), F.length(F.substring_index("piece", "\n", -1))
    rows = rows.withColumns({"start": F.coalesce(F.sum(size).over(earlier), F.lit(0)), "last": F.lag(F.regexp_extract("piece", r"(\w+|\S)\s*$", 1)).over(of_file), "next": F.coalesce(F.lead("piece").over(of_file), F.lit(""))})
    rows = rows.withColumn("line", 1 + F.coalesce(F.sum(size - F.length(F.replace("piece", F.lit("\n"), F.lit("")))).over(earlier), F.lit(0)))
    ends = F.when(F.contains("piece", F.lit("\n")), F.col("start") + size - tail)  # where the last line of the piece begins
    rows = rows.withColumn("column", 1 + F.col("start") - F.coalesce(F.max(ends).over(earlier), F.lit(0)))

    def kind(python: bool) -> Column:
        out = F.lit(None).cast("string")
        for name, p in reversed(every[python].items()):
            # what a look-behind asks for stood before the piece, which begins with a match of one kind
            out = F.when(F.regexp_like("piece", F.lit(java_pattern("^(?:" + _without_lookbehind(p) + ")"))), F.lit(name)).otherwise(out)
        return out

    rows = rows.filter("seq > 0").withColumn("kind", F.when(F.col("python"), kind(True)).otherwise(kind(False)))
    return rows.select("target_id", "path", "python", "seq", "kind", "piece", "last", "next", F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column"))


def _without_lookbehind(pattern: str) -> str:
    for look in (r"(?<![\w$.])", r"(?<![\w$])", r"(?<![\w.])", r"(?<![.$])"):
        pattern = pattern.replace(look, "")
    return pattern


def downloads(found: DataFrame) -> DataFrame:
    """(target_id, path, stem): the code files that a file's own code downloads or writes from the network."""
    of_file = Window.partitionBy(*FILE)
    opened = found.kind.isin("open", "load", "write", "network", "command", "module", "path", "retrieve", "file") | ((found.kind == "static") & found.piece.contains("("))
    rows = found.withColumn("step", F.when(opened, 1).when(F.col("kind") == "close", -1).otherwise(0))
    rows = rows.withColumn("depth", F.sum("step").over(of_file.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("step") < 0, 1).otherwise(0))
    # at one depth brackets open and close in turn, so the opening one before a closing one is its own
    turn = Window.partitionBy(*FILE, "depth").orderBy("seq")
    ended = F.last(F.when(F.col("step") > 0, F.col("kind") == "command"), True).over(turn)
    rows = rows.withColumn("runs", F.when((F.col("step") > 0) & (F.col("kind") == "command"), 1).when((F.col("step") < 0) & ended, -1).otherwise(0))
    inside = rows.withColumn("open_calls", F.sum("runs").over(of_file.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    stops = "".join(rf"\x{{{QUOTED + ord(c):X}}}" for c in ";)]")
    # a command goes on over the pieces that follow, in a list of arguments as in one string
    rest = F.array_join(F.collect_list("piece").over(of_file.orderBy("seq").rowsBetween(0, 8)), "")
    fetched = inside.withColumn("command_text", F.when(F.col("kind") == "download", F.regexp_extract(rest, rf"^(?:[;|&$(\x{{{QUOTED + ord(';'):X}}}]*)?([^\n;)\]{stops}]*)", 1)))
    tokens = fetched.filter("kind = 'download' AND open_calls > 0").select(*FILE, F.explode(F.split(_plain(F.col("command_text")), r"[\s'\"`,;=>|&]+")).alias("token"))
    by_command = tokens.select(*FILE, _code_stem(F.col("token")).alias("stem"))
    online = found.filter("kind IN ('network', 'retrieve')").select(*FILE).distinct()
    head = rf"(?:{JS_WRITES}|open)\s*\("
    writes = found.filter("kind IN ('write', 'file')").withColumn("named", _after(F.col("piece"), head))
    mode = rf"^{head}\s*{_PREFIX}['\"`]{_INSIDE}+['\"`]\s*,\s*[rRbBuU]{{0,2}}['\"]{_any_in_string('rwaxbt+U')}{{0,4}}?{_any_in_string('wax')}"
    writes = writes.filter((F.col("kind") == "write") | F.regexp_like("piece", F.lit(java_pattern(mode)))).join(online, FILE, "left_semi").select(*FILE, _code_stem(F.col("named")).alias("stem"))
    retrieved = found.filter("kind = 'retrieve'").select(*FILE, _code_stem(_after(F.col("piece"), rf"urlretrieve\s*\({_PY_FIRST}(?:filename\s*=\s*)?")).alias("stem"))
    return by_command.unionByName(writes).unionByName(retrieved).filter("stem <> ''").distinct()


def reaching(found: DataFrame) -> DataFrame:
    """(target_id, path, seq, kind, address, at): assignments and loader calls of JavaScript, whether their value is an
    address, and the place of the assignment that the name at its beginning reads."""
    assign = java_pattern(rf"^{_NAME}\s*(?::\s*[\w$]+\s*)?=(?![=>])\s*")
    call = java_pattern(r"^(?:import|require)\s*\(\s*")
    rows = found.filter("NOT python AND kind IN ('assign', 'load')")
    value = F.regexp_replace(F.concat("piece", "next"), f"(?:{assign}|{call})", "")
    last = F.col("last")
    sets = (last == "") | ~F.regexp_like(last, F.lit(r"^(?:[A-Za-z0-9_$]+|['\"`.])$")) | F.regexp_like(last, F.lit(f"^(?:{ASSIGNING_WORDS})$"))
    rows = rows.filter((F.col("kind") == "load") | sets)
    rows = rows.withColumns({
        "address": F.regexp_like(value, F.lit(java_pattern("^" + _ADDRESS))),
        "uses": F.regexp_extract(value, java_pattern(rf"^(?:`{_in_string('${')}\s*)?({_NAME})"), 1),
        "name": F.when(F.col("kind") == "assign", F.regexp_extract("piece", rf"^({_NAME})", 1)),
    }).select(*FILE, "seq", "kind", "address", "uses", "name")
    marks = rows.filter("kind = 'assign'").select(*FILE, "seq", F.col("name").alias("word"), F.col("seq").alias("set_at"), F.lit(None).cast("string").alias("kind"))
    uses = rows.filter("NOT address AND uses <> ''").select(*FILE, "seq", F.col("uses").alias("word"), F.lit(None).cast("int").alias("set_at"), "kind")
    of_name = Window.partitionBy(*FILE, "word")
    before = F.last("set_at", True).over(of_name.orderBy("seq", F.col("set_at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    read = marks.unionByName(uses).withColumns({"at": before, "first": F.min("set_at").over(of_name)})
    read = read.filter("kind IS NOT NULL").select(*FILE, "seq", F.coalesce("at", F.when(F.col("kind") == "load", F.col("first"))).alias("at"))
    return rows.select(*FILE, "seq", "kind", "address").join(read, [*FILE, "seq"], "left")


def followed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``address`` true also where the assignment that is read, or one that it reads in turn, is an address."""
    rows = staged(rows, "reaching")
    while not rows.filter("at IS NOT NULL AND NOT address").isEmpty():
        known = rows.select(*FILE, F.col("seq").alias("at"), F.col("address").alias("its"), F.col("at").alias("next"))
        # a pointer that has been followed to something else than an address ends there
        rows = rows.join(known, [*FILE, "at"], "left").select(*FILE, "seq", "kind", (F.col("address") | F.coalesce("its", F.lit(False))).alias("address"), F.when(~F.coalesce("its", F.lit(True)), F.col("next")).alias("at"))
        rows = staged(rows, "reaching")
    return rows


def remote_loads(files: DataFrame) -> DataFrame:
    """(target_id, path, rule_id, severity, message, pattern_idx, line, column, snippet): loads of remote code, as matches."""
    found = staged(facts(files), "facts")
    fetched = downloads(found)
    by_name = followed(reaching(found)).filter("kind = 'load' AND address").select(*FILE, "seq")
    modules = F.when(F.col("kind") == "import", F.split(F.regexp_replace(F.col("piece"), r"^(?:from[ \t]+([\w.]+)[ \t]+import\b[\s\S]*|import[ \t]([\w., \t]+)[\s\S]*)$", "$1$2"), ","))
    of_module = F.transform(modules, lambda m: F.regexp_extract(F.regexp_extract(F.btrim(m), r"^(\S*)", 1), r"([^.]*)$", 1))
    literal = F.array(F.when(F.col("kind") == "load", _stem(_after(F.col("piece"), r"(?:import|require)\s*\("))).when(F.col("kind") == "module", F.regexp_extract(_after(F.col("piece"), r"\w+\s*\("), r"([^.]*)$", 1)).otherwise(_stem(_after(F.col("piece"), rf"(?:run_path\s*\(|\w+\s*\({_PY_FIRST})"))))
    loads = found.filter("kind IN ('load', 'import', 'module', 'path')").select(*FILE, "seq", F.explode(F.coalesce(of_module, literal)).alias("stem"))
    by_file = loads.filter("stem <> ''").join(fetched, [*FILE, "stem"], "left_semi").select(*FILE, "seq")
    hits = by_name.unionByName(by_file).unionByName(found.filter("kind = 'static'").select(*FILE, "seq")).distinct()
    hits = staged(found.join(hits, [*FILE, "seq"], "left_semi").select(*FILE, "line", "column").distinct(), "loads")
    # few, so Spark broadcasts them if they are small and moves the texts if they aren't
    own = F.get(F.split("content", "\n"), F.col("line") - 1)
    rows = files.select(*FILE, "content").join(hits, FILE).withColumn("snippet", F.substring(F.btrim(own, F.lit(SPACE_CHARS)), 1, 120))
    fixed = {"rule_id": RULE_ID, "severity": SEVERITY, "message": MESSAGE, "pattern_idx": 0}
    return rows.select(*FILE, *[F.lit(v).alias(k) for k, v in fixed.items()], "line", "column", "snippet").distinct()
