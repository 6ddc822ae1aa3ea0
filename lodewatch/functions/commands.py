"""Commands in settings: the text that a shell reads, and the words that name what it runs."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

from .configs import Value, values_of
from .settings import padded, spaces

# fixed values: settings that hold commands, keys of commands, words of a shell, options with a value in the next word
CONFIG_NAMES = ("settings.json", "settings.local.json", "hooks.json", ".mcp.json")
COMMAND_KEYS = ("command", "args", "bash", "powershell", "exec", "url", "apiKeyHelper", "awsAuthRefresh", "awsCredentialExport", "gcpAuthRefresh", "otelHeadersHelper")
TOKEN = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^\s;|&()<>`\"'])++|[;|&()`\n]")
SEPARATORS = (";", "|", "&", "(", ")", "`", "\n")
SHELLS = ("sh", "bash", "dash", "zsh", "ksh")
SOURCING = (".", "source")
VALUE_LETTERS = {**dict.fromkeys(SHELLS, "oO"), "python": "WX", "node": "rC", "ruby": "IrCE", "perl": "I", "deno": "cL", "bun": "rcdl"}
VALUE_OPTIONS = {
    **dict.fromkeys(SHELLS, ("--rcfile", "--init-file")),
    "python": ("--check-hash-based-pycs",),
    "node": ("--require", "--import", "--loader", "--experimental-loader", "--conditions", "--input-type", "--env-file", "--title"),
    "ruby": ("--encoding", "--external-encoding", "--internal-encoding", "--enable", "--disable"),
    "deno": ("--config", "--import-map", "--cert", "--location", "--seed", "--ext", "--log-level"),
    "bun": ("--preload", "--require", "--import", "--cwd", "--env-file", "--config", "--tsconfig-override", "--define", "--loader", "--conditions"),
}
LOADING = {"node": ("-r", "--require", "--import", "--loader", "--experimental-loader"), "ruby": ("-r",), "bun": ("-r", "--preload", "--require", "--import")}
SUBCOMMANDS = {"deno": ("run",), "bun": ("run",)}


def is_command(value: Value) -> bool:
    return value.kind == "string" and value.name in COMMAND_KEYS


def dialect_of(path: str) -> str:
    """The dialect in which an agent reads its settings."""
    return "commented" if path.split("/")[-2:] == [".gemini", "settings.json"] else "json"


def shell_lines(command: str) -> str:
    """The lines that a shell reads: joined where they are continued, and ended behind a last comment."""
    *lines, last = re.split(r"\r\n?|\n", command)
    joined = "".join(x[:-1] + "  " if x.endswith("\\") and not x.lstrip(" \t").startswith("#") else x + "\n" for x in lines) + last
    return joined + "\n" if joined.rpartition("\n")[2].lstrip(" \t").startswith("#") else joined


#: What ends the state of a shell's text: outside of quotes a quote or a comment, in quotes their end.
_ENDS = {"": re.compile(r"\\[\s\S]|['\"]|(?:(?<=[\s;&|()<>])|\A)#"), '"': re.compile(r"\\[\s\S]|\""), "'": re.compile("'")}


def one_line(command: str) -> str:
    """The command in one line, without lines that hold only a comment; a ``#`` in an open string is text."""
    out, state = [], ""
    for line in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", command):
        if not state and re.match(r"[ \t]*#", line):
            out.append(" " * len(line))
            continue
        at = 0
        while m := _ENDS[state].search(line, at):
            at = m.end()
            if m[0] == "#":
                break
            if m[0] in ("'", '"'):
                state = "" if state else m[0]
        out.append(re.sub(r"[\r\n]", " ", line))
    return "".join(out)


def command_view(text: str, path: str, in_one_line: bool) -> tuple[str, list[int]]:
    """Only the commands of settings, decoded where they stand, and for each line of that the line of the file it is from.

    A string that equals a command stays wherever it stands. Text that an agent would not load has no commands.
    """
    found = values_of(text, dialect_of(path))
    if found is None:
        return "", [1]
    kept = {v.value for v in found if is_command(v)}
    out, lines, at, own = [], [1], 0, 1
    for v in [*(v for v in found if v.kind == "string" and v.value in kept), None]:
        gap = spaces(text[at : v.start if v else len(text)])
        lines += range(own + 1, own + 1 + gap.count("\n"))
        own += gap.count("\n")
        out.append(gap)
        if v:
            shown = (one_line if in_one_line else shell_lines)(v.value)
            out.append(padded(shown, text[v.start : v.end]))
            lines += [own] * shown.count("\n")
            at = v.end
    return "".join(out), lines


def program_name(word: str | None) -> str:
    return re.sub(r"\d[\d.]*\Z", "", word.rpartition("/")[2]) if word else ""


def option_values(program: str | None, word: str) -> list[str]:
    """What each next word that is a value of the option ``word`` is run by: the program if it loads it, else the option."""
    name = program_name(program)
    by = lambda option: program if option in LOADING.get(name, ()) else word
    if word.startswith("--"):
        return [by(word)] if word in VALUE_OPTIONS.get(name, ()) else []
    if not word.startswith("-") and not (name in SHELLS and word.startswith("+")):
        return []
    at = [i for i, c in enumerate(word) if i and c in VALUE_LETTERS.get(name, "")]
    if name in SHELLS:
        return [word] * len(at)
    return [by("-" + word[-1])] if at and at[0] == len(word) - 1 else []


def run_words(command: str) -> Iterator[tuple[str, str | None]]:
    """The words of a command, each with the program that runs it: the last word before it that no option, value or subcommand is."""
    segment: list[str] = []
    for token in [*TOKEN.findall(command), ";"]:
        if token not in SEPARATORS:
            segment.append(re.sub("[\"']", "", token))
            continue
        program, values = None, []
        for word in segment:
            if values:
                yield word, values.pop(0)
                continue
            yield word, program
            values = option_values(program, word)
            name = program_name(program)
            if name in SHELLS and re.match("-[A-Za-z]*c", word):
                program = None
            elif program is None and word in SOURCING:
                program = "sh"
            elif not (word.startswith("-") or (name in SHELLS and word.startswith("+")) or word in SUBCOMMANDS.get(name, ())):
                program = word
        segment = []


def named_files(command: str, placeholder: str, working_dir: bool) -> list[tuple[str, str | None]]:
    """(path, program) of the words of a command that may be files below the root, whose name in commands is ``placeholder``."""
    found = {}
    for word, program in run_words(command):
        own = re.sub(rf"\A\$\{{?{placeholder}\}}?(?=[\\/])", ".", word)
        path = posixpath.normpath(own) if own and "\x00" not in own else "."
        if (own != word or working_dir) and path != "." and not path.startswith(("/", "../")) and path != "..":
            found[path, program] = None
    return list(found)
