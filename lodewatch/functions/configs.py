"""Readers of configuration files that keep places: each value with the keys above it and where it stands.

Four dialects of JSON and TOML are read in one pass over tokens, without recursion; what an agent would not load has no
values. Dialects: "json"; "commented" (comments); "jsonc" (comments and commas at the end); "json5"; "toml".

Defined cases: a key given twice gives both values; what is nested deeper than ``DEEPEST`` is refused, as is a value that isn't
alone in its text; halves of pairs become U+FFFD; places count code points.
"""

from __future__ import annotations

import json
import re
import tomllib
from typing import NamedTuple

DEEPEST = 200

_COMMENT = r"//[^\n\r]*|/\*[\s\S]*?\*/"
_DOUBLE = r"\"[^\"\\\x00-\x1f]*+(?:\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4})[^\"\\\x00-\x1f]*+)*+\""
_PAIR = r"\\(?:\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[^xu1-9])"
_EITHER = rf"\"[^\"\\\n\r]*+(?:{_PAIR}[^\"\\\n\r]*+)*+\"|'[^'\\\n\r]*+(?:{_PAIR}[^'\\\n\r]*+)*+'"
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_NUMBER5 = r"[+-]?(?:0[xX][0-9a-fA-F]++|Infinity|NaN|(?:(?:0|[1-9][0-9]*+)(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?)(?![\w$])"


def _tokens(skip: str, string: str, scalar: str, name: str = "") -> re.Pattern:
    return re.compile(rf"(?P<skip>{skip})|(?P<string>{string})|(?P<mark>[{{}}\[\]:,])|(?P<scalar>{scalar})" + (f"|(?P<name>{name})" if name else ""))


_PLAIN = rf"{_NUMBER}(?![\w.])|(?:true|false|null)(?!\w)"
TOKENS = {
    "json": _tokens(r"[ \t\n\r]++", _DOUBLE, _PLAIN),
    "commented": _tokens(rf"[ \t\n\r]++|{_COMMENT}", _DOUBLE, _PLAIN),
    "json5": _tokens(rf"[\s\ufeff]++|{_COMMENT}", _EITHER, rf"{_NUMBER5}|(?:true|false|null)(?![\w$])", r"[^\W\d][\w$]*+|\$[\w$]*+"),
}
TOKENS["jsonc"] = TOKENS["commented"]
TRAILING = ("jsonc", "json5")

_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
# fixed values: what follows a backslash and what it stands for
_SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0", "\n": "", "\r": "", "\r\n": "", "\u2028": "", "\u2029": ""}


class Value(NamedTuple):
    """``keys`` holds the keys above and indexes as numbers; ``name`` is the nearest key; ``value`` is null for containers."""

    keys: tuple[str, ...]
    name: str
    kind: str
    value: str | None
    key_start: int
    start: int
    end: int


def whole(text: str) -> str:
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def unescaped(token: str, dialect: str) -> str:
    if dialect != "json5":
        return whole(json.loads(token))
    return whole(_ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SHORT.get(m[3], m[3]), token[1:-1]))


class _Open:
    """A container that is being read, and the key or index that its next value has."""

    def __init__(self, kind: str, slot: int, name: str, key_start: int, start: int):
        self.kind, self.slot, self.name, self.key_start, self.start = kind, slot, name, key_start, start
        self.key, self.at = ("0" if kind == "array" else ""), None


def json_values(text: str, dialect: str) -> list[Value] | None:
    """The values of a document in the order of their beginnings, or None if it isn't one."""
    out: list[Value | None] = []
    above: list[_Open] = []
    at, wanted, trailing = 0, "value", dialect in TRAILING

    def place(start: int) -> tuple[tuple[str, ...], str, int]:
        if not above:
            return (), "", start
        top = above[-1]
        return tuple(o.key for o in above), top.name if top.kind == "array" else top.key, start if top.at is None else top.at

    for m in TOKENS[dialect].finditer(text):
        if m.start() != at:
            return None
        at, kind, token = m.end(), m.lastgroup, m[0]
        if kind == "skip":
            continue
        top = above[-1] if above else None
        if token == ":" and wanted == "colon":
            wanted = "value"
        elif token == "," and wanted == "comma":
            wanted = "key" if top.kind == "object" else "item"
            top.key, top.at = str(int(top.key) + 1) if top.kind == "array" else "", None
        elif token in ("}", "]"):
            kinds = ("object", "first key", "key") if token == "}" else ("array", "first item", "item")
            if top is None or top.kind != kinds[0] or not (wanted in ("comma", kinds[1]) or (trailing and wanted == kinds[2])):
                return None
            above.pop()
            keys, _, _ = place(top.start)
            out[top.slot] = Value(keys, top.name, top.kind, None, top.key_start, top.start, at)
            wanted = "comma" if above else "end"
        elif wanted in ("key", "first key"):
            if kind != "string" and not (dialect == "json5" and re.fullmatch(r"[\w$]+", token) and not token[0].isdigit()):
                return None
            top.key, top.at, wanted = unescaped(token, dialect) if kind == "string" else token, m.start(), "colon"
        elif wanted not in ("value", "item", "first item") or kind == "name" or token in (":", ","):
            return None
        else:
            keys, name, key_start = place(m.start())
            if token in ("{", "["):
                if len(above) == DEEPEST:
                    return None
                above.append(_Open("object" if token == "{" else "array", len(out), name, key_start, m.start()))
                out.append(None)
                wanted = "first key" if token == "{" else "first item"
            else:
                shown = unescaped(token, dialect) if kind == "string" else token
                out.append(Value(keys, name, "string" if kind == "string" else "scalar", shown, key_start, m.start(), at))
                wanted = "comma" if above else "end"
    return out if at == len(text) and wanted == "end" else None


_TOML = re.compile(r"(?P<skip>[ \t\r]++|\#[^\n]*+)|(?P<line>\n)|(?P<string>\"\"\"(?:[^\\]|\\[\s\S])*?\"{3,5}|'''[\s\S]*?'{3,5}|\"(?:[^\"\\\n]|\\.)*+\"|'[^'\n]*+')|(?P<mark>[\[\]{}=,])|(?P<scalar>[^\s\[\]{}=,#\"']++(?:[ ][0-9]{2}:[0-9:.Zz+-]++)?)")


def _dotted(tokens: list[tuple[str, str]]) -> list[str]:
    """The keys of a dotted name; what stands between quotes is one key, whatever dots it holds."""
    keys: list[str] = []
    for kind, token in tokens:
        keys += [_toml_string(token)] if kind == "string" else [k for k in token.split(".") if k]
    return keys


def _toml_string(token: str) -> str:
    return tomllib.loads(f"x = {token}")["x"]


def toml_values(text: str) -> list[Value] | None:
    """The values of a TOML document in their order, with tables where their heads stand; None if it isn't one."""
    try:
        tomllib.loads(text)
    except (ValueError, RecursionError):
        return None
    out: list[Value | None] = []
    prefix: tuple[str, ...] = ()
    counts: dict[tuple[str, ...], int] = {}
    above: list[list] = []  # kind, slot, keys, name, key_start, start, index
    key: list[tuple[str, str]] = []
    key_at, wanted, heads, head_at = 0, "key", 0, 0

    def resolved(keys: list[str]) -> tuple[str, ...]:
        path: tuple[str, ...] = ()
        for k in keys:
            path = (*path, k)
            if path in counts:
                path = (*path, str(counts[path]))
        return path

    for m in _TOML.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind == "skip" or (kind == "line" and wanted != "end"):
            continue
        if kind == "line":
            wanted = "key"
        elif wanted == "key" and not above and token == "[" and not key:
            wanted, heads, head_at, key = "head", 1, m.start(), []
        elif wanted == "head":
            if token == "[":
                heads += 1
            elif token != "]":
                key.append((kind, token))
            elif heads == 2:
                *parents, last = _dotted(key)
                path = (*resolved(parents), last)
                counts[path] = counts.get(path, -1) + 1
                prefix, wanted, key, heads = (*path, str(counts[path])), "closing", [], 0
                out.append(Value(prefix, last, "table", None, head_at, head_at, m.end() + 1))
            else:
                prefix, wanted, key = resolved(_dotted(key)), "end", []
                out.append(Value(prefix, prefix[-1], "table", None, head_at, head_at, m.end()))
        elif wanted == "closing":
            wanted = "end"
        elif wanted == "key" and token not in ("=", "}", ","):
            key_at = key_at if key else m.start()
            key.append((kind, token))
        elif token == "=" and wanted == "key":
            wanted = "value"
        elif token in ("]", "}"):
            _, slot, keys, name, begun, start, _ = above.pop()
            out[slot] = Value(keys, name, "array" if token == "]" else "object", None, begun, start, m.end())
            key, wanted = [], "comma" if above else "end"
        elif token == ",":
            above[-1][6] += 1
            key, wanted = [], "value" if above[-1][0] == "array" else "key"
        else:
            outer = above[-1] if above else None
            if outer and outer[0] == "array":
                keys, name, begun = (*outer[2], str(outer[6])), outer[3], m.start()
            else:
                own = _dotted(key)
                keys, name, begun = (*(outer[2] if outer else prefix), *own), own[-1], key_at
            key = []
            if token in ("[", "{"):
                if len(above) == DEEPEST:
                    return None
                above.append(["array" if token == "[" else "object", len(out), keys, name, begun, m.start(), 0])
                out.append(None)
                wanted = "value" if token == "[" else "key"
            else:
                out.append(Value(keys, name, "string" if kind == "string" else "scalar", _toml_string(token) if kind == "string" else token, begun, m.start(), m.end()))
                wanted = "comma" if above else "end"
    return out


def values_of(text: str | None, dialect: str | None) -> list[Value] | None:
    if text is None or dialect is None:
        return None
    return toml_values(text) if dialect == "toml" else json_values(text, dialect)


def split_members(text: str | None, key: str) -> tuple[list[tuple[str, int, str]], str] | None:
    """The members of the root's object ``key``, as (name, line, text), and the document with that object blank.

    None if it isn't strict JSON, or gives the object, or a member of it, twice.
    """
    found = values_of(text, "json") or []
    maps = [v for v in found if v.keys == (key,)]
    members = [v for v in found if len(v.keys) == 2 and v.keys[0] == key]
    if len(maps) != 1 or maps[0].kind != "object" or len({v.keys for v in members}) < len(members):
        return None
    out, line, at = [], 1, 0
    for v in members:
        line += text.count("\n", at, v.key_start)
        at = v.key_start
        out.append((v.keys[1], line, text[v.key_start : v.end]))
    start, end = maps[0].start + 1, maps[0].end - 1
    return out, text[:start] + re.sub(r"[^\n\r]", " ", text[start:end]) + text[end:]
