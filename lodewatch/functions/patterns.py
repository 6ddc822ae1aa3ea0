"""Patterns of the rule catalog, made ready for Java and for RE2, and what every match of them must hold.

The catalog writes patterns with ASCII word edges and Unicode white space. Java's ``\\b`` is Unicode-wide and its ``\\s``
ASCII, RE2's are both ASCII, so both are spelled out. ``required`` reads a pattern's syntax tree: texts that hold none
of its words can't match, and a search for a word is far cheaper than one for a pattern.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

# fixed values: white space of the scripts' language, as the inside of a class, and as characters to trim
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE_CHARS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD = "[A-Za-z0-9_]"

_TOKEN = re.compile(r"\\x\{[0-9A-Fa-f]+\}|\\k<\w+>|\\.|\[\^?\]?(?:\\x\{[0-9A-Fa-f]+\}|\\.|[^\]\\])*\]|[\s\S]")


def _class(token: str, spaces: str) -> str:
    if token in (r"[\s\S]", r"[\S\s]"):
        return token
    if token == r"[^\S\n]":
        return f"[{spaces.replace(chr(92) + 'n', '')}]"
    return token.replace(r"\s", spaces)


def _spelled_out(pattern: str, edges: bool) -> str:
    tokens = _TOKEN.findall(pattern)
    out = []
    for i, t in enumerate(tokens):
        if t == r"\b" and edges:
            after, before = tokens[i + 1] if i + 1 < len(tokens) else "", tokens[i - 1] if i else ""
            if re.fullmatch(WORD, after) and (i + 2 == len(tokens) or tokens[i + 2] not in "?*{"):
                t = f"(?<!{WORD})"
            elif re.fullmatch(WORD, before):
                t = f"(?!{WORD})"
            else:
                t = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
        elif t == r"\s":
            t = f"[{SPACE}]"
        elif t == r"\S":
            t = f"[^{SPACE}]"
        elif len(t) > 1 and t[0] == "[":
            t = _class(t, SPACE)
        out.append(t)
    return "".join(out)


@lru_cache(maxsize=None)
def java_pattern(pattern: str) -> str:
    return _spelled_out(pattern, edges=True)


def re2_pattern(pattern: str) -> str:
    return _spelled_out(pattern, edges=False)


def portable(pattern: str) -> bool:
    """Whether RE2 can match the pattern: it has no look-around, back reference, named group or possessive repeat."""
    return not any(m in pattern for m in ("(?=", "(?!", "(?<", r"\k<", "*+", "++", "}+"))


def python_pattern(pattern: str) -> str:
    """For ``re`` with ASCII classes."""
    out = _spelled_out(pattern, edges=False).replace("(?<finding>", "(?P<finding>").replace("(?<quote>", "(?P<quote>").replace(r"\k<quote>", "(?P=quote)").replace("(?iu)", "(?i)")
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: rf"\U{int(m[1], 16):08X}", out)


# --- what the syntax tree tells


def _tree(pattern: str):
    return parser.parse(python_pattern(pattern))


def _letter(item) -> str | None:
    """The one character, in lower case, that an item stands for."""
    code, value = item
    if code is op.LITERAL:
        return chr(value).lower()
    if code is op.IN and all(c is op.LITERAL for c, _ in value) and len({chr(v).lower() for _, v in value}) == 1:
        return chr(value[0][1]).lower()
    return None


def _words(items) -> tuple[str, ...] | None:
    """Words of which every match of these items holds one, in lower case; None if nothing is sure."""
    found: list[tuple[str, ...]] = []
    run = ""
    for item in [*items, (None, None)]:
        code, value = item
        if code in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        if (c := _letter(item) if code else None) is not None:
            run += c
            continue
        if run:
            found.append((run,))
            run = ""
        inner = None
        if code is op.SUBPATTERN:
            inner = _words(value[-1])
        elif code is op.BRANCH:
            parts = [_words(x) for x in value[1]]
            inner = tuple(sorted({w for p in parts for w in p})) if all(parts) else None
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner = _words(value[2])
        elif code is op.IN and len(value) <= 16 and all(c is op.LITERAL for c, _ in value):
            inner = tuple(sorted({chr(v).lower() for _, v in value}))
        if inner:
            found.append(inner)
    return max(found, key=lambda ws: (min(len(w.encode()) for w in ws), -len(ws)), default=None)


@lru_cache(maxsize=None)
def required(pattern: str) -> tuple[str, ...]:
    """Words in lower case of which every match holds one in any case; none if nothing is sure."""
    return _words(_tree(pattern)) or ()


def _deep(items) -> bool:
    for code, value in items:
        if code in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] > 256:
            low, high = value[2].getwidth()
            plain = len(value[2]) == 1 and value[2][0][0] in (op.LITERAL, op.NOT_LITERAL, op.IN, op.ANY)
            if not plain and low != high or any(c in (op.MAX_REPEAT, op.MIN_REPEAT, op.BRANCH) for c, _ in value[2]):
                return True
        inner = [value[-1]] if code in (op.SUBPATTERN, op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) else value[1] if code is op.BRANCH else [value[1]] if code in (op.ASSERT, op.ASSERT_NOT) else []
        if any(_deep(x) for x in inner):
            return True
    return False


def recurses(pattern: str) -> bool:
    """Whether Java would recurse for each round of an unbounded repeat of a group, and so run out of stack on long texts.

    Possessive repeats are loops.
    """
    return _deep(_tree(pattern))
