"""Forms of some patterns that take time in proportion to the text. They find what the catalog's forms find, as tests show.

The catalog's forms of these patterns scan on from each start to the end of a line, tag or text, so hostile texts cost the
square or cube of their length. Here a search begins where a run of such starts begins, takes the first start (the one that
leaves the most text for what must follow) without going back, and so passes over each run once.
"""

from __future__ import annotations

from functools import lru_cache

from .catalog import AGENT_FILES, HIDDEN_ORDER, HIDDEN_STYLE, NOT_FORBIDDEN, RULES, WRITES

#: Characters of an address.
_PART = r"[^\s\"'`<>]"
_MISSPELT = "ignοre|οverride|bypαss|disαble|nοde|pythοn|cοm"
#: White space with a line's end in it from its first character on, or the mark of a sentence or list before it.
_OPENING = r"(?:^|(?<!\s)[^\S\n]*+\n\s*+|[.!?:;-]\s*+|\*\s++)"
#: Where what isn't ``>`` begins, if it ends with one.
_TAG = r"(?:\A|(?<=>))(?=[^>]*+>)"
_STYLE = r"style\s*=\s*[\"']"
_ORDER = r"[\s\S]{0,500}\b(?:ignore|disregard|override|bypass|forget|follow|obey|send|leak|exfiltrate)\b[\s\S]{0,120}\b(?:instructions?|rules?|prompts?|system|secret|token|credential)\b"
_WHITE = r"[^\"']*?color\s*:\s*(?:white|#fff{1,3})(?>[^\"']*?background(?:-color)?\s*:\s*(?:white|#fff{1,3}))[^\"']*+[\"']"


def _in_line(word: str, start: str, rest: str) -> tuple[str, str]:
    """The first ``word start`` of a line, as any later one has less of the line for ``rest``; and one across a line's end."""
    return rf"(?:\A|(?<=\n))(?>[^\n]*?(?<finding>{word}[^\S\n]+{start})){rest}", rf"{word}[^\S\n]*+\n\s*+{start}{rest}"


def _last_before(first: str, then: str) -> str:
    """The last ``first`` that ``then`` follows, up to the last ``then`` of the line.

    What stands between them holds neither. A ``first`` across a line's end is the last of its line whatever comes next,
    and a ``then`` across it is the last one.
    """
    return rf"(?:(?=\n|(?:[Cc]at|[Tt]ee)[^\S\n]*+\n){first}[^#\n]*{then}|{first}(?:(?!{first}|{then})[^#\n])*+(?:(?=\n){then}|(?!\n){then}(?:[^#\n]*{then})?))"


def _styled(opening: str, style: str, rest: str) -> tuple[str, str]:
    """A style attribute that ends before the next ``>``, the first that fits; and one whose value goes beyond it."""
    return tuple(rf"(?i){_TAG}(?>{opening.replace('STYLE', begins + style)})[^>]*+>{rest}" for begins in (_STYLE, rf"{_STYLE}(?=[^\"'>]*+>)"))


def _linear(rule_id: str, nr: int, pattern: str) -> str | tuple[str, ...]:
    """The linear forms of a rule's pattern, which together find what it finds; most are linear as they are."""
    match rule_id, nr:
        case "GIT-HISTORY-SCAN", 0:
            return _in_line(r"\bgit", r"log\b[^\n]{0,80}?-p\b", r"[^\n|]*+\|[^\n]*?\bgrep\b")
        case "GIT-HISTORY-SCAN", 2:
            return _in_line(r"\bgit", r"log\b[^\n]{0,60}?--all\b", r"[^\n]*?\|\s*grep\b")
        case "DEPS-INSTALL-SCRIPT-HOOKS", 0:
            return r"\"(?:post|pre)install\"\s*:\s*\"(?>[^\"]*?\bnpm\s+(?:install|i|add)\b)[^\"]*+\""
        case "DEPS-INSTALL-SCRIPT-HOOKS", 1:
            return r"\"(?:post|pre)install\"\s*:\s*\"(?>[^\"]*?\bpip3?\s+install\b)[^\"]*+\""
        case "DEPS-INSTALL-SCRIPT-HOOKS", 2:
            return r"\"(?:post|pre)install\"\s*:\s*\"(?>[^\"]*?\b(?:curl|wget)\s)[^\"]*+\""
        case "DEPS-INSTALL-SCRIPT-HOOKS", 3:
            return r"(?:\A|(?<=\)))(?=[^)]*+\))(?>[^)]*?(?<finding>subprocess\.\w+\(\s*\[?\s*['\"]pip['\"]))[^)]*?\binstall\b[^)]*+\)"
        case "OBFS-HOMOGLYPH", 2:
            # the first address of a run, or what stands before any; the empty group tells that the run's beginning was passed
            passed = rf"(?<!{_PART})(?:(?!https?://|\b(?:{_MISSPELT})){_PART})*+(?=https?://)()"
            return rf"(?iu)(?:{passed})?(?<finding>\b(?:{_MISSPELT})[A-Za-z0-9_.:/-]*\b|\1https?://{_PART}*[αουν]{_PART}*)"
        case "PI-WHITE-ON-WHITE", 0:
            return _styled(r"[^>]*?(?<finding><(?:span|div|p))[^>]*?STYLE", rf"[^\"']*?{HIDDEN_STYLE}[^\"']*+[\"']", rf"[\s\S]{{0,500}}{HIDDEN_ORDER}[\s\S]{{0,500}}</(?:span|div|p)>")
        case "PI-WHITE-ON-WHITE", 1:
            return _styled(r"[^>]*?(?<finding>STYLE)", _WHITE, _ORDER)
        case "PI-METADATA-MISMATCH", 0:
            return pattern.replace(r"^---[\s\S]*?(?:name|description)\s*:[\s\S]*?---", r"\A---(?>[\s\S]*?(?:name|description)\s*:)(?>[\s\S]*?---)", 1)
        case "PI-PRIV-ESCALATE-INSTRUCTION", 0 | 1:
            return pattern.replace(r"(?:^|[\n.!?:;-]\s*|[-*]\s+)", _OPENING, 1)
        case "SKILL-MEMORY-WRITE", 0:
            return rf"(?:^|\n){NOT_FORBIDDEN}[^#\n]*(?<finding>(?:{_last_before(WRITES, AGENT_FILES)}|{_last_before(AGENT_FILES, r'\b(?:[Ww]rite|[Aa]ppend)\b')}))"
    return pattern


@lru_cache(maxsize=None)
def _forms() -> dict[str, tuple[str, ...]]:
    found = {p: _linear(r.rule_id, i, p) for r in RULES for i, p in enumerate(r.patterns)}
    return {p: (x,) if isinstance(x, str) else x for p, x in found.items()}


def linear_forms(pattern: str) -> tuple[str, ...]:
    """How the pattern is matched; the matches of all forms are its own."""
    return _forms().get(pattern, (pattern,))
