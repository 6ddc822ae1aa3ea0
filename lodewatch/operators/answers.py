"""Answers of reviewing models: JSON, mended where a model left something off, as findings.

Mending is a small helper for each answer; types, normal forms and verdicts on the answer are built-in functions. An answer
holds all its findings or none: one that can't be used makes it invalid. Null and empty answers, and those without a list of
findings, are invalid; placeholders and findings that say that there are none are left out; repeated answers are read one by
one; extra columns stay.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import SPACE_CHARS
from ..functions.settings import parsed
from ..plans.catalog import SEVERITIES

# fixed values: categories, words that stand for one (the first that fits), what models copy from the prompt, what says that nothing was found
CATEGORIES = ("prompt-injection", "code-execution", "network", "filesystem", "secrets", "persistence", "dependency", "obfuscation", "git-history", "skill-specific", "other")
CATEGORY_WORDS = (("prompt", "prompt-injection"), ("obfus", "obfuscation"), ("git.*history|history.*git", "git-history"), ("skill[ -]specific", "skill-specific"), ("code|exec|command|shell", "code-execution"), ("network", "network"), ("file", "filesystem"), ("credential|secret", "secrets"), ("persist", "persistence"), ("depend", "dependency"))
PLACEHOLDERS = ("short reason", "optional relative path", "optional short fix", "specific reason tied to the payload", "path to file", "none")
NOTHING_STARTS = ("no additional ", "no prompt injection vulnerability found", "no unsafe ", "no dependency risk ")
NOTHING_HELD = " is secure"
NOTHING_FOUND = r"\bno\b.+\b(found|detected)\b"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# fixed values: quotes that were escaped outside of strings
ESCAPED = ((re.compile(r"([,{]\s*)\\\"([A-Za-z_][A-Za-z0-9_]*)\\\"(?=\s*:)"), r'\1"\2"'), (re.compile(r"(:\s*)\\\""), r'\1"'), (re.compile(r"\\\"(?=\s*:)"), '"'), (re.compile(r"\\\"(?=\s*[,}])"), '"'))

_PIECE = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*+(?P<open>\Z|(?=\\\Z))|\"(?:[^\"\\]|\\[\s\S])*+\"|(?P<mark>[{}\[\]])")
_CLOSER = {"{": "}", "[": "]"}


def closed(text: str) -> str | None:
    """The text with the brackets that it leaves open; None if it ends in a string or behind a comma, or if none is missing."""
    text, out, at, missing, wanted = text.strip(), [], 0, 0, []
    if not text.startswith("{") or text.endswith(","):
        return None
    for m in _PIECE.finditer(text):
        mark = m["mark"]
        if m["open"] is not None:
            return None
        if mark in _CLOSER:
            wanted.append(_CLOSER[mark])
        elif mark and (not wanted or wanted.pop() != mark):
            # one bracket may have been forgotten before this one
            if not wanted or wanted.pop() != mark:
                return None
            out += [text[at : m.start()], "]" if mark == "}" else "}"]
            at, missing = m.start(), missing + 1
    return "".join([*out, text[at:], *reversed(wanted)]) if missing or wanted else None


def unescaped(text: str) -> str:
    text = text.strip()
    if text.startswith("{"):
        for pattern, by in ESCAPED:
            text = pattern.sub(by, text)
    return text


def mended(answer: str | None) -> str | None:
    """The answer as strict JSON, or None. What is mended: closing brackets that are missing, and quotes escaped outside of strings."""
    for text in (answer or "", unescaped(answer or "")):
        for tried in (text, closed(text)):
            if tried is not None and (value := parsed(tried)) is not None:
                return json.dumps(value)
    return None


_mended = F.pandas_udf(lambda s: pd.Series([mended(x) for x in s], dtype=object), T.StringType())


def _normal(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(SPACE_CHARS)))


def severity_of(text: Column) -> Column:
    return F.when(_normal(text).isin(*SEVERITIES), _normal(text))


def category_of(text: Column) -> Column:
    """The category that a model's words mean; null for several, and for none."""
    normal = _normal(text)
    found = F.when(normal.contains("|"), F.lit(None)).when(normal.isin(*CATEGORIES), normal)
    for words, category in CATEGORY_WORDS:
        found = found.when(F.regexp_like(normal, F.lit(f"(?s){words}")), category)
    return found


def says_nothing(rationale: Column) -> Column:
    normal = F.regexp_replace(_normal(rationale), r"\.\z", "")
    starts = [normal.startswith(s) for s in NOTHING_STARTS]
    out = (normal == "") | normal.isin(*PLACEHOLDERS) | normal.contains(NOTHING_HELD) | F.regexp_like(normal, F.lit(NOTHING_FOUND))
    for s in starts:
        out = out | s
    return out


def _entry(e: Column) -> Column:
    """struct<bad, skipped, finding> of one entry of the list."""
    fields = F.try_variant_get(e, "$", "map<string, variant>")

    def get(name: str, kind: str = "STRING") -> Column:
        v = F.try_element_at(fields, F.lit(name))
        return F.when(F.schema_of_variant(v) == kind, F.try_variant_get(v, "$", "string"))

    def wrong(name: str) -> Column:
        v = F.try_element_at(fields, F.lit(name))
        return v.isNotNull() & (F.schema_of_variant(v) != "STRING")

    def optional(name: str) -> Column:
        text = F.btrim(get(name), F.lit(SPACE_CHARS))
        return F.when((text != "") & ~F.lower(text).isin(*PLACEHOLDERS), text)

    given = F.try_element_at(fields, F.lit("confidence"))
    number = F.coalesce(F.when(F.schema_of_variant(given).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(given, "$", "double")), F.when(F.regexp_like(F.btrim(get("confidence"), F.lit(SPACE_CHARS)), F.lit(NUMBER)), F.btrim(get("confidence"), F.lit(SPACE_CHARS)).try_cast("double")))
    confidence = F.when(given.isNull(), F.lit(0.5)).when((number >= 0) & (number <= 1), number)
    rationale = F.coalesce(F.btrim(get("rationale"), F.lit(SPACE_CHARS)), F.lit(""))
    severity, category = severity_of(get("severity")), category_of(get("category"))
    skipped = fields.isNotNull() & says_nothing(rationale)
    bad = fields.isNull() | (~skipped & (severity.isNull() | category.isNull() | confidence.isNull() | wrong("file") | wrong("file_path") | wrong("suggested_fix")))
    finding = F.struct(severity.alias("severity"), category.alias("category"), confidence.alias("confidence"), rationale.alias("rationale"), F.coalesce(optional("file"), optional("file_path")).alias("file"), optional("suggested_fix").alias("suggested_fix"))
    return F.struct(F.coalesce(bad, F.lit(True)).alias("bad"), F.coalesce(skipped, F.lit(False)).alias("skipped"), finding.alias("finding"))


def read_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (answer) with ``status`` (ok or invalid-response) and ``findings``, an array of (severity, category, confidence, rationale, file, suggested_fix)."""
    root = F.try_parse_json(_mended("answer"))
    entries = F.transform(F.try_variant_get(root, "$.findings", "array<variant>"), _entry)
    rows = answers.withColumn("entries", entries)
    usable = F.coalesce(~F.exists("entries", lambda e: e["bad"]), F.lit(False))
    kept = F.transform(F.filter("entries", lambda e: ~e["skipped"]), lambda e: e["finding"])
    return rows.withColumn("status", F.when(usable, "ok").otherwise("invalid-response")).withColumn("findings", F.when(usable, kept)).drop("entries")
