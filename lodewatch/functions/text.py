"""Text functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import java_pattern, required

# fixed values: shapes of secrets
SECRETS = (
    r"\b(AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\bsk-[A-Za-z0-9_-]{20,}\b",
    r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b",
    r"(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*[\"']?[^\"'\s]{8,}",
    r"\b[A-Za-z0-9+/]{32,}={0,2}\b",
)
#: What the last shape, which has no word of its own, can't do without.
LONG_RUN = "[A-Za-z0-9+/]{32}"
# fixed values: path segments and base names of documentation
DOCS_SEGMENTS = ("docs", "documentation", "examples", "reference", "references", "samples", "assets", "__tests__")
DOCS_NAME = r"(?i)(?:^(?:readme|changelog|threat[-_]?model)\b|(?:\.test|\.spec)\.[^.]+$|^test[_-]|(?:^|[-_])(?:fixture|sample|example|asset)(?:[-_.]|$))"


def redacted(text: Column) -> Column:
    """The text with ``[REDACTED]`` in place of secrets. Texts without a word that a pattern requires are left as they are."""
    for pattern in SECRETS:
        words = required(pattern)
        may = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in words]) if words else F.regexp_like(text, F.lit(LONG_RUN))
        text = F.when(may, F.regexp_replace(text, java_pattern(pattern), "[REDACTED]")).otherwise(text)
    return text


def is_documentation(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.arrays_overlap(F.transform(parts, F.lower), F.array(*map(F.lit, DOCS_SEGMENTS))) | F.regexp_like(F.element_at(parts, -1), F.lit(java_pattern(DOCS_NAME)))
