"""A note on targets that look like security education, so that their findings are read as such."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import java_pattern
from .inventory import basename

# fixed values: the note, the files that tell what a target is about, how much of them counts, and the words
NOTE_ID = "CTX-SECURITY-EDUCATION"
NOTE_SNIPPET = "Likely security, scanner, tester, or red-team skill context."
NOTE_MESSAGE = "This skill appears security-related; review whether matched evidence is an inert example before ignoring it."
CONTEXT_FILES, CONTEXT_CHARS = ("SKILL.md", "AGENTS.md", "README.md"), 8000
EDUCATION_WORDS = r"(?i)\b(?:security|audit(?:or|ing)?|scanner|detector|tester|testing|red[-_ ]?team|blue[-_ ]?team|prompt[-_ ]?injection|jailbreak|malware|vulnerab(?:ility|ilities)?|threat[-_ ]?model|payload|fixture|rule[-_ ]?test|false[-_ ]?positive)\b"


def with_context_notes(findings: DataFrame, files: DataFrame) -> DataFrame:
    """``findings`` and one note of severity info for each target that has others and whose context files, or whose id, speak of security.

    The note stands at line 1 of the file of the target's first finding above info. ``files`` has target_id, path and content.
    """
    speaks = lambda c: F.regexp_like(c, F.lit(java_pattern(EDUCATION_WORDS)))
    anchors = findings.filter("severity <> 'info'").groupBy("target_id").agg(F.min_by("path", F.struct("path", "line", "rule_id")).alias("path"))
    noted = findings.filter(F.col("rule_id") == NOTE_ID).select("target_id").distinct()
    telling = files.filter(basename(F.col("path")).isin(*CONTEXT_FILES) & speaks(F.substring(F.coalesce("content", F.lit("")), 1, CONTEXT_CHARS))).select("target_id")
    telling = telling.unionByName(anchors.filter(speaks(F.col("target_id"))).select("target_id")).distinct()
    notes = anchors.join(telling, "target_id", "left_semi").join(noted, "target_id", "left_anti")
    text = {"rule_id": NOTE_ID, "severity": "info", "message": NOTE_MESSAGE, "snippet": NOTE_SNIPPET}
    values = {"target_id": F.col("target_id"), "path": F.col("path"), "line": F.lit(1), "column": F.lit(1), **{k: F.lit(v) for k, v in text.items()}}
    return findings.unionByName(notes.select(*[values[c].alias(c) for c in findings.columns]))
