"""Queries over outcomes of runs and answers of models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.answers import NOTHING_FOUND, NOTHING_HELD, NOTHING_STARTS, PLACEHOLDERS, read_answers
from ..operators.outcomes import agent_scans, footer, kept_findings, of_agent, outcomes, run_state, withheld_if_incomplete
from ..sources.files import within_limit
from ..staging import staged
from .catalog import SEVERITIES
from .queries import _findings_sql, _quoted, documents, seeded_findings, seeded_summaries
from .seeds import TARGET_FILES, seeded_files
from .trees import _CASE

#: Bytes that a file may have in these queries, and a limit that none reaches.
MOST_BYTES, ANY_BYTES = 4_000, 1 << 40


def decided(spark: SparkSession, sf_dir: str, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Targets of the seeded files, whose agents are the languages of their documents, with their outcomes; and the errors."""
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    nr = F.floor(F.col("doc_id") / TARGET_FILES)
    targets = docs.groupBy(nr.alias("nr")).agg(F.array_compact(F.sort_array(F.collect_set("lang"))).alias("agent_ids"))
    targets = targets.select(F.concat(F.lit("t"), "nr").alias("target_id"), "agent_ids", (F.col("nr") % 9 == 4).alias("ignored"), F.when(F.col("nr") % 4 == 0, "marketplace").otherwise("installed").alias("state"))
    files = seeded_files(spark, sf_dir).select("target_id", "path", F.octet_length("content").alias("bytes"))
    beyond = within_limit(files, most)[1].select(F.concat(F.lit("t"), F.floor(F.substring_index("path", "/", 1).cast("long") / TARGET_FILES)).alias("target_id"), "error")
    return outcomes(targets, beyond), beyond


def m11_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir)[0].select("target_id", "outcome", "error", "ignored")


def a15_agent_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_scans(decided(spark, sf_dir)[0])


def f4_agent_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged targets whose first agent is the one asked for."""
    return of_agent(decided(spark, sf_dir)[0], "en", True).select("target_id", "outcome")


def m11_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, errors = decided(spark, sf_dir)
    return run_state(rows, seeded_summaries(spark, sf_dir).select("target_id", "verdict"), errors)


def k10_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a log at two limits: a run that is incomplete at one has none there."""
    found = staged(seeded_findings(spark, sf_dir), "findings")
    verdicts = seeded_summaries(spark, sf_dir).select("target_id", "verdict")
    out = []
    for most in (MOST_BYTES, ANY_BYTES):
        rows, errors = decided(spark, sf_dir, most)
        kept = kept_findings(found, rows).select(F.lit(most).alias("most_bytes"), "path", "rule_id", "line")
        out.append(withheld_if_incomplete(kept, run_state(rows, verdicts, errors)))
    return out[0].unionByName(out[1])


def k4_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footer(decided(spark, sf_dir)[0], seeded_summaries(spark, sf_dir), seeded_findings(spark, sf_dir))


#: Words of a model, by remainder of the id, and what they mean: severity, category and confidence. The last two make an answer invalid.
WORDS = (("High ", "Shell commands", '"0.25"', "high", "code-execution", 0.25), ("low", "prompt injection!", "1", "low", "prompt-injection", 1.0), (" MEDIUM", "stolen credentials", "0.5", "medium", "secrets", 0.5), ("huge", "network", "0.5", None, "network", 0.5), ("info", "network|file", "0.5", "info", None, 0.5))
#: What an answer ends with, by number of five documents; the last two can't be mended.
ENDS = ('"}]}', '"}]', '"}', '"}}', '"}],', "")


def l5_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is the rationale of an answer's finding; answers are cut, lack brackets or hold bad words."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    of = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    rationale = F.regexp_replace(F.to_json(F.struct("text")), r'\A\{"text":"|"\}\z', "")
    word = lambda i: of([w[i] for w in WORDS], F.col("doc_id"))
    answer = F.concat(F.lit('{"findings": [{"severity": "'), word(0), F.lit('", "category": "'), word(1), F.lit('", "confidence": '), word(2), F.lit(', "rationale": "'), rationale, of(ENDS, F.floor(F.col("doc_id") / len(WORDS))))
    rows = read_answers(docs.select("doc_id", answer.alias("answer"))).select("doc_id", "status", F.explode_outer("findings").alias("f"))
    return rows.select("doc_id", "status", "f.severity", "f.category", "f.confidence", F.md5(F.col("f.rationale").cast("binary")).alias("rationale_md5"))


QUERIES = {"m11_outcomes": m11_outcomes, "m11_run_state": m11_run_state, "a15_agent_scans": a15_agent_scans, "f4_agent_targets": f4_agent_targets, "k10_log_rows": k10_log_rows, "k4_footer": k4_footer, "l5_answers": l5_answers}

_DECIDED = rf"""
late AS (SELECT DISTINCT target_id, 'larger than {MOST_BYTES} bytes' AS error FROM files WHERE strlen(content) > {MOST_BYTES}
), nrs AS (SELECT doc_id // {TARGET_FILES} AS nr, coalesce(list(DISTINCT lang ORDER BY lang) FILTER (lang IS NOT NULL), []) AS agent_ids FROM documents GROUP BY ALL
), decided AS (SELECT 't' || nr AS target_id, agent_ids, nr % 9 = 4 AS ignored, CASE WHEN nr % 4 = 0 THEN 'marketplace' ELSE 'installed' END AS state,
  CASE WHEN nr % 9 = 4 THEN 'ignored' WHEN error IS NOT NULL THEN 'failed' ELSE 'scanned' END AS outcome, CASE WHEN nr % 9 <> 4 THEN error END AS error FROM nrs LEFT JOIN late ON target_id = 't' || nr
), agents AS (SELECT agent_id, count(*) AS scanned, count(*) FILTER (outcome = 'ignored') AS ignored FROM (SELECT unnest(agent_ids) AS agent_id, outcome FROM decided WHERE outcome <> 'failed') GROUP BY ALL
)
"""
_FILES = _findings_sql().rstrip()
_TAIL = _FILES + ", " + _DECIDED
_BOTH = "summaries JOIN decided USING (target_id) WHERE outcome = 'scanned'"
_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(5760) || " + " || ".join(f"chr({n})" for n in (*range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279))
_NOTHING = " OR ".join([f"plain IN ({', '.join(map(_quoted, ('', *PLACEHOLDERS)))})", *[f"starts_with(plain, {_quoted(s)})" for s in NOTHING_STARTS], f"contains(plain, {_quoted(NOTHING_HELD)})", f"regexp_matches(plain, {_quoted(NOTHING_FOUND)})"])
ORACLES = {
    "m11_outcomes": _TAIL + "SELECT target_id, outcome, error, ignored FROM decided",
    "a15_agent_scans": _TAIL + "SELECT * FROM agents",
    "f4_agent_targets": _TAIL + "SELECT target_id, outcome FROM decided WHERE agent_ids[1] = 'en'",
    "m11_run_state": _TAIL
    + f"""SELECT count(*) FILTER (outcome <> 'ignored') AS tried, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (ignored) AS ignored, count(*) FILTER (outcome = 'failed') > 0 AS incomplete,
  (SELECT CASE WHEN count(*) FILTER (verdict = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (verdict = 'REVIEW') > 0 THEN 'REVIEW' ELSE 'PASS' END FROM {_BOTH}) AS verdict,
  CASE WHEN (SELECT count(*) FILTER (verdict = 'FAIL') FROM {_BOTH}) > 0 THEN 1 WHEN count(*) FILTER (outcome = 'failed') > 0 THEN 3 ELSE 0 END::INTEGER AS exit_code FROM decided""",
    "k10_log_rows": _TAIL
    + f"""SELECT b.most_bytes, path, rule_id, line FROM findings JOIN decided USING (target_id) CROSS JOIN (VALUES ({MOST_BYTES}::BIGINT), ({ANY_BYTES}::BIGINT)) b(most_bytes)
WHERE NOT ignored AND (b.most_bytes = {ANY_BYTES} OR NOT EXISTS (FROM decided WHERE outcome = 'failed'))""",
    "k4_footer": _TAIL
    + f""", worst AS (SELECT f.target_id, min(list_position({list(SEVERITIES)!r}, severity)) AS r FROM findings f JOIN decided d ON f.target_id = d.target_id WHERE outcome = 'scanned' GROUP BY ALL
), n AS (SELECT count(*) FILTER (outcome <> 'ignored') AS tried, count(*) FILTER (outcome <> 'failed' AND state = 'marketplace') AS market, count(*) FILTER (outcome <> 'failed' AND state = 'installed') AS own FROM decided
), bad AS (SELECT count(*) FILTER (verdict = 'FAIL') AS bad FROM {_BOTH}
), share AS (SELECT bad, market, bad * 100.0::DOUBLE / tried AS percent FROM bad, n)
SELECT 1::INTEGER AS nr, '  Targets scanned........... ' || tried AS text FROM n
UNION ALL SELECT 2, '  Agents scanned............ ' || string_agg(agent_id || ': ' || scanned, ', ' ORDER BY agent_id) FROM agents
UNION ALL SELECT 3, '  Install state............. installed: ' || own || ', marketplace: ' || market FROM n WHERE market > 0
UNION ALL SELECT 4, '  Unique issues............. ' || count(*) || '  (' || {" || ', ' || ".join(f"count(*) FILTER (r = {i + 1}) || ' {s}'" for i, s in enumerate(SEVERITIES[:4]))} || CASE WHEN count(*) FILTER (r = 5) > 0 THEN ', ' || count(*) FILTER (r = 5) || ' info' ELSE '' END || ')' FROM worst
UNION ALL SELECT 5, '  Compromised targets....... ' || CASE WHEN bad = 0 THEN '0' ELSE bad || '   (' || CASE WHEN percent < 1 THEN printf('%.2f', floor(percent * 100 + 0.5) / 100) ELSE floor(percent + 0.5)::BIGINT::VARCHAR END || '% of ' || CASE WHEN market > 0 THEN 'scanned' ELSE 'installed' END || ')' END FROM share""",
    "l5_answers": f"""
WITH d AS (SELECT doc_id, trim(coalesce(text, ''), {_SPACES}) AS shown, {_CASE(f"doc_id % {len(WORDS)}", [w[3] or "" for w in WORDS])} AS severity, {_CASE(f"doc_id % {len(WORDS)}", [w[4] or "" for w in WORDS])} AS category,
                  ([{", ".join(str(w[5]) for w in WORDS)}])[doc_id % {len(WORDS)} + 1]::DOUBLE AS confidence, doc_id // {len(WORDS)} % {len(ENDS)} < 4 AS whole FROM documents
), r AS (SELECT *, regexp_replace(lower(shown), '\\.\\z', '') AS plain FROM d
), s AS (SELECT *, {_NOTHING} AS nothing FROM r
), t AS (SELECT *, CASE WHEN whole AND (nothing OR severity <> '' AND category <> '') THEN 'ok' ELSE 'invalid-response' END AS status FROM s)
SELECT doc_id, status, CASE WHEN status = 'ok' AND NOT nothing THEN severity END AS severity, CASE WHEN status = 'ok' AND NOT nothing THEN category END AS category,
       CASE WHEN status = 'ok' AND NOT nothing THEN confidence END AS confidence, CASE WHEN status = 'ok' AND NOT nothing THEN md5(shown) END AS rationale_md5 FROM t""",
}
