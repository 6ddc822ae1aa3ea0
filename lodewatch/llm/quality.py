"""Quality rules: word and line counts of a text, and lines that recur over the documents of a host.

Normalised lines (white space at the ends stripped, lower case, digits as 0) are hashed, and the distinct documents that
hold a line are counted per host. A line found in more than ``most_docs`` documents of a host, a number that doesn't grow
with the host, is removed from all of them; a document left with less than a share of its words is depleted and rejected.

All counting stays in built-in functions. The counts of a text are folded over arrays of its own words, with sorts
instead of look-ups, so long texts cost n log n.

Defined cases: null text has no words; null hosts are one host and null ids one document; an empty text fails the base rules; repeated rows are
judged one by one; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, pick, staged

SYMBOLS = "[#*$%&|<>]"
MOST_DOCS, REMAINDER = 20, 0.5


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), lambda w: w != "")


def window_places(items: Column, n: Column, k: int = 3) -> Column:
    """The starts of the ``k``-item windows of ``items`` found twice or more, ascending.

    Windows are sorted by hash, so equal ones are neighbours. Start and hash travel in one struct.
    """
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    at = lambda i, j: F.get(items, i + j)
    found = F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(*[at(i, j) for j in range(k)]).alias("h"), i.alias("i"))))
    return found


def repeat_places(sorted_windows: Column) -> Column:
    near = lambda i, j: F.get(sorted_windows, i + j)["h"] == F.get(sorted_windows, i)["h"]
    twice = F.filter(sorted_windows, lambda w, i: F.coalesce(near(i, -1), F.lit(False)) | F.coalesce(near(i, 1), F.lit(False)))
    return F.array_sort(F.transform(twice, lambda w: w["i"]))


def covered(places: Column, k: int = 3) -> Column:
    """How many items windows of ``k`` at these ascending places cover together."""
    steps = F.transform(places, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(places, i + 1) - p, F.lit(k))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))), "[0-9]", "0")


def measures(docs: DataFrame) -> DataFrame:
    """Each row's counts, its host and ``lines``: the hashes and words of its lines that have words."""
    rows = pick(docs, "doc_id", "text", "source").select("doc_id", F.col("source").cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"words": words(F.col("text")), "full_lines": F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE_CLASS}]")))})
    rows = rows.withColumns({"n": F.size("words"), "sorted": window_places(F.col("words"), F.size("words"))})
    rows = rows.withColumn("places", repeat_places(F.col("sorted")))
    line = lambda x: F.struct(
        F.xxhash64(normalised(x)).alias("h1"), F.xxhash64(F.lit(1), normalised(x)).alias("h2"), F.regexp_count(x, F.lit(f"[^{SPACE_CLASS}]+")).alias("words")
    )
    return rows.select(
        "doc_id", "host",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("places")).alias("n_repeat_words"),
        F.transform("full_lines", line).alias("lines"),
    )


def frequent_lines(rows: DataFrame, most_docs: int) -> DataFrame:
    """(host, h1, h2) of the lines found in more than ``most_docs`` documents of their host."""
    lines = rows.select("host", "doc_id", F.explode("lines").alias("line")).select("host", "doc_id", "line.h1", "line.h2").distinct()
    return lines.groupBy("host", "h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") > most_docs).select("host", "h1", "h2")


def judge(docs: DataFrame, most_docs: int = MOST_DOCS, remainder: float = REMAINDER) -> DataFrame:
    """Each row's counts, ``base_failed``, ``n_removed`` (words in removed lines) and ``kept``."""
    rows = staged(measures(docs).withColumn("rid", F.monotonically_increasing_id()), "measures")
    # written, so that adaptive execution may split a line that very many documents hold
    frequent = staged(frequent_lines(rows, most_docs), "frequent").withColumnsRenamed({"host": "f_host", "h1": "f_h1", "h2": "f_h2"})
    lines = rows.select("rid", "host", F.explode("lines").alias("line")).select("rid", "host", "line.*")
    on = F.col("host").eqNullSafe(F.col("f_host")) & (F.col("h1") == F.col("f_h1")) & (F.col("h2") == F.col("f_h2"))
    removed = lines.join(frequent, on).groupBy("rid").agg(F.sum("words").alias("n_removed"))
    rows = rows.join(removed, "rid", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed") < remainder * F.col("n_words")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *counts, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed")


def op8_line_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), w AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), t AS (
  SELECT doc_id, i, word, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n FROM t WHERE b IS NOT NULL AND c IS NOT NULL
), v AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, host, text, line, regexp_replace(lower(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[0-9]', '0', 'g') AS key,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), f AS (
  SELECT host, key FROM l GROUP BY host, key HAVING count(DISTINCT doc_id) > 20
), x AS (
  SELECT l.doc_id, count(*) - count(DISTINCT l.line) AS n_dup_lines, coalesce(sum(words) FILTER (f.key IS NOT NULL), 0) AS n_removed
  FROM l LEFT JOIN f ON l.key = f.key AND l.host IS NOT DISTINCT FROM f.host GROUP BY l.doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(x.n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(v.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(x.n_removed, 0)::BIGINT AS n_removed
  FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN v ON d.doc_id = v.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed >= 0.5 * n_words) AS kept, n_removed FROM m
"""
