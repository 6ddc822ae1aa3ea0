"""Filter interaction audit: what each filter of a chain removes, alone and beside the others, by inclusion and exclusion.

Each document has a flag for every filter that it fails. For each of the 32 sets S of filters, ``N(S)`` counts the
documents that fail all of S, as the sum of the product of their flags. All else follows from these counts for a part:

- survivors of a set T: the Möbius sum over S within T of ``(-1)**|S| * N(S)``;
- what a filter removes at a step: survivors before it less survivors after it; what is redundant: ``N({f})`` less that;
- unique failures of f: survivors of all others less survivors of all;
- Harsanyi dividends of the game "documents removed by T" are ``(-1)**(|S|+1) * N(S)``, and a filter's Shapley value is the
  sum of ``dividend / |S|`` over the sets that hold it. Over 120 orders that is a whole number.

So orders are never simulated, and the 120 orders cost nothing but their rows of output.

Texts are read once and leave the scan as a SHA-256 digest and flags. Copies are found without a join: rows are counted by
digest and part with the first id of each, and a window over these counts, one row a part, tells which id is the first of
the table. Equal texts meet on the map side before each shuffle, so one that a third of all rows hold is a few rows.

Defined cases: null text is empty and fails A alone (or E as well); a null part is the empty string; null ids come after
all others, and rows of one text and one id are not copies of each other; each repeated row counts; an id labelled twice is
good or toxic if one label says so; null labels say nothing; an empty table gives no rows; long texts cost time in
proportion to their words; extra columns are left alone.
"""

from __future__ import annotations

import json
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, pick, staged

FILTERS = "ABCDE"
#: All sets of filters, as strings in order of letters.
SETS = tuple("".join(c) for k in range(len(FILTERS) + 1) for c in combinations(FILTERS, k))
MEASURES = ("n", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails the filters A to D, by letter."""
    # without conditions around them, so that the words are made once for both counts
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    words, none = F.split(trimmed, f"[{SPACE_CLASS}]+"), (trimmed == "").cast("int")
    n_words, distinct = F.size(words) - none, F.size(F.array_distinct(words)) - none
    return {
        "A": n_words < 200,
        "B": 100 * distinct.cast("long") < 50 * n_words.cast("long"),
        "C": 100 * (F.size(F.split(text, "[A-Z]")) - 1).cast("long") > 3 * F.length(text).cast("long"),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def counted(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, A, B, C, D, n, good, toxic, copies): the documents of one text and part, by what they fail.

    ``n``, ``good`` and ``toxic`` count all of them; ``copies`` has the same counts of those that fail E.
    """
    rows = pick(docs, "doc_id", "text", part).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    text = ["digest", "part", "A", "B", "C", "D"]
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "part", *[x.cast("int").alias(k) for k, x in failures(F.col("text")).items()])
    # rows of one id and text stand or fall together
    rows = rows.groupBy("doc_id", *text).agg(F.count("*").alias("rows"))
    marks = pick(labels, "doc_id", "quality", "toxic").filter("doc_id IS NOT NULL")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("l_key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("l_good"), F.max((F.col("toxic") == 1).cast("int")).alias("l_toxic"))
    # rows without an id are dealt by their text and meet no label
    unnamed = F.col("doc_id").isNull()
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.xxhash64("digest")), "unnamed": unnamed})
    marks = marks.withColumn("l_unnamed", F.lit(False))
    rows = rows.join(marks, (F.col("key") == F.col("l_key")) & (F.col("unnamed") == F.col("l_unnamed")), "left")
    weights = {"n": F.col("rows"), "good": F.col("rows") * F.coalesce("l_good", F.lit(0)), "toxic": F.col("rows") * F.coalesce("l_toxic", F.lit(0))}
    rows = rows.select("doc_id", *text, *[w.cast("long").alias(k) for k, w in weights.items()])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), *MEASURES)).alias("first")
    texts = rows.groupBy(*text).agg(*[F.sum(m).alias(m) for m in MEASURES], first)
    order = F.struct("first.last", "first.id")
    leads = order == F.min(order).over(Window.partitionBy("digest"))
    copies = F.struct(*[(F.col(m) - F.when(leads, F.col(f"first.{m}")).otherwise(F.lit(0))).alias(m) for m in MEASURES])
    return texts.select("part", "A", "B", "C", "D", *MEASURES, copies.alias("copies"))


def joint_failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, n, good, toxic): for each part the counts ``N(S)`` of all sets of filters, as arrays in the order of ``SETS``."""
    def total(s: str, measure: str) -> Column:
        weight = F.col(f"copies.{measure}") if "E" in s else F.col(measure)
        for f in s.replace("E", ""):
            weight = weight * F.col(f)
        return F.sum(weight).alias(f"{measure}{s}")

    sums = counted(docs, labels, part).groupBy("part").agg(*[total(s, m) for m in MEASURES for s in SETS])
    return sums.select("part", *[F.array(*[F.col(f"{m}{s}") for s in SETS]).alias(m) for m in MEASURES])


def _weighed(counts: Column, weights: list[list[int]]) -> Column:
    """For each list of weights the sum of the counts times them."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<array<long>>")
    return F.transform(table, lambda own: F.aggregate(F.zip_with(own, counts, lambda w, n: w * n), F.lit(0).cast("long"), lambda a, x: a + x))


def survivors(counts: Column) -> Column:
    """How many documents fail none of a set, for all sets in the order of ``SETS``: the Möbius inversion of ``N``."""
    return _weighed(counts, [[(-1) ** len(s) if set(s) <= set(t) else 0 for s in SETS] for t in SETS])


def shapley(counts: Column) -> Column:
    """Each filter's Shapley value times 120: dividends shared equally among the members of their sets."""
    return _weighed(counts, [[(-1) ** (len(s) + 1) * 120 // len(s) if f in s else 0 for s in SETS] for f in FILTERS])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    found = staged(joint_failures(docs, labels, part), "joint-failures")
    found = found.select("part", F.col("n").alias("failures"), shapley(F.col("n")).alias("shapley"), *[survivors(F.col(m)).alias(m) for m in MEASURES])
    place = {frozenset(s): i for i, s in enumerate(SETS)}
    full = frozenset(FILTERS)
    names = ("filter_order", "step", "f", "alone", "others", "before", "after")
    steps = [
        (order, k + 1, FILTERS.index(f), place[frozenset(f)], place[full - {f}], place[frozenset(order[:k])], place[frozenset(order[: k + 1])])
        for order in map("".join, permutations(FILTERS)) for k, f in enumerate(order)
    ]
    table = F.from_json(F.lit(json.dumps([dict(zip(names, s, strict=True)) for s in steps])), "array<struct<filter_order: string, step: int, f: int, alone: int, others: int, before: int, after: int>>")
    rows = found.select("*", F.explode(table).alias("at")).select(*found.columns, "at.*")
    lost = lambda m: F.get(m, F.col("before")) - F.get(m, F.col("after"))
    return rows.select(
        "part", "filter_order", "step",
        F.get("n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (F.get("failures", F.col("alone")) - lost("n")).alias("redundant"),
        (F.get("n", F.col("others")) - F.get("n", F.lit(len(SETS) - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("f")).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Simulates every order step by step over the documents' flags, counted by part and flags.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text),
                regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails,
         coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM d LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM o
), r AS (
  SELECT c.*, s.*, fails[ascii(filter_order[step]) - 64] AS here,
         len(list_filter(range(1, step), lambda i: fails[ascii(filter_order[i]) - 64])) > 0 AS gone,
         len(list_filter(fails, lambda z: z)) = 1 AS alone
  FROM c, s
), t AS (
  SELECT part, filter_order, step, filter_order[step] AS f, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (here AND alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM t
"""
