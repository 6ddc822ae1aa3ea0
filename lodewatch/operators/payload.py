"""What a model is given of a target: excerpts at its findings and its files, cut to a budget of characters.

Excerpts take at most half of the budget. What an excerpt may take depends only on what those before it are long, so a
running sum over the findings of a target suffices. What a file may take depends on what those before it really took,
secrets hidden; so the files of a target are folded in order. Only ``MOST_FILES`` files of a target are listed, each with at
most ``MOST_CHARS`` times four bytes, so what is folded is bounded however large a target is; the others are counted.

Defined cases: null content is a file that can't be read and isn't sent; a file with a NUL character in what would be sent is
binary; an empty file is complete; ties don't arise, as paths are unique in a target (repeated rows count once); characters
are code points; secrets are hidden before the cut, so that none is cut in two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redacted

# fixed values: budgets in characters, and how many files are listed
DEFAULT_TOKENS, LEAST_BUDGET, MOST_BUDGET = 2048, 2_000, 16_000
MOST_SNIPPET, MOST_CHARS, MOST_FILES, CHAR_BYTES = 1_200, 4_000, 50, 4
LINES_BEFORE, LINES_BEHIND = 2, 2


def budget_of(tokens: Column) -> Column:
    """Characters for a model of so many tokens; null stands for the default."""
    return F.least(F.lit(MOST_BUDGET), F.greatest(F.lit(LEAST_BUDGET), F.coalesce(tokens, F.lit(DEFAULT_TOKENS)) * 4))


def excerpts(findings: DataFrame, files: DataFrame, budget: int) -> DataFrame:
    """(target_id, nr, path, content) of ``findings`` (target_id, nr, path, line, snippet): the lines around each, as far as ``budget`` goes.

    ``nr`` is the order of a target's findings. Findings behind the one that uses the budget up have no excerpt.
    """
    rows = findings.join(files.select("target_id", "path", F.col("content").alias("whole")).dropDuplicates(["target_id", "path"]), ["target_id", "path"], "left")
    lines = F.split("whole", "\n")
    first = F.greatest(F.col("line") - LINES_BEFORE, F.lit(1))
    around = F.array_join(F.slice(lines, first, F.greatest(F.col("line") + LINES_BEHIND - first + 1, F.lit(0))), "\n")
    text = F.when(F.col("whole").isNull(), F.substring(redacted(F.col("snippet")), 1, MOST_SNIPPET)).otherwise(redacted(F.substring(around, 1, MOST_SNIPPET)))
    rows = rows.select("target_id", "nr", "path", text.alias("text"))
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("target_id").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", budget - before).filter(F.col("left") > 0)
    return rows.select("target_id", "nr", "path", F.expr(f"substring(text, 1, int(least(left, {MOST_SNIPPET})))").alias("content"))


def _prefix(content: Column, chars: Column) -> Column:
    """As many bytes as so many characters may take, made whole at the end."""
    return F.call_function("make_valid_utf8", F.substring(content.cast("binary"), F.lit(1), chars * CHAR_BYTES).cast("string"))


def sent_files(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, nr, path, status, content, not_listed) of ``files`` (target_id, path, content).

    ``targets`` has target_id, entry (the path of its first file, or null) and budget. ``status`` is complete, truncated,
    binary or not-sent; ``not_listed`` counts the target's other files.
    """
    rows = files.select("target_id", "path", "content").dropDuplicates(["target_id", "path"]).join(targets, "target_id")
    order = Window.partitionBy("target_id").orderBy(~F.coalesce(F.col("path") == F.col("entry"), F.lit(False)), "path")
    rows = rows.withColumn("nr", F.row_number().over(order))
    total = files.select("target_id", "path").distinct().groupBy("target_id").agg(F.count("*").alias("n"))
    size = F.octet_length("content")
    # no more than the largest share is carried along
    kept = F.struct("nr", "path", F.substring(F.col("content").cast("binary"), 1, MOST_CHARS * CHAR_BYTES).alias("bytes"), size.alias("size"))
    listed = rows.filter(F.col("nr") <= MOST_FILES).groupBy("target_id").agg(F.array_sort(F.collect_list(kept)).alias("files"), F.first("budget").alias("budget"))
    sent_type = "array<struct<nr: int, path: string, status: string, content: string>>"

    def step(a: Column, f: Column) -> Column:
        most = F.least(F.lit(MOST_CHARS), a["left"])
        # bound in an array, so that the text is made and redacted once
        bound = F.transform(F.array(_prefix(f["bytes"].cast("string"), most)), lambda text: F.struct(F.contains(text, F.lit("\u0000")).alias("binary"), redacted(text).alias("text")))
        known = F.transform(bound, lambda b: F.when((most <= 0) | f["bytes"].isNull(), F.struct(F.lit("not-sent").alias("status"), F.lit("").alias("content"))).when(b["binary"], F.struct(F.lit("binary").alias("status"), F.lit("").alias("content"))).otherwise(
            F.struct(F.when((f["size"] <= most * CHAR_BYTES) & (F.length(b["text"]) <= most), "complete").otherwise("truncated").alias("status"), F.substring(b["text"], F.lit(1), most).alias("content"))))
        out = F.get(known, F.lit(0))
        one = F.struct(f["nr"].alias("nr"), f["path"].alias("path"), out["status"].alias("status"), out["content"].alias("content"))
        return F.struct((a["left"] - F.length(out["content"])).alias("left"), F.concat(a["sent"], F.array(one)).alias("sent"))

    start = F.struct(F.col("budget").cast("int").alias("left"), F.array().cast(sent_type).alias("sent"))
    folded = listed.select("target_id", F.explode(F.aggregate("files", start, step, lambda a: a["sent"])).alias("x"))
    return folded.select("target_id", "x.*").join(total, "target_id").withColumn("not_listed", F.greatest(F.col("n") - MOST_FILES, F.lit(0))).drop("n")
