"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import scratch_path, scratch_root, staged

__all__ = ["ascii_lower", "identity", "pick", "purge_scratch", "scratch_path", "short_batches", "staged", "word_count"]

#: ASCII white space, as a Java and RE2 character class and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get at most so many rows in one batch from now on: texts are long, and two copies are held."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def purge_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table under the session's folder; results not yet written are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/lodewatch")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, taken by exact name and first position.

    Extra columns whose names clash with these (twice, in other case, or with dots) can't make a name ambiguous.
    A missing column reads as null.
    """
    place = {}
    for i, c in enumerate(df.columns):
        place.setdefault(c, i)
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{place[n]}").alias(n) if n in place else F.lit(None).alias(n) for n in names])


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; the quick built-in serves where the text has no other letters to touch."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def identity(*columns: Column) -> Column:
    """64 bits that tell rows of one id apart by their content."""
    return F.xxhash64(*columns)


#: The columns of the table of documents.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
