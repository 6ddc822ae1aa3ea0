"""A training corpus from the table of documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents, extra columns are left out, whatever their names, and an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch.llm.common import DOC_COLUMNS, identity, pick, staged
from lodewatch.llm.linededup import dedup_lines
from lodewatch.llm.mixing import mix
from lodewatch.llm.neardup import near_duplicates
from lodewatch.llm.packing import pack, public_tokenizer
from lodewatch.llm.toxicity import score, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic.

    Null and empty texts are judged by the bias alone; repeated rows, and rows without an id, are judged one by one.
    Without a labelled row nothing is toxic.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, DOC_COLUMNS).filter("predicted = 0").select(*DOC_COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur in three or more of them; ``n_chars`` follows.

    Null text becomes empty; rows of one id are one document, rows without an id another one; the largest id keeps its lines.
    """
    cleaned = dedup_lines(docs, columns=DOC_COLUMNS)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*DOC_COLUMNS)


#: What the third stage calls near copies: texts whose sets of five-word shingles have a similarity of 0.8 or more.
NEAR = {"k": 5, "percent": 80, "band": 4}


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least id. Of rows repeated with id and text one stays.

    Rows go by id and text together: an id that stands for several texts, or a null one, keeps only the rows chosen. Null
    and empty texts are linked with nothing.
    """
    rows = pick(docs, *DOC_COLUMNS).withColumn("row_key", identity("doc_id", "text"))
    found = staged(near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text"), **NEAR), "near")
    ids = rows.groupBy("row_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    ids = staged(found.select(F.col("doc_id").alias("row_key"), "component_id").distinct().join(ids, "row_key"), "near-ids")
    first = F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    chosen = ids.groupBy("component_id").agg(first.alias("row_key")).select("row_key")
    again = not ids.filter("n > 1").isEmpty()
    rows = rows.join(chosen, "row_key", "left_semi")
    return (rows.dropDuplicates(["row_key"]) if again else rows).select(*DOC_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for.

    A null source is one of its own; null and empty texts have size 0 and come along as the sample falls; repeated rows
    are documents of their own.
    """
    return mix(pick(docs, *DOC_COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids.

    Null and empty texts are an end mark alone; long ones are cut; repeated rows and rows without an id are packed one by one.
    """
    return pack(docs, public_tokenizer(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Sketches, a trained classifier and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nr, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if nr < len(STAGES):
            docs = staged(docs, f"stage-{nr}")
    return docs
