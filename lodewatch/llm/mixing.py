"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document of the source is expected ``target / source_size`` times.
These expectations are summed along an order of the source's documents, one random offset is added, and a document
is emitted once for each integer boundary that its share of the sum crosses. So its copies are the floor or the
ceiling of the expectation, and along an order by size the taken words stay near the target.

The order is (size class, salt, size, id). A salt splits size classes that hold many rows, so no task gets a
whole source: positions are counted inside a (source, class, salt) cell, and cells are summed in two small steps.

Defined cases: null text has size 0; a null source is one source of its own, last in order; documents of size 0
are emitted like others but take no words; repeated rows are documents of their own; an empty table gives no rows;
extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, staged, word_count

#: Rows of one size class that share a salt, about; and the least number of salts.
ROWS_PER_SALT, LEAST_SALTS = 100_000, 64


def source_targets(sizes: DataFrame, cycle: int = 3, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) of each source of ``sizes`` (source, size).

    Sources by code point, null last, weigh 1 to ``cycle``, repeating, and share all words by weight. A target stops
    at ``cap`` times the source's size and the excess is shared again by weight. In closed form: with sources ordered
    by size over weight, the first ones are capped, and the rest share what is left at one level per unit of weight.
    The table has a row for each source, so its windows stay small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_ratio = Window.orderBy("ratio", "nr")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("nr", F.row_number().over(by_name)).withColumn("weight", ((F.col("nr") - 1) % cycle + 1).cast("double"))
    per = per.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    everything, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "capped": F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "heavy": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # the level that holds if this source and all after it are not capped; it rises up to the first source that it
    # doesn't cap, where it is right, and falls from there on
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("heavy"))
    per = per.withColumn("target", F.least("most", F.col("weight") * F.max("level").over(everything)))
    return per.select("source", F.col("source_size").cast("long").alias("source_size"), "target")


def sample(docs: DataFrame, seed: int = 17, cycle: int = 3, cap: float = 3.0) -> DataFrame:
    """(doc_id, content, source, size, source_size, target, copies) of each row of ``docs`` (doc_id, text, source)."""
    base = pick(docs, "doc_id", "text", "source")
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))  # a key that is never null
    base = base.select("doc_id", "source", named.alias("named"), F.xxhash64("text").alias("content"), word_count(F.col("text")).alias("size"))
    base = staged(base, "mix-sizes")
    salts = max(LEAST_SALTS, base.count() // ROWS_PER_SALT)
    cell = ["named", "class", "salt"]
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bits = F.length(F.bin("size"))
    base = base.withColumns({
        # a class for each value of the four leading bits of the size
        "class": bits * 100 + F.expr("size div cast(pow(2, greatest(length(bin(size)) - 4, 0)) as bigint)").cast("int"),
        "salt": (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % salts).cast("int"),
    })
    targets = source_targets(base.select("source", "size"), cycle, cap)
    targets = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("named"), "source_size", "target")
    running = lambda part, order: F.sum("n").over(Window.partitionBy(*part).orderBy(order)) - F.col("n")
    cells = base.groupBy(*cell).agg(F.count("*").alias("n"))
    classes = cells.groupBy("named", "class").agg(F.sum("n").alias("n")).withColumn("class_start", running(["named"], "class")).drop("n")
    cells = cells.withColumn("cell_start", running(["named", "class"], "salt")).drop("n")
    starts = cells.join(classes, ["named", "class"]).join(targets, "named")
    ordered = base.withColumn("place", F.row_number().over(Window.partitionBy(*cell).orderBy("size", F.col("doc_id").asc_nulls_first(), "content")))
    rows = ordered.join(starts, cell)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\u0000null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    end = F.col("class_start") + F.col("cell_start") + F.col("place")
    copies = F.floor(end * expected + offset) - F.floor((end - 1) * expected + offset)
    return rows.select("doc_id", "content", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 17, cycle: int = 3, cap: float = 3.0) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the sample takes it, with its columns.

    Rows that agree in id, source and text are told apart by a position among themselves.
    """
    key = ["doc_id", "source", "content"]
    taken = sample(docs, seed, cycle, cap)
    totals = taken.groupBy(*key).agg(F.sum("copies").alias("lw_copies"), F.count("*").alias("lw_rows"))
    chosen = totals.filter("lw_copies > 0")
    own = docs.columns
    rows = docs.withColumn("lw_content", F.xxhash64("text"))
    on = rows["doc_id"].eqNullSafe(chosen["doc_id"]) & rows["source"].eqNullSafe(chosen["source"]) & (rows["lw_content"] == chosen["content"])
    rows = rows.join(chosen.hint("shuffle_hash"), on).select(*[rows[c] for c in own], "lw_content", "lw_copies", "lw_rows")
    single = rows.filter("lw_rows = 1").withColumn("lw_n", F.col("lw_copies"))
    among = F.row_number().over(Window.partitionBy("doc_id", "source", "lw_content").orderBy(F.lit(0)))
    several = rows.filter("lw_rows > 1").withColumn("lw_n", F.expr("lw_copies div lw_rows") + (among <= F.col("lw_copies") % F.col("lw_rows")).cast("long"))
    every = single.unionByName(several).filter("lw_n > 0")
    return every.withColumn("lw_n", F.explode(F.sequence(F.lit(1).cast("long"), "lw_n"))).select(*own)


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    rows = sample(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY (source IS NULL), source::BLOB) AS nr FROM d GROUP BY source
), w AS (
  SELECT *, ((nr - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most,
         (3.0::DOUBLE * source_size) / ((nr - 1) % 3 + 1)::DOUBLE AS ratio FROM per
), l AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(most) OVER (ORDER BY ratio, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS heavy
  FROM w
), m AS (SELECT *, (total - capped) / heavy AS level FROM l
), t AS (
  SELECT source, source_size, least(most, weight * (max(level) OVER ())) AS target FROM m
), b AS (
  SELECT d.*, length(bin(size)) * 100 + size // (1 << greatest(length(bin(size)) - 4, 0)) AS class,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % greatest(64, (SELECT count(*) FROM d) // 100000) AS salt FROM d
), o AS (
  SELECT b.*, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id NULLS FIRST) AS place FROM b
), e AS (
  SELECT o.doc_id, o.size, t.source_size, t.target, o.source, o.place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS expected,
         ('0x' || substr(md5('17:' || coalesce(o.source, chr(0) || 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (floor(place * expected + u) - floor((place - 1) * expected + u))::BIGINT AS copies FROM e
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies, source FROM c
"""
