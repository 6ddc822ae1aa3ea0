"""Source divergence audit: how far the sources of a language lie apart in the words that they use.

Two passes over the texts. The first counts exactly in how many documents of its language each term stands, and terms of
``least_docs`` documents or more are kept. The second runs an Aho-Corasick automaton of the kept terms, each padded with
delimiters, over texts whose separators are all one delimiter, and recounts every occurrence by language and source. What
it finds are sparse postings (language, source, term, count); a term that a source lacks has no row.

Probabilities are whole numbers (counts smoothed by 5, in parts of 10**9), so sums are exact in any order. The distance of
two sources is the sum of their differences over all kept terms. It is summed in blocks of ``TILE`` by ``TILE`` sources and
about ``BLOCK_TERMS`` terms: a block is a dense matrix in which a missing posting has its source's least probability, and
terms that no source of a block has are added at the end, as all differ by the same. So what a task holds doesn't grow
with the sources of a language, its terms or its documents.

The automaton is broadcast in shards of at most ``SHARD_TERMS`` terms and ``SHARD_BYTES`` bytes, or one longer term; more terms take more
passes over the texts, not more memory.

Defined cases: null text, language and source are empty strings; a repeated row is a document of its own; a group without
kept terms has only smoothed counts; a language without kept terms has distances of 0 and no term rows; ties go by the
UTF-8 order of items; an empty table gives no rows; long texts are streamed; extra columns are left alone.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, pick, short_batches, staged
from .wordhash import small_batches

LEAST_DOCS, SMOOTHING, SCALE, TOP_TERMS = 30, 5, 10**9, 50
#: What one broadcast automaton holds.
SHARD_TERMS, SHARD_BYTES = 200_000, 8 << 20
#: Postings that a task holds before it hands on what it has counted.
HELD = 500_000
#: Sources and terms of a block.
TILE, BLOCK_TERMS = 64, 4096

#: ASCII but for letters ends a term.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grouped_rows(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return pick(docs, "lang", "source", "text").select(text("lang"), text("source"), text("text"))


def terms_of(text: Column) -> Column:
    return F.split(F.btrim(F.regexp_replace(ascii_lower(text), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", " ")), " ")


def kept_terms(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs): the terms found in at least ``least_docs`` documents of their language."""
    found = rows.select("lang", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).filter("term <> ''")
    return found.groupBy("lang", "term").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least_docs)


@dataclass(frozen=True)
class Shard:
    """Terms by number, and the numbers that each language keeps."""

    key: str
    terms: tuple[str, ...]
    kept: dict[str, np.ndarray]


_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton(shard: Shard) -> ahocorasick.Automaton:
    """The shard's automaton, built once for each Python worker, which keeps the last one only."""
    if shard.key not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for nr, term in enumerate(shard.terms):
            found.add_word(f" {term} ", nr)
        if shard.terms:
            found.make_automaton()
        _BUILT[shard.key] = found
    return _BUILT[shard.key]


def padded(text: str) -> str:
    """Lower-cased terms between single delimiters or several, one at each end."""
    return f" {text.encode('utf-8', 'replace').translate(_TABLE).decode()} "


def recounted(rows: DataFrame, shard: Shard) -> DataFrame:
    """(lang, source, nr, n): how often the shard's terms occur, counted by task."""
    shared = rows.sparkSession.sparkContext.broadcast(shard)
    number = itemgetter(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        search = automaton(own)
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                nr = np.fromiter(found.keys(), np.int32, len(found))
                n = np.fromiter(found.values(), np.int64, len(found))
                on = np.isin(nr, own.kept.get(lang, ()))
                size = int(on.sum())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(nr[on]), pa.array(n[on])], ["lang", "source", "nr", "n"])

        for batch in small_batches(batches, 2):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if lang in own.kept:
                    counts[lang, source].update(map(number, search.iter(padded(text))))
            if sum(map(len, counts.values())) > HELD:
                yield from handed_on()
                counts.clear()
        yield from handed_on()

    return rows.mapInArrow(run, "lang string, source string, nr int, n long").groupBy("lang", "source", "nr").agg(F.sum("n").alias("n"))


def shard_count(kept: DataFrame, shard_terms: int, shard_bytes: int) -> int:
    """Into how many shards terms are dealt by hash so that none is over the bounds, unless it is of one term."""
    terms = kept.groupBy("term").agg(F.octet_length("term").alias("bytes"))
    n, size = terms.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = max(1, -(-n // shard_terms), -(-size // shard_bytes))
    while True:
        dealt = terms.groupBy(F.pmod(F.xxhash64("term"), F.lit(shards))).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        if dealt.filter((F.col("n") > 1) & ((F.col("n") > shard_terms) | (F.col("bytes") > shard_bytes))).isEmpty():
            return shards
        shards *= 2


def postings(rows: DataFrame, kept: DataFrame, shard_terms: int = SHARD_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, source, term, n) of all kept terms that occur; ``kept`` is a written table."""
    spark = rows.sparkSession
    short_batches(spark)
    shards = shard_count(kept, shard_terms, shard_bytes)
    parts = []
    for k in range(shards):
        own = kept.filter(F.pmod(F.xxhash64("term"), F.lit(shards)) == k).select("lang", "term").toPandas()  # bounded as SHARD_TERMS says
        terms = sorted(set(own["term"]))
        number = {t: i for i, t in enumerate(terms)}
        shard = Shard(uuid.uuid4().hex, tuple(terms), {lang: np.array(sorted(number[t] for t in x["term"]), np.int32) for lang, x in own.groupby("lang")})
        names = spark.createDataFrame(pd.DataFrame({"nr": range(len(terms)), "term": terms}), "nr int, term string")
        parts.append(staged(recounted(rows, shard).join(F.broadcast(names), "nr").select("lang", "source", "term", "n"), "postings"))
    return reduce(DataFrame.unionAll, parts)


def statistics(rows: DataFrame, kept: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, v, least, tile, tiles, blocks): what each group, with or without terms, is measured by."""
    groups = rows.select("lang", "source").distinct()
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    out = groups.join(langs, "lang").withColumns({"tiles": F.ceil(F.col("sources") / TILE).cast("int"), "blocks": F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int")})
    return out.withColumns({"tile": F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"), "least": probability(F.lit(0), F.col("total"), F.col("v"))}).drop("sources")


def probability(n: Column, total: Column, v: Column) -> Column:
    """Smoothed and scaled, rounded down to a whole number, plus one; null without kept terms."""
    n, whole = (n.cast("decimal(19,0)") + SMOOTHING), (total.cast("decimal(19,0)") + SMOOTHING * v)
    return F.when(v > 0, F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * n, whole) + 1)


def distances(found: DataFrame, stats: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each two sources of a language, both ways."""
    fields = ["lang", "source", "tile", "tiles", "blocks", "v", "least"]
    rows = found.join(stats, ["lang", "source"]).select(*fields, "term", probability(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    there = stats.select(*fields, F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = rows.unionByName(there).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("lang", "block", F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("two"), "tile", "source", "term", "p", "least", "v")

    def block(own: pd.DataFrame) -> pd.DataFrame:
        present = own[own["term"].isna()].drop_duplicates("source").sort_values("source")
        names = present["source"].to_numpy()
        least = np.array([0 if pd.isna(x) else int(x) for x in present["least"]], np.int64)
        held = own[own["term"].notna()]
        column, terms = pd.factorize(held["term"])
        values = np.repeat(least[:, None], len(terms), axis=1)
        values[pd.Index(names).get_indexer(held["source"]), column] = held["p"].to_numpy(np.int64)
        tile, (one, two) = present["tile"].to_numpy(), (own["one"].iloc[0], own["two"].iloc[0])
        out = []
        for s in range(len(names)):
            others = (tile != tile[s]) if one != two else np.arange(len(names)) != s
            out.append(pd.DataFrame({"source": names[s], "item": names[others], "value": np.abs(values[others] - values[s]).sum(axis=1), "apart": np.abs(least[others] - least[s])}))
        table = pd.concat(out, ignore_index=True)
        return table.assign(lang=own["lang"].iloc[0], terms=len(terms), v=own["v"].iloc[0])[["lang", "source", "item", "value", "apart", "terms", "v"]]

    parts = rows.groupBy("lang", "block", "one", "two").applyInPandas(block, "lang string, source string, item string, value long, apart long, terms long, v long")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"), F.first("apart").alias("apart"), F.first("v").alias("v"))
    return summed.select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("terms")) * F.col("apart")).alias("value"))


def leading_terms(found: DataFrame, stats: DataFrame) -> DataFrame:
    """(lang, source, item, value): kept terms that a source uses more often than its language does."""
    of_lang = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    rows = found.join(of_lang, ["lang", "term"]).join(stats, ["lang", "source"])
    value = probability(F.col("n"), F.col("total"), F.col("v")) - probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    return rows.select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by distance, and the terms that mark a source."""
    rows = grouped_rows(docs)
    kept = staged(kept_terms(rows, least_docs), "kept-terms")
    found = postings(rows, kept)
    stats = staged(statistics(rows, kept, found), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda part, df: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked("pair", distances(found, stats)).unionByName(ranked("term", leading_terms(found, stats)).filter(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (
  SELECT nr, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term FROM (SELECT DISTINCT nr, lang, term FROM t) GROUP BY lang, term HAVING count(*) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM f
), l AS (
  SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM l
), v AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
