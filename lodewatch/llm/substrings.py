"""Passages that stand earlier in the corpus are removed, found by anchors at a difference cover.

A window is ``k`` consecutive words of a document; each word covered by a window that also starts earlier (in a document of
smaller id, or earlier in the same one) goes. Hashing all windows of a corpus would shuffle it several times over, so:

1. Anchors. Windows of ``w = k - period + 1`` words are hashed only at word places whose remainder by ``period`` is in a
   difference cover: for any two places there is a shift below the period that brings both into the cover. So any two
   equal windows of ``k`` words share an anchor at the same offset, wherever they start. With 13 and {0, 1, 3, 9}, 4 of 13
   places have an anchor of 8 words.
2. Anchors are counted by hash. One aggregate suffices, with no join and no gathering: the exclusive or of the places of a
   group is the place itself where the group has one member, and these, the anchors found nowhere else, go back to their
   documents. The others are repeated.
3. Extension. A window without a repeated anchor is found nowhere else. All others are hashed in full, with 128 bits, and
   an aggregate takes the first place of each. Documents whose whole text stands in an earlier one have no first place, so
   they take no part in this step.
4. A document's windows that were hashed and are no first place are removed.

Counting and taking the first combine on the map side, so a passage that a third of all documents hold is one row a task.
Texts move twice, to meet the places of their anchors and then of their first windows.

Defined cases: null and empty texts have no words and lose none; texts shorter than a window lose none; null ids come after
all others; rows of one id are in the order of a hash of their texts, and rows of one id and text are one document, judged
once; ties don't arise; an empty table gives no rows; a long text is held by one task, eight bytes a word; extra columns
are left alone unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, short_batches, staged
from .wordhash import SPACES, mixed, small_batches, word_hashes

WINDOW = 20
#: Perfect difference sets by their periods: every remainder is the difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

_SAME = np.arange(256, dtype=np.uint8)
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LAST_ID = (1 << 63) - 1


def cover_of(k: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of two fifths of a window, and its cover."""
    period = max(p for p in COVERS if p == 1 or 5 * (k - p + 1) >= 2 * k)
    return period, COVERS[period]


def window_hashes(words: np.ndarray, starts: np.ndarray, k: int, salt: np.uint64) -> np.ndarray:
    """Hashes of the windows of ``k`` words at these places."""
    out = np.full(len(starts), salt, np.uint64)
    for j in range(k):
        out = (out ^ words[starts + j]) * salt
        out ^= out >> np.uint64(32)
    return mixed(out)


def anchor_places(n: int, k: int) -> np.ndarray:
    period, cover = cover_of(k)
    places = np.arange(max(0, n - (k - period)))
    return places[np.isin(places % period, cover)]


def repeated_windows(n: int, k: int, unique: np.ndarray) -> np.ndarray:
    """The windows of a text of ``n`` words that have an anchor besides those in ``unique``."""
    if n < k:
        return np.zeros(0, np.int64)
    period, _ = cover_of(k)
    found = np.zeros(n + 1, np.int64)
    found[anchor_places(n, k) + 1] = 1
    found[unique + 1] = 0
    found = np.cumsum(found)
    starts = np.arange(n - k + 1)
    return starts[found[starts + period] > found[starts]]


def _lists(column: pa.Array) -> list[np.ndarray]:
    """A list column's numbers, row by row; null is none."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
    flat = column.flatten().to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def anchors(rows: DataFrame, k: int) -> DataFrame:
    """(h, k1, k2, at): the anchors of ``rows`` (k1, k2, text)."""
    period, _ = cover_of(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            words, bounds = word_hashes(batch.column(2), SPACES, _SAME)
            places = [anchor_places(int(n), k) for n in np.diff(bounds)]
            counts = [len(p) for p in places]
            at = np.concatenate([*places, np.zeros(0, np.int64)])
            starts = at + np.repeat(bounds[:-1], counts)
            h = window_hashes(words, starts, k - period + 1, _SALTS[0]).view(np.int64)
            keys = [np.repeat(batch.column(i).to_numpy(), counts) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(h), *map(pa.array, keys), pa.array(at.astype(np.int32))], ["h", "k1", "k2", "at"])

    return rows.mapInArrow(run, "h long, k1 long, k2 long, at int")


def full_windows(rows: DataFrame, k: int) -> DataFrame:
    """(h1, h2, k1, k2, at): the windows with a repeated anchor of ``rows`` (k1, k2, text, unique)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            words, bounds = word_hashes(batch.column(2), SPACES, _SAME)
            places = [repeated_windows(int(n), k, u) for n, u in zip(np.diff(bounds), _lists(batch.column(3)), strict=True)]
            counts = [len(p) for p in places]
            at = np.concatenate([*places, np.zeros(0, np.int64)])
            starts = at + np.repeat(bounds[:-1], counts)
            hashes = [window_hashes(words, starts, k, salt).view(np.int64) for salt in _SALTS]
            keys = [np.repeat(batch.column(i).to_numpy(), counts) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, [*hashes, *keys]), pa.array(at.astype(np.int32))], ["h1", "h2", "k1", "k2", "at"])

    return rows.mapInArrow(run, "h1 long, h2 long, k1 long, k2 long, at int")


def without_repeats(rows: DataFrame, k: int, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of ``rows`` (..., text, unique, first), the text of the words that stay and what was removed."""
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, n):
            texts, n_words, n_removed, spans = [], [], [], []
            for text, unique, first in zip(batch.column(n).to_pylist(), _lists(batch.column(n + 1)), _lists(batch.column(n + 2)), strict=True):
                words = text.encode("utf-8", "replace").split()  # at ASCII white space, as bytes are
                starts = repeated_windows(len(words), k, unique)
                starts = starts[~np.isin(starts, first)]
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + k, -1)
                gone = np.cumsum(cover)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).tolist()
                texts.append(b" ".join(compress(words, ~gone)).decode())
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            out = [pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *out], [*columns, "text", "n_words", "n_removed", "removed"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]]
    return rows.mapInArrow(run, ", ".join([*fields, "text string, n_words long, n_removed long, removed array<struct<start: int, end: int>>"]))


def _tie(rows: DataFrame) -> Column:
    """Tells rows of one id apart. Where each row has an id of its own, nothing is needed."""
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    return F.lit(0).cast("long") if shared.isEmpty() else F.xxhash64("text")


def _gathered(places: DataFrame, name: str, spark) -> DataFrame:
    """The places of each document, once more in a table of their own."""
    return staged(places.groupBy("k1", "k2").agg(F.collect_list("at").alias(name)), f"places-{name}")


def dedup_substrings(docs: DataFrame, k: int = WINDOW, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of each row of ``docs`` (doc_id, text), its ``text`` of the words that stay (one space between), ``n_words``
    before, ``n_removed`` and the spans ``removed`` (first word, word after the last)."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = pick(docs, *dict.fromkeys((*columns, "doc_id", "text"))).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    rows = rows.withColumns({"k1": F.coalesce("doc_id", F.lit(_LAST_ID)), "k2": _tie(rows)})
    texts, on = rows.select("k1", "k2", "text"), ["k1", "k2"]
    counted = anchors(texts, k).groupBy("h").agg(F.count("*").alias("n"), *[F.bit_xor(c).alias(c) for c in ("k1", "k2", "at")])
    unique = _gathered(counted.filter("n = 1"), "unique", spark)
    # of equal texts the first alone can hold first places
    leads = texts.groupBy(F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.min(F.struct("k1", "k2")).alias("key"))
    leads = staged(leads.select("key.*", F.lit(True).alias("leads")), "leads")
    known = texts.join(unique, on, "left").join(leads, on, "left_semi").select("k1", "k2", "text", "unique")
    first = full_windows(known, k).groupBy("h1", "h2").agg(F.min(F.struct("k1", "k2", "at")).alias("first"))
    first = _gathered(first.select("first.*"), "first", spark)
    every = rows.join(unique, on, "left").join(first, on, "left")
    return without_repeats(every.select(*columns, "text", "unique", "first"), k, columns)


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), x AS (
  SELECT doc_id, i, word, count(*) OVER p AS n, string_agg(word, ' ') OVER p AS w
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), r AS (
  SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY n, w ORDER BY doc_id, i) > 1 AS again FROM x
), g AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
), t AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""
