"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case, hashed to 128 bits. Keys come
in batches of documents. Each batch is summed up to one row a key and merge-anti-joined with the runs so far: its new
keys are added as a run of their own, and what it says of known keys goes to a change table. When a level holds
``fan_out`` runs they are merged into one of the next level, so no key stands in two runs.

Runs are bucketed tables with one file a bucket, sorted by key. They are read in that order, so an anti-join is a merge
of sorted files: nothing is shuffled, and of its two sides only what the batch itself adds is sorted. A list of the runs
lies beside them, written anew for each batch; ``LineRuns.open`` takes it up again, in another session too.

A key found in at least ``min_docs`` documents is surplus: its lines go from all documents but the one of the largest id.

Defined cases: null or empty text is one empty line; a null id reads as the least long; rows that share an id are one
document, and each row is cleaned by itself; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, scratch_path, short_batches, staged

KEY = ["h1", "h2"]
BATCHES, FAN_OUT = 4, 3
LEAST_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16 bytes of a line's key, or None if it is shorter than ``min_chars`` code points."""
    key = line.strip().lower()  # of bytes: ASCII alone
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, h1, h2) of each distinct key of each row."""

    short_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {line_key(x, min_chars) for x in (text.as_py() or "").encode().split(b"\n")}
                own.discard(None)
                keys.extend(own)
                ids.extend([LEAST_ID if name is None else name] * len(own))
            both = pa.Array.from_buffers(pa.int64(), 2 * len(keys), [None, pa.py_buffer(b"".join(keys))])
            pairs = both.to_numpy().reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", *KEY])

    return pick(docs, "doc_id", "text").mapInArrow(run, "id long, h1 long, h2 long")


#: Sorted buckets of one file each are read as sorted. A union of bucketed scans must not count as bucketed: Spark 4.1
#: appends the partitions of columnar scans, and then groups in each of them alone.
IN_ORDER = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}


@contextmanager
def read_in_order(spark: SparkSession) -> Iterator[None]:
    """Settings for the jobs that run meanwhile."""
    before = {name: spark.conf.get(name, None) for name in IN_ORDER}
    for name, value in IN_ORDER.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


COLUMNS = "h1 BIGINT, h2 BIGINT, n BIGINT, last BIGINT"


@dataclass
class LineRuns:
    """Levelled sorted runs of (key, n documents, last id), and the changes to them that later batches bring.

    ``levels`` holds the paths of the runs, ``changes`` those of the change tables, ``buckets`` how many each has.
    """

    spark: SparkSession
    root: str
    buckets: int
    fan_out: int = FAN_OUT
    levels: list[list[str]] = field(default_factory=list)
    changes: list[str] = field(default_factory=list)

    @classmethod
    def new(cls, spark: SparkSession, root: str | None = None, fan_out: int = FAN_OUT) -> LineRuns:
        return cls(spark, root or scratch_path(spark, "line-runs"), int(spark.conf.get("spark.sql.shuffle.partitions")), fan_out)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> LineRuns:
        """The runs that were left at ``root``, as of the last batch that was added whole."""
        lists = spark.read.schema("batch long, state string").json(f"{root}/lists")
        state = json.loads(lists.orderBy(F.desc("batch")).first()["state"])
        return cls(spark, root, **state)

    def _save(self) -> None:
        batch = len(self.changes) + sum(map(len, self.levels)) + time.time_ns()
        state = json.dumps({"buckets": self.buckets, "fan_out": self.fan_out, "levels": self.levels, "changes": self.changes})
        self.spark.createDataFrame([(batch, state)], "batch long, state string").coalesce(1).write.mode("append").json(f"{self.root}/lists")

    def _write(self, rows: DataFrame, name: str) -> str:
        """One file a bucket: ``rows`` must be partitioned by key into the buckets."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        table = path.rpartition("/")[2].replace("-", "_")
        with read_in_order(self.spark):
            rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the name alone; files at a path of their own stay
        return path

    def _read(self, path: str) -> DataFrame:
        """The table at ``path``, known to be bucketed and sorted. Its name is needed only until it is resolved."""
        table = f"opened_{uuid.uuid4().hex}"
        keys = ", ".join(KEY)
        self.spark.sql(f"CREATE TABLE {table} ({COLUMNS}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        out = self.spark.table(table)
        out.schema  # noqa: B018  resolved before the name goes
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _unknown(self, own: DataFrame, known: list[str]) -> DataFrame:
        for run in known:
            own = own.hint("merge").join(self._read(run).select(*KEY), KEY, "left_anti")
        return own

    def add(self, keys: DataFrame) -> None:
        """One batch: ``keys`` has a row (id, key) for each distinct key of each document."""
        own = keys.groupBy(*KEY).agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"))
        own = self._write(own.repartition(self.buckets, *KEY), "batch")
        fresh = own
        if known := self.runs():
            fresh = self._write(self._unknown(self._read(own), known), "run")
            self.changes.append(self._write(self._unknown(self._read(own), [fresh]), "change"))
        self._push(fresh, 0)
        self._save()

    def _push(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            merged = reduce(DataFrame.unionByName, [self._read(r) for r in self.levels[level]])
            self.levels[level] = []
            self._push(self._write(merged.repartition(self.buckets, *KEY), "run"), level + 1)

    def surplus(self, min_docs: int) -> DataFrame:
        """(key, last) of the keys found in at least ``min_docs`` documents."""
        parts = [self.spark.createDataFrame([], "h1 long, h2 long, last long")]
        if self.changes:
            more = reduce(DataFrame.unionByName, [self._read(c) for c in self.changes])
            more = more.repartition(self.buckets, *KEY).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))
            more = self._read(self._write(more, "changes"))
            more = more.select(*KEY, F.col("n").alias("more"), F.col("last").alias("later"))
        for path in self.runs():
            run = self._read(path)
            if self.changes:
                run = run.hint("merge").join(more, KEY, "left").select(*KEY, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last"))
            parts.append(run.filter(F.col("n") >= min_docs).select(*KEY, "last"))
        with read_in_order(self.spark):
            return staged(reduce(DataFrame.unionByName, parts), "surplus")


def lost_keys(keys: DataFrame, surplus: DataFrame) -> DataFrame:
    """(id, lost): the keys of each document that are surplus and not the last.

    Nothing behind the join in its stage needs its partitioning, so adaptive execution may split a line that very many hold.
    """
    lost = keys.join(surplus, KEY).filter("id <> last").select("id", F.struct(*KEY).alias("key"))
    return lost.groupBy("id").agg(F.collect_set("key").alias("lost"))


def surplus_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = BATCHES) -> DataFrame:
    """(id, keys): the keys that each document loses, as the bytes of one key after another."""
    keys = staged(line_keys(docs, min_chars), "line-keys")
    runs = LineRuns.new(docs.sparkSession)
    for b in range(batches):
        runs.add(keys.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == b))
    return staged(lost_keys(keys, runs.surplus(min_docs)), "lost-lines")


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = BATCHES, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``columns`` of ``docs`` with ``text`` cleaned, and n_lines and n_dropped."""
    docs, own = pick(docs, *columns), list(columns)
    lost = surplus_lines(docs, min_docs, min_chars, batches)
    rows = docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("lw_id"))
    rows = rows.join(lost.select(F.col("id").alias("lw_id"), F.col("lost").alias("lw_lost")), "lw_id", "left").select(*own, "lw_lost")
    place = own.index("text")
    fields = [f for f in rows.schema.fields if f.name != "lw_lost"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_lines long", "n_dropped long"])

    def clean(text: str, lost: set[bytes]) -> tuple[str, int, int]:
        lines = text.encode().split(b"\n")
        kept = [x for x in lines if line_key(x, min_chars) not in lost] if lost else lines
        return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, keys in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                pairs = keys.as_py() or []
                out.append(clean(text.as_py() or "", {x["h1"].to_bytes(8, "little", signed=True) + x["h2"].to_bytes(8, "little", signed=True) for x in pairs}))
            columns = batch.columns[:-1]
            columns[place] = pa.array([x[0] for x in out], pa.string())
            counts = [pa.array([x[i] for x in out], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*columns, *counts], [*batch.schema.names[:-1], "n_lines", "n_dropped"])

    return rows.mapInArrow(run, schema)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d
), s AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.doc_id, k.pos, k.line, (s.key IS NOT NULL AND k.doc_id <> s.last) AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
