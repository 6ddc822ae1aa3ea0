"""Each stage of the pipeline on awkward tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import collections

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lodewatch.llm import mixing, packing, toxicity

from .test_linededup import cleaned

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, lw_text string, row_key string, lw_copies long"
LONG = "many words stand in this rather long text and go on. " * 4000
LINE = "a line of more than twenty characters"
BAD = "vile nasty " + " ".join(f"v{i}" for i in range(30))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "b", 0), (3, LONG, "en", "a", 9), (3, LONG, "en", "a", 9), (None, f"x\n{LINE}", "en", "a", 1),
    (5, f"{LINE}\nsame words here as there are", "de", "b", 1), (6, f" {LINE.upper()}\nother", "de", "b", 1), (7, " \t\n \x0b", "de", "b", 1),
    (8, "one\nüber 😀 word", None, "b", 1), (9, LONG + "end", "en", None, 2), (10, BAD, "en", "a", 3), (None, None, None, None, None),
]


@pytest.fixture
def some(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield spark.createDataFrame([(*r, "x", "y", "z", 7) for r in ROWS], SCHEMA).repartition(2)
    spark.conf.unset("spark.sql.caseSensitive")


@pytest.fixture
def labels(spark, tmp_path):
    spark.createDataFrame([(10, 1), (3, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_toxicity_stage_drops_what_the_model_rejects(spark, some, labels):
    kept = cp.drop_toxic(spark, some, labels)
    model = toxicity.train(some, spark.read.parquet(f"{labels}/labels.parquet"))
    rejected = collections.Counter((r.doc_id, r.text) for r in toxicity.score(some, model, ("doc_id", "text")).filter("predicted = 1").collect())
    assert kept.columns == COLUMNS
    assert collections.Counter(texts(kept)) + rejected == collections.Counter((r[0], r[1]) for r in ROWS)


def test_line_stage_matches_brute_force(spark, some, labels):
    got = cp.drop_repeated_lines(spark, some, labels)
    assert got.columns == COLUMNS
    assert texts(got) == sorted([(i, t) for i, t, _, _ in cleaned([r[:2] for r in ROWS], 3, 20)], key=repr)
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_near_copy_stage_keeps_one_of_each_group(spark, some, labels):
    got = cp.drop_near_copies(spark, some, labels)
    assert got.columns == COLUMNS
    # rows without words are linked with nothing, but of equal rows one stays
    assert texts(got) == sorted([(r[0], r[1]) for r in ROWS if r[0] != 9 and r is not ROWS[3]], key=repr)


def test_mixing_stage_emits_each_row_as_often_as_the_sample_takes_it(spark, some, labels):
    got = cp.mix_sources(spark, some, labels)
    assert got.columns == COLUMNS
    taken = collections.Counter()
    for r in mixing.sample(some).collect():
        taken[r.doc_id, r.source, r.size] += r.copies
    size = lambda t: len((t or "").split())
    assert collections.Counter((r.doc_id, r.source, size(r.text)) for r in got.collect()) == +taken


def test_packing_stage_holds_every_id_once(spark, some, labels):
    model = Tokenizer.from_file(packing.public_tokenizer())
    wanted = collections.Counter()
    for r in ROWS:
        for i in [*model.encode(r[1] or "", add_special_tokens=False).ids, 2]:
            wanted[r[0], i] += 1
    pieces = cp.pack_sequences(spark, some, labels).collect()
    got = collections.Counter((p.doc_id, i) for p in pieces for i in np.frombuffer(p.ids, "<u4").tolist())
    assert got == wanted
    fill = collections.Counter()
    for p in pieces:
        fill[p.sequence_id] += p.length
    assert all(n == 4096 or n & n - 1 == 0 for n in fill.values())


def test_stages_on_an_empty_table(spark, labels):
    none = spark.createDataFrame([], SCHEMA.replace("TEXT string, ", ""))
    for _, stage in cp.STAGES:
        assert stage(spark, none, labels).count() == 0
