"""Near duplicates: recall against all pairs, words that a polynomial would confuse, and awkward rows."""

from pathlib import Path

import pytest

from lodewatch.llm import neardup, wordhash

from .test_llm import components_of

SF = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_components_of_a_whole_table_match_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wanted, sizes = components_of({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == wanted
    assert {i: r.n_shingles for i, r in got.items()} == sizes


def test_words_built_alike_have_hashes_of_their_own(spark):
    one = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    words = [one, two, "a", "aa", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "ab" * 8, "ba" * 8, "é", "é"]
    assert len({wordhash.hash_word(w) for w in words}) == len(words)
    docs = spark.createDataFrame([(1, one), (2, two), (3, two.upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 2}


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (5, "other words"), (3, text.upper()), (None, text), (None, None), (4, ""), (None, "alone here")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, regs string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=repr)
    wanted = [(5, 36, 3, False), (5, 36, 3, False), (5, 1, 5, True), (3, 36, 3, True), (None, 36, 3, False), (None, 0, None, True), (4, 0, 4, True), (None, 1, None, True)]
    assert got == sorted(wanted, key=repr)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
