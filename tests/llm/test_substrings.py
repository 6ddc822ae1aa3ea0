"""Removal of earlier passages against a dictionary of all windows."""

import random
import re

import numpy as np
import pytest

from lodewatch.llm import substrings


def plain(rows, k):
    """{(id, text): (kept words, number of words, removed words)}; a null id after all others, rows of one id and text once."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, out = set(), {}
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d[2])
        gone = set()
        for s in range(len(w) - k + 1):
            window = tuple(w[s : s + k])
            if window in seen:
                gone |= set(range(s, s + k))
            seen.add(window)
        out[None if d[0] else d[1], d[2]] = (" ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone))
    return out


def check(spark, rows, k):
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, nr long")
    got = substrings.dedup_substrings(docs, k, ("doc_id", "nr")).collect()
    wanted = plain(rows, k)
    assert sorted(r.nr for r in got) == list(range(len(rows)))
    for r in got:
        i, text = rows[r.nr]
        assert (r.text, r.n_words, r.n_removed) == wanted[i, text or ""]
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert r.text.split(" ") == [x for j, x in enumerate(w) if not any(a <= j < b for a, b in r.removed)] or not r.text


@pytest.mark.parametrize("k", [1, 2, 5, 8, 20])
def test_passages_at_every_offset(spark, k):
    deal = random.Random(k)
    word = lambda n: "".join(deal.choice("abcdefghij") for _ in range(n))
    passages = [[word(6) for _ in range(deal.choice([k, k + 1, 2 * k, 60]))] for _ in range(12)]
    passages += [["x"] * (3 * k), ["a", "b"] * (2 * k), ["über", "Über", "日本"] * k]
    rows = []
    for i in range(90):
        words = []
        for _ in range(deal.randrange(5)):
            words += [word(7) for _ in range(deal.randrange(40))]
            p = deal.choice(passages)
            a = deal.randrange(len(p))
            words += p[a:] if deal.random() < 0.5 else p[: a + 1]
        rows.append((deal.randrange(10**12) if i % 9 else i, deal.choice([" ", "\n", " \t"]).join(words)))
    rows += [(10**13 + i, rows[i % 7][1]) for i in range(20)] + [(5, None), (-3, ""), (6, " \x0b\x1c "), (-(10**15), rows[40][1])]
    check(spark, rows, k)


def test_null_ids_and_repeated_rows(spark):
    deal = random.Random(1)
    words = [str(deal.random()) for _ in range(90)]
    a, b, c = " ".join(words), " ".join(words[20:70]), " ".join(words[:50] + words[:50])
    check(spark, [(1, b), (1, b), (None, a), (None, a), (2, c), (2, c), (3, a), (None, None)], 20)


def test_rows_of_one_id_remove_each_other_once(spark):
    words = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, words), (1, words + " x"), (1, "y " + words)], "doc_id long, text string")
    got = substrings.dedup_substrings(docs).collect()
    assert sorted(r.n_removed for r in got) == [0, 40, 40]


def test_empty_table_extra_columns_and_a_long_text(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        text = " ".join(str(i % 5000) for i in range(20000))
        docs = spark.createDataFrame([(1, text, "x", 1, 2)], "doc_id long, text string, TEXT string, first long, k1 long")
        row = substrings.dedup_substrings(docs).first()
        assert (row.n_words, row.n_removed, row.text) == (20000, 15000, " ".join(map(str, range(5000))))
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_covers_bring_any_two_places_together():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substrings.cover_of(20) == (13, (0, 1, 3, 9))
    assert not len(substrings.repeated_windows(60, 20, substrings.anchor_places(60, 20)))
    assert substrings.repeated_windows(60, 20, np.zeros(0, np.int64)).tolist() == list(range(41))


def test_a_hot_passage_is_counted_on_the_map_side(spark):
    rows = spark.range(300).selectExpr("id AS k1", "0L AS k2", "concat(repeat('same words here ', 20), id) AS text")
    counted = substrings.anchors(rows, 20).groupBy("h").count()
    assert "partial_count" in counted._jdf.queryExecution().executedPlan().toString()
