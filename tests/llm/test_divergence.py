"""The source divergence audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

from lodewatch.llm import divergence


def plain(rows, least, top):
    """(lang, source, part, item, value, rank) by dictionaries; rows of (lang, source, text)."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for a, b, t in rows]
    df = Counter((a, w) for a, _, t in docs for w in set(t))
    out = set()
    for lang in {a for a, _, _ in docs}:
        kept = sorted(w for (a, w), n in df.items() if a == lang and n >= least)
        counts = defaultdict(Counter)
        for a, b, t in docs:
            if a == lang:
                counts[b].update(w for w in t if w in kept)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        own, q = {b: share(c) for b, c in counts.items()}, share(sum(counts.values(), Counter()))
        for b in counts:
            pairs = [(sum(abs(own[b][w] - own[o][w]) for w in kept), o) for o in counts if o != b]
            terms = [(own[b][w] - q[w], w) for w in kept if counts[b][w] and own[b][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, b, part, o, v, i + 1) for i, (v, o) in enumerate(found) if part == "pair" or i < top}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed):
    deal = random.Random(seed)
    words = ["the", "The", "über", "ÜBER", "don't", "x1y", "a", "日本", "é", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = []
    for _ in range(300):
        lang = deal.choice(["en", "en", "de", None, ""])
        own = deal.sample(words, 8)
        text = "".join(deal.choice(own) + deal.choice([" ", "\n", ", ", "...", "\x00", "-7-"]) for _ in range(deal.randrange(40)))
        rows.append((lang, deal.choice(["s1", "s2", "s3", "s4", "s5", None, "日", "zz"]), text))
    return [*rows, *rows[:5], ("xx", "lonely", "too few documents"), ("xx", None, None), ("yy", "b", ""), ("en", "empty", None)]


def test_one_block(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(divergence.divergence(docs, least_docs=12, top=3)) == plain(rows, 12, 3)


def test_many_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 3)
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    table = divergence.grouped_rows(docs)
    kept = divergence.kept_terms(table, 9).cache()
    assert divergence.shard_count(kept, 4, 1 << 20) > 3 and divergence.shard_count(kept, 1 << 20, 20) > 3
    whole, parts = (divergence.postings(table, kept, n) for n in (1 << 20, 4))
    assert sorted(whole.collect()) == sorted(parts.collect())
    assert found(divergence.divergence(docs, least_docs=9, top=4)) == plain(rows, 9, 4)


def test_empty_table_and_clashing_columns(spark):
    assert found(divergence.divergence(spark.createDataFrame([], "lang string, source string, text string"))) == set()
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        rows = [("en", s, "two words " * 3000) for s in "abc"]
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, TEXT string, n long")
        assert found(divergence.divergence(docs, least_docs=2)) == plain(rows, 2, 50)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_large_counts_stay_exact(spark):
    row = spark.range(1).select(divergence.probability(divergence.F.lit(10**12), divergence.F.lit(3 * 10**12 + 7), divergence.F.lit(10**6)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**12 + 5) // (3 * 10**12 + 7 + 5 * 10**6)
