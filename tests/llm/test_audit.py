"""The filter audit against a simulation of every order."""

import random
import re
from itertools import permutations

from lodewatch.llm import audit

MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def simulated(rows, labels):
    """All orders, document by document; rows of (doc_id, text, lang), a null id after all others."""
    place = lambda i: (i is None, i or 0)
    first = {}
    for i, text, _ in rows:
        first[text or ""] = min(first.get(text or "", (True, 10**9)), place(i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, lang in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": place(i) > first[text]}
        parts.setdefault(lang or "", []).append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = set(order[:k])
                here = [d for d in docs if f in d[0] and not d[0] & gone]
                shapley[f] += len(here)
                out[part, "".join(order), k + 1] = [sum(not d[0] & set(order[: k + 1]) for d in docs), len(here), sum(f in d[0] and bool(d[0] & gone) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r[m] for m in MEASURES) for r in audit.audit(docs, labels).collect()}


def test_all_orders_of_random_documents(spark):
    deal = random.Random(3)
    texts = []
    for _ in range(60):
        words = [deal.choice(["Word", "word", "über", "x#", "CAPS", f"w{deal.randrange(400)}"]) if deal.random() < 0.3 else f"v{deal.randrange(deal.choice([3, 900]))}" for _ in range(deal.choice([5, 199, 200, 260]))]
        texts.append(deal.choice([" ", "\n", " \t "]).join(words))
    rows = [(i, deal.choice(texts), deal.choice(["en", "de", None])) for i in range(150)]
    rows += [(200, None, "en"), (201, "", "de"), (202, " \x0b\n", None), (None, texts[0], "en"), (None, texts[0], "de"), (7, texts[1], "en"), (7, texts[1], "en"), (7, texts[1], "de"), (None, "only here " * 300, "fr")]
    labels = [(i, deal.choice([0, 1, None]), deal.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert found(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == simulated(rows, labels)


def test_empty_tables_and_clashing_columns(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert found(spark.createDataFrame([], "doc_id long, text string, lang string"), labels) == {}
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.createDataFrame([(1, "a b", "en", "x", 3)], "doc_id long, text string, lang string, TEXT string, n long")
        rows = found(docs, labels)
        assert len(rows) == 600 and rows == simulated([(1, "a b", "en")], [])
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_a_text_of_a_third_of_all_rows_is_few_rows_behind_a_shuffle(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text ', id)) AS text", "'en' AS lang")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counted = audit.counted(docs, labels)
    assert counted.count() == 2001
    assert counted.agg({"n": "sum"}).first()[0] == 3000
    assert counted.selectExpr("sum(copies.n)").first()[0] == 999
