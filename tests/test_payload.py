"""Budgets of what a model is given, against a plain loop."""

import random

from pyspark.sql import functions as F

from lodewatch.functions.text import redacted
from lodewatch.operators import payload


def test_files_share_a_budget(spark):
    deal = random.Random(5)
    rows = []
    for t in range(12):
        for i in range(deal.choice([1, 6, 70])):
            text = deal.choice([None, "", "a\u0000b", "short é text", "x" * 3990 + " token=abcdefgh12345 and more", "é日" * 3000, "w " * deal.randrange(1500), "plain " * 900 + "\u0000"])
            rows.append((f"t{t}", f"f{i:03}.md" if i != 3 else "SKILL.md", text))
    budgets = {f"t{t}": [2000, 8192, 16000][t % 3] for t in range(12)}
    files = spark.createDataFrame(rows + rows[:3], "target_id string, path string, content string")
    targets = spark.createDataFrame([(t, "SKILL.md", b) for t, b in budgets.items()], "target_id string, entry string, budget int")
    texts = sorted({r[2] for r in rows if r[2] is not None})
    hide = lambda t: spark.createDataFrame([(t,)], "t string").select(redacted(F.col("t"))).first()[0] if "token" in t else t
    wanted = {}
    for t, budget in budgets.items():
        own = sorted((r[1:] for r in rows if r[0] == t), key=lambda f: (f[0] != "SKILL.md", f[0]))
        for nr, (path, text) in enumerate(own[:50], 1):
            most = min(4000, budget)
            status, content = "not-sent", ""
            if most > 0 and text is not None:
                raw = text.encode()[: most * 4]
                status = "binary" if b"\x00" in raw else "truncated"
                if status != "binary":
                    shown = hide(raw.decode("utf-8", "replace"))
                    content = shown[:most]
                    status = "complete" if len(text.encode()) <= most * 4 and len(shown) <= most else "truncated"
            budget -= len(content)
            wanted[t, nr] = (path, status, content, max(0, len(own) - 50))
    got = {(r.target_id, r.nr): (r.path, r.status, r.content, r.not_listed) for r in payload.sent_files(files, targets).collect()}
    assert texts and got == wanted
    assert {x[1] for x in got.values()} == {"complete", "truncated", "binary", "not-sent"}


def test_excerpts_share_half_a_budget(spark):
    text = "\n".join(f"line {i} " + "yy " * 70 for i in range(1, 40))
    files = spark.createDataFrame([("t", "a.md", text)], "target_id string, path string, content string")
    found = spark.createDataFrame([("t", n, "a.md" if n != 2 else "gone.md", n * 3, f"own {n}") for n in range(1, 9)], "target_id string, nr int, path string, line int, snippet string")
    left, wanted = 2500, []
    for n in range(1, 9):
        lines = text.split("\n")[max(0, n * 3 - 3) : n * 3 + 2]
        content = ("\n".join(lines)[:1200] if n != 2 else f"own {n}")[:left]
        if left > 0:
            wanted.append((n, content))
        left -= len(content)
    got = sorted((r.nr, r.content) for r in payload.excerpts(found, files, 2500).collect())
    assert got == wanted and len(got) < 8


def test_budgets(spark):
    row = spark.range(1).select(*[payload.budget_of(F.lit(n).cast("int")).alias(str(n)) for n in (None, 100, 2048, 9000)]).first()
    assert list(row) == [8192, 2000, 8192, 16000]
