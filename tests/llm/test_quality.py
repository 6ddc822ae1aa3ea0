"""Quality rules on hosts whose documents repeat lines, against a count by hand."""

import collections
import re

from lodewatch.llm import quality


def verdicts(rows, most_docs):
    """{doc_id: (base_failed, kept, n_removed)} of rows (doc_id, text, source)."""
    lines = lambda t: [x for x in (t or "").split("\n") if x.strip()]
    key = lambda x: re.sub("[0-9]", "0", x.strip().lower())
    held = collections.defaultdict(set)
    for i, text, host in rows:
        for x in lines(text):
            held[host, key(x)].add(i)
    out = {}
    for i, text, host in rows:
        w = (text or "").split()
        seen = collections.Counter(zip(w, w[1:], w[2:]))  # noqa: B905
        repeated = {p for j in range(len(w) - 2) if seen[w[j], w[j + 1], w[j + 2]] > 1 for p in (j, j + 1, j + 2)}
        removed = sum(len(x.split()) for x in lines(text) if len(held[host, key(x)]) > most_docs)
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        out[i] = failed, not failed and len(w) - removed >= 0.5 * len(w), removed
    return out


def test_depleted_documents_are_rejected(spark):
    own = lambda i, n: " ".join(f"own{i}x{chr(97 + j % 26)}{'b' * (j // 26)}" for j in range(n))
    footer = " ".join(f"footer{chr(97 + j)}" for j in range(20)) + " 2024"
    rows = []
    for i in range(60):  # every document of host a holds the footer, in other spellings; every other one little else
        rows.append((i, own(i, 40 if i % 2 else 15) + f"\n  {footer.upper() if i % 3 else footer.replace('2024', '1999')}\n" + footer + own(i, 3), "a"))
    rows += [(100 + i, own(i, 40) + "\n" + footer, "b") for i in range(6)]  # not often enough on this host
    rows += [(200, own(1, 80) + "\n" + own(1, 80), "c"), (201, own(2, 49), "c"), (202, None, None), (203, "", "c"), (204, " \t\n ", None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), most_docs=10).collect()}
    wanted = verdicts(rows, 10)
    assert {i: (r.base_failed, r.kept, r.n_removed) for i, r in got.items()} == wanted
    assert sum(not failed and not kept for failed, kept, _ in wanted.values()) >= 10


def test_documents_count_once_however_often_they_are_repeated(spark):
    line = "one line of text that repeats word for word"
    rows = [(1, f"{line}\n{line}", "a")] * 30 + [(None, line, "a")] * 30 + [(i, line, "a") for i in range(2, 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.n_removed for r in quality.judge(table, most_docs=6).collect()} == {0}
    assert {r.n_removed for r in quality.judge(table, most_docs=5).collect()} == {9, 18}
