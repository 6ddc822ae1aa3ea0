"""Licence labels, spans and scores against brute force, whole licence texts, and the cost of repetitive texts."""

import random
import re
import time

import pytest

from lodewatch.llm import licenses
from lodewatch.llm.licenses import COVERAGE, LONG, MAX_GAP, MIN_MATCH


def brute_spans(words, templates):
    """[(label, first, last, share)] by comparing all places."""
    texts = [t.split() for _, t in templates]
    longest = []
    for e in range(len(words) + 1):
        n = 0
        while e < len(words) and e - n >= 0 and any(t[j : j + n + 1] == words[e - n : e + 1] for t in texts for j in range(len(t) - n)):
            n += 1
        longest.append(n)
    chains = []
    for nr, t in enumerate(texts):
        m = []
        for e in range(len(words)):
            n = longest[e]
            if n >= MIN_MATCH and longest[e + 1] <= n:
                m += [(e - n + 1, e, j, n) for j in range(len(t) - n + 1) if t[j : j + n] == words[e - n + 1 : e + 1]]
        m.sort()
        best = []
        for i, (start, end, at, n) in enumerate(m):
            own = (n, start)
            for j in reversed(range(i)):
                gap, step = start - m[j][1] - 1, at - (m[j][2] + m[j][3])
                lap = max(0, -gap, -step)
                if gap <= MAX_GAP and step <= MAX_GAP and lap < n and best[j][0] + n - lap > own[0]:
                    own = best[j][0] + n - lap, best[j][1]
            best.append(own)
            if own[0] >= min(COVERAGE * len(t), LONG):
                chains.append((min(own[0], len(t)), own[1], end, nr))
    out = []
    for covered, first, last, nr in sorted(chains, key=lambda c: (-c[0], c[1], c[3])):
        if all(last < o[1] or first > o[2] for o in out):
            out.append((templates[nr][0], first, last, covered / len(texts[nr])))
    return sorted(out, key=lambda s: s[1])


def test_spans_and_labels_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    known = tuple((f"l{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(4, 14)))) for i in range(8))
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            own = rng.choice(known)[1].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(["x", *words])
            parts += own[: rng.randrange(2, len(own) + 1)] + rng.choices(["x", "y", *words], k=rng.randrange(4))
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, known, (("l0", known[0][1]),)).collect()}
    labelled = 0
    for i, text in enumerate(texts):
        w = text.split()
        wanted = brute_spans(w, known)
        assert [(s.label, s.first, s.last, pytest.approx(s.share)) for s in got[i].spans] == wanted
        base = {"l0"} if f" {known[0][1]} " in f" {text} " else set()
        assert got[i].labels == ",".join(sorted(base | {s[0] for s in wanted}))
        assert got[i].score == pytest.approx(max([1.0 if base else 0.0, *(s[3] for s in wanted)]))
        labelled += bool(wanted)
    assert labelled > 40


def test_whole_texts_are_found_in_files(spark):
    files = dict(licenses.templates()[len(licenses.NOTICES) :])
    assert {"mit", "apache-2", "gpl-3", "mpl-2"} <= set(files) and len(files["gpl-3"].split()) > 5000
    texts = [f"import os\n/* {t.upper()} */\nint main() " + "something else " * 50 for t in files.values()]
    half = files["gpl-3"].split()
    texts.append(" ".join(half[1000:2000]))  # a long part counts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, label in enumerate([*files, "gpl-3"]):
        assert label in got[i].labels.split(","), (label, got[i].labels)
    assert got[len(files)].score == pytest.approx(1000 / len(half), abs=0.01)


def test_repetitive_texts_take_time_in_proportion():
    scanner = licenses.scanner_of(licenses.templates(), licenses.BASE_PHRASES)
    number = {int(h): int(n) for h, n in zip(scanner.hashes, scanner.order)}  # noqa: B905
    for text in ("licensed under the apache license version 2 0 ", "the software is provided as is the work ", "of the license to the work of the "):
        ids = [number[licenses.hash_word(w)] for w in re.findall("[a-z0-9]+", text)] * 10_000
        began = time.time()
        scanner.spans([(0, ids)])
        assert time.time() - began < 20, text
