"""Licence scan with a generalised suffix automaton.

The templates are the whole texts in ``licence_texts``, with the label as file name, and the usual notices that point to
them. Their word sequences go into one suffix automaton, a bounded parameter that each worker builds once.
A file's words are streamed through it: after each word the automaton knows the longest run of words ending there that
some template holds (matching statistics). Maximal runs become matches with their places in the templates; matches of one
template that follow each other in file and template are chained over small gaps, and a chain that covers enough of the
template labels its span. Where spans of different templates overlap, the one that covers most words stays.

Words that no template holds reset the automaton, so only stretches of template words are walked one by one; everything
else is whole-array arithmetic.

Defined cases: null or empty text has no words, no labels and score 0; repeated rows are scanned one by one; an empty
table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, short_batches
from .wordhash import NOT_ALNUM, hash_word, small_batches, word_hashes

# fixed values: phrases whose places are counted, with the label of each
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# fixed values: notices and identifying sentences of public licences, as words
NOTICES = (
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("agpl-3", "the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

MIN_MATCH, MAX_GAP, COVERAGE, LONG = 3, 4, 0.8, 100
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@lru_cache(maxsize=1)
def templates() -> tuple[tuple[str, str], ...]:
    """(label, words) of the notices and of the whole texts."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return (*NOTICES, *((f.stem, " ".join(WORD.findall(f.read_text(encoding="utf-8").lower()))) for f in files))


@dataclass
class SuffixAutomaton:
    """Of several word sequences. ``ends`` holds the (template, place) of a state's last words."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of ``q`` that holds its words only as far as ``p`` and ``word`` reach."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, nr: int, words: list[int]) -> None:
        last = 0
        for place, word in enumerate(words):
            known = self.next[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
                last = new
            self.ends[last].add((nr, place))

    def finish(self) -> None:
        """Hands end places on to the states that are suffixes of others."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the maximal runs of ``least`` words or more."""
        state, n = 0, 0
        for i, word in enumerate([*words, -1]):
            s, m = state, n
            while s > 0 and word not in self.next[s]:
                s = self.link[s]
                m = self.length[s]
            grown = self.next[s].get(word)
            s, m = (grown, m + 1) if grown is not None else (0, 0)
            if n >= least and m <= n:
                yield i - 1, n, state
            state, n = s, m


class Scanner:
    """Templates and phrases, made ready for texts."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
        words = sorted({w for _, t in (*templates, *phrases) for w in t.split()})
        number = {w: i for i, w in enumerate(words)}
        hashes = np.array([hash_word(w) for w in words], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.phrases = [(label, [number[w] for w in t.split()]) for label, t in phrases]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(t.split()) for _, t in templates]
        self.automaton = SuffixAutomaton()
        for nr, (_, t) in enumerate(templates):
            self.automaton.add(nr, [number[w] for w in t.split()])
        self.automaton.finish()

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def base(self, ids: np.ndarray, owner: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """(label, starts) of each phrase; ``owner`` is the text of each word."""
        out = []
        for label, phrase in self.phrases:
            starts = np.flatnonzero(ids == phrase[0])
            starts = starts[starts + len(phrase) <= len(ids)]
            for j, word in enumerate(phrase[1:], 1):
                starts = starts[ids[starts + j] == word]
            out.append((label, starts[owner[starts] == owner[starts + len(phrase) - 1]]))
        return out

    def spans(self, runs: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, last word, words covered, share of the template) of one text's runs (first word, word numbers)."""
        found = defaultdict(list)  # by template: (start, end, start in the template, length)
        for first, words in runs:
            for end, n, state in self.automaton.matches(words, MIN_MATCH):
                for nr, place in self.automaton.ends[state]:
                    found[nr].append((first + end - n + 1, first + end, place - n + 1, n))
        chains = [(covered, first, last, nr) for nr, m in found.items() for covered, first, last in self._chains(sorted(m), self.sizes[nr])]
        out: list[tuple[int, int, int, int]] = []  # disjoint, by place
        for covered, first, last, nr in sorted(chains, key=lambda c: (-c[0], c[1], c[3])):
            at = bisect(out, (first,))
            if (not at or out[at - 1][1] < first) and (at == len(out) or out[at][0] > last):
                out.insert(at, (first, last, nr, covered))
        return [(self.labels[nr], first, last, covered, covered / self.sizes[nr]) for first, last, nr, covered in out]

    def _chains(self, m: list[tuple[int, int, int, int]], size: int) -> Iterator[tuple[int, int, int]]:
        best: list[tuple[int, int]] = []  # words covered and first word of the best chain that ends with each match
        near: list[int] = []  # matches that end within the gap before this one or later
        for i, (start, end, at, n) in enumerate(m):
            mine = (n, start)
            near = [j for j in near if m[j][1] >= start - 1 - MAX_GAP]
            for j in near:
                gap, step = start - m[j][1] - 1, at - (m[j][2] + m[j][3])
                if step <= MAX_GAP:
                    lap = max(0, -gap, -step)  # words that both hold count once
                    if lap < n and best[j][0] + n - lap > mine[0]:
                        mine = best[j][0] + n - lap, best[j][1]
            best.append(mine)
            near.append(i)
        for (covered, first), (_, end, *_) in zip(best, m, strict=True):
            if covered >= min(COVERAGE * size, LONG):
                yield min(covered, size), first, end


@lru_cache(maxsize=2)
def scanner_of(known: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    """One for each worker process."""
    return Scanner(known, phrases)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, share: double>>"


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] | None = None, phrases: tuple[tuple[str, str], ...] = BASE_PHRASES) -> DataFrame:
    """With the templates ``known``, those of this module if none are given: words, phrase places, labels and covered spans of each row of ``docs`` (doc_id, text)."""

    short_batches(docs.sparkSession)
    known = known or templates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(known, phrases)
        for batch in small_batches(batches):
            hashes, bounds = word_hashes(batch.column(1), NOT_ALNUM)
            n, counts = batch.num_rows, np.diff(bounds)
            ids, owner = scanner.numbers(hashes), np.repeat(np.arange(n), counts)
            base: list[set[str]] = [set() for _ in range(n)]
            n_base, first, last = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1)
            for label, starts in scanner.base(ids, owner):
                own, place = owner[starts], starts - bounds[owner[starts]]
                n_base += np.bincount(own, minlength=n)
                np.minimum.at(first, own, place)
                np.maximum.at(last, own, place)
                for i in np.unique(own).tolist():
                    base[i].add(label)
            # stretches of template words
            on = ids >= 0
            cut = np.ones(len(ids) + 1, bool)
            cut[1:-1] = (on[1:] != on[:-1]) | (owner[1:] != owner[:-1])
            edges = np.flatnonzero(cut)
            edges = edges if len(ids) else np.zeros(1, np.int64)
            runs = defaultdict(list)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a >= MIN_MATCH and on[a]:
                    runs[int(owner[a])].append((a - int(bounds[owner[a]]), ids[a:b].tolist()))
            spans = [scanner.spans(runs[i]) if i in runs else [] for i in range(n)]
            labels = [base[i] | {s[0] for s in spans[i]} for i in range(n)]
            score = [max([1.0 if base[i] else 0.0, *(s[4] for s in spans[i])]) for i in range(n)]
            none = n_base == 0
            columns = [
                batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(n_base), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none),
                pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score, pa.float64()),
                pa.array([[{"label": s[0], "first": s[1], "last": s[2], "share": s[4]} for s in sorted(x, key=lambda s: s[1])] for x in spans], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCHEMA)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
