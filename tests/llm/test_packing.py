"""The assignment of pieces to sequences against brute force, and tokenizers of other sizes."""

import json
import random

import numpy as np
import pytest
import tokenizers

from lodewatch.llm import packing


def brute_plan(lengths, capacity, linear, quadratic):
    """{sequence: [(document, start, length)]} by the rule: longest first, to the cheapest sequence with room."""
    whole, tails, rooms, costs, out = 0, [], [], [], {}
    for i, n in enumerate(lengths):
        for k in range(n // capacity):
            out[whole] = [(i, k * capacity, capacity)]
            whole += 1
        if n % capacity:
            tails.append((-(n % capacity), i))
    total = -sum(n for n, _ in tails)
    rooms = [capacity] * (total // capacity)
    left = total % capacity
    while left:
        rooms.append(1 << left.bit_length() - 1)
        left -= rooms[-1]
    costs, late = [0.0] * len(rooms), []

    def put(i, start, n, to):
        out.setdefault(whole + to, []).append((i, start, n))
        rooms[to] -= n
        costs[to] += linear * n + quadratic * n * n

    for minus, i in sorted(tails):
        n, start = -minus, lengths[i] - -minus
        fitting = [k for k, room in enumerate(rooms) if room >= n]
        if fitting:
            put(i, start, n, min(fitting, key=lambda k: (costs[k], k)))
        else:
            late.append((i, start, n))
    spaces = sorted((k for k, room in enumerate(rooms) if room), key=lambda k: (-rooms[k], k))
    for i, start, n in late:
        while n:
            part = min(n, rooms[spaces[0]])
            put(i, start, part, spaces[0])
            start, n = start + part, n - part
            if not rooms[spaces[0]]:
                spaces.pop(0)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_assignment_matches_brute_force(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, rng.randrange(1, 70), rng.randrange(1, 400)]) for _ in range(rng.randrange(1, 150))]
    found = {}
    for i, start, n, seq, offset in packing.plan(np.array(lengths), 64, 1.0, 1 / 64):
        assert offset == sum(p[2] for p in found.get(seq, []))
        found.setdefault(seq, []).append((i, start, n))
    assert found == brute_plan(lengths, 64, 1.0, 1 / 64)
    # padded to full sequences, except at a power of two, nothing is lost
    assert all(n == 64 or n & n - 1 == 0 for n in (sum(p[2] for p in pieces) for pieces in found.values()))


def test_vocabularies_beyond_two_bytes(spark, tmp_path):
    model = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": {"[UNK]": 0, "a": 70_000, "b": 70_001}, "unk_token": "[UNK]"}}
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(model))
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(docs.coalesce(1), str(path), capacity=8, with_ids=True).collect() if r.start == 0}
    assert got == {1: [70_000, 70_001, 70_000, 2], 2: [2]}


@pytest.mark.parametrize("seed", range(3))
def test_ids_are_those_of_the_whole_tokenizer(monkeypatch, seed):
    monkeypatch.setattr(packing, "_encoders", {})
    monkeypatch.setattr(packing, "CACHE_WORDS", 300)  # words are carried on from one cache to the next, too
    path, rng = packing.public_tokenizer(), random.Random(seed)
    encode, model = packing.encoder(path), tokenizers.Tokenizer.from_file(path)
    whole = lambda text: model.encode(text, add_special_tokens=False).ids
    # upper case before marks that join with lower-case letters alone; letters that change in length; white space of other scripts
    letters = "abhtwyjABHTWYJIiK\u00df\u1e9e\u00c0\u00c9\u00d6\u00d8\u00e9\u00f6\u00f8\u00ff\u00f7\u00d7\u00aa\u00ba\u00b5\u0131\u0130\u017f\u03a3\u03c3\u03c2\u0410\u4e2d\u3042\u212a\ufb01\uac00"
    rest = "\u0300\u0308\u030a\u030c\u0331\u0338\u0345\u0301'.,*<|>_-=59\u2460\u0663 \t\n\x0b\x0c\r\x00\x1c\x85\u00a0\u2028\u200d"
    for text in ["H\u0331 T\u0308 W\u030a Y\u030a J\u030c h\u0331", "Don't dogs'*** l' 's \u00c9COLE, \u00e9cole. stra\u00dfe\u00f7", "<|endoftext|> <|ENDOFTEXT|>", ""]:
        assert encode(text).tolist() == whole(text), ascii(text)
    for _ in range(3000):
        text = "".join(rng.choice(letters + rest) for _ in range(rng.randrange(1, 14)))
        assert encode(text).tolist() == whole(text), ascii(text)


def test_new_words_of_letters_need_only_the_merges(monkeypatch):
    """The whole tokenizer takes about four times as long for a new word, and a large table always has new words."""
    taken = []

    class Counted:
        def __init__(self, model):
            self.inner = model

        @classmethod
        def from_file(cls, path, inner=tokenizers.Tokenizer):
            return cls(inner.from_file(path))

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode(self, text, **how):
            taken.append(text)
            return self.inner.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            taken.extend(texts)
            return self.inner.encode_batch_fast(texts, **how)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    monkeypatch.setattr(packing, "_encoders", {})
    rng = random.Random(1)
    words = ["".join(rng.choice("aeinrst\u00e9\u00df") for _ in range(9)) + rng.choice(["", ",", ".", "***"]) for _ in range(2000)]
    encode = packing.encoder(packing.public_tokenizer())
    got = encode(" ".join(words)).tolist()
    assert set(taken) <= {",", ".", "***"}
    assert got == Counted.from_file(packing.public_tokenizer()).inner.encode(" ".join(words), add_special_tokens=False).ids
