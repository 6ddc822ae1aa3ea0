"""Cost-balanced packing of token sequences.

A document of n tokens costs ``linear * n + quadratic * n * n`` to attend to. Documents are taken in descending order,
and each goes to the sequence of the lowest cost that still has room for it. Pieces that fill a sequence by themselves
are cut off first, and what fits nowhere whole is cut over the room that is left.

Packing goes on inside a window of a partition's documents, so nothing is shuffled and a task holds one window of
token ids at most, two bytes each, or four with a vocabulary beyond 65,536 ids. The room of a window is planned to hold its tokens exactly: full sequences, then
one of each power of two that the remainder needs, which is stored without padding.

Defined cases: null text is empty and leaves its end mark alone; repeated rows are packed one by one; long documents
are cut; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, short_batches

#: Tokens and documents of one window: bounds of a task's memory and time.
WINDOW_TOKENS, WINDOW_DOCS = 1 << 22, 1 << 16
#: New words after which a task's cache of ids starts afresh; words of the cache before are still found and carried on.
CACHE_WORDS = 1 << 19

#: Letters of one code point that no neighbour among them and no normal form changes, then marks of ASCII.
PLAIN_WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-/:-@\[-`{-~]*)")
#: What a tokenizer file says that does nothing across white space and cuts letters from marks before its merges.
WORD_PARTS = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, Callable[[str], np.ndarray]] = {}


class _Known(dict):
    """Ids of words as bytes. A word that is asked for the first time is found, or carried on from the words before."""

    def __init__(self, find: Callable[[bytes], bytes]):
        self.find, self.before = find, {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        self[word] = ids = self.find(word) if ids is None else ids
        return ids


def _splits_words(path: str) -> bool:
    """Whether the tokenizer file at ``path`` normalises and splits as ``word_bpe_49k.json`` does, so that words can be taken one by one."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    marked = all(t["content"].startswith("<|") and not t["normalized"] for t in parts.get("added_tokens") or [])
    return marked and all(parts.get(name) == value for name, value in WORD_PARTS.items())


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids by the tokenizer file at ``path``, one for each worker process.

    A tokenizer of ``WORD_PARTS`` splits at white space before its merges, so words are looked up one by one. New words
    of letters and then marks are cut where it cuts them, and the letters go straight to its merges, which is all that
    it would do to them. Any other word goes through the whole tokenizer, and with any other tokenizer the whole text.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    model, by_words = Tokenizer.from_file(path), _splits_words(path)
    code = "H" if max(model.get_vocab().values(), default=0) < 1 << 16 else "I"
    merges, byte_level = model.model, ByteLevel(add_prefix_space=False, use_regex=False)
    as_bytes = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))}
    whole = lambda text: array(code, model.encode(text, add_special_tokens=False).ids).tobytes()
    merged = lambda letters: array(code, [t.id for t in merges.tokenize(letters.lower().translate(as_bytes))]).tobytes()

    def find(word: bytes) -> bytes:
        text = word.decode()
        cut = PLAIN_WORD.fullmatch(text)
        if not cut:
            return whole(text)
        letters, marks = cut.groups()
        if not marks:
            return merged(letters)
        core = letters.encode()
        if core not in known:
            known[core] = known.before.get(core) or merged(letters)
        return known[core] + known[marks.encode()]

    known = _Known(find)

    def encode(text: str) -> np.ndarray:
        data = text.encode()
        if not by_words or b"<|" in data:  # a special token's string counts only in its own case
            return np.frombuffer(whole(text), code)
        # H and a line below stay two characters, h and the line become one: before such marks (U+0300 to U+037F) case stays
        words = (data if b"\xcc" in data or b"\xcd" in data else data.lower()).split()
        return np.frombuffer(b"".join(map(known.__getitem__, words)), code)

    def forget() -> None:
        known.clear()
        known.before = {}

    encode.forget, encode.kind = forget, np.dtype(code)
    _encoders[path] = encode
    return encode


def powers(n: int) -> list[int]:
    """The powers of two that sum to ``n``, largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def plan(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents of these lengths.

    Sequences together hold exactly the tokens there are.
    """
    nr = 0
    tails = lengths % capacity
    for i in np.flatnonzero(lengths >= capacity).tolist():
        for at in range(0, int(lengths[i] - tails[i]), capacity):
            yield i, at, capacity, nr, 0
            nr += 1
    full, remainder = divmod(int(tails.sum()), capacity)
    room = np.array([capacity] * full + powers(remainder), np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    left: list[tuple[int, int, int]] = []

    def put(i: int, at: int, n: int, to: int) -> tuple[int, int, int, int, int]:
        out = (i, at, n, nr + to, int(size[to] - room[to]))
        room[to] -= n
        cost[to] += linear * n + quadratic * n * n
        return out

    for i in np.argsort(-tails, kind="stable").tolist():
        n, start = int(tails[i]), int(lengths[i] - tails[i])
        if not n:
            break
        to = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[to] >= n:
            yield put(i, start, n, to)
        else:
            left.append((i, start, n))
    spaces = np.flatnonzero(room)
    spaces = iter(spaces[np.argsort(-room[spaces], kind="stable")].tolist())
    to = -1
    for i, start, n in left:
        while n:
            if to < 0 or not room[to]:
                to = next(spaces)
            part = min(n, int(room[to]))
            yield put(i, start, part, to)
            start, n = start + part, n - part


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, linear: float = 1.0, quadratic: float = 1.0 / 4096, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): where each run of a document's ids lies, and with ``with_ids`` the ids."""
    short_batches(docs.sparkSession)
    schema = PIECES + (", ids binary" if with_ids else "")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.kind)
        names, ids, held = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(np.concatenate([encode(text.as_py() or ""), end]))
                names.append(name)
                held += len(ids[-1])
                if held >= WINDOW_TOKENS or len(ids) >= WINDOW_DOCS:
                    yield names, ids
                    names, ids, held = [], [], 0
        if ids:
            yield names, ids
        encode.forget()  # the worker lives on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        for names, ids in windows(batches):
            out: list[list] = [[] for _ in range(8)]
            last = -1
            for i, start, n, seq, offset in plan(np.array([len(x) for x in ids]), capacity, linear, quadratic):
                piece = ids[i][start : start + n].astype("<u4").tobytes()
                for column, value in zip(out, (names[i], start, n, zlib.crc32(piece), len(ids[i]), first + seq, offset, piece), strict=True):
                    column.append(value)
                last = max(last, seq)
            first += last + 1
            kinds = [pa.int64()] * 7 + [pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)][: 7 + with_ids]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids])

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
