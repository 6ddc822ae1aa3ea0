"""Words of Arrow text columns as 64-bit hashes, by whole-array arithmetic.

A word of up to 16 bytes is read as two whole numbers, which hold all of it, and these are mixed; a longer one is hashed
with XXH3. So no two short words of equal length share both numbers, and long words that are built alike don't collide
as they do under a polynomial modulo 2**64. Byte classes decide where words end, which is exact for UTF-8 as long as all
separators are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that are hashed in one go; longer texts are cut at separators.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_SALT = np.uint64(0x2545F4914F6CDD1D)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: The first bytes of a number, by how many of them a word has.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

#: Bytes that end words: ASCII white space; or everything in ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def _spans(data: np.ndarray, firsts: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~separators[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = ~word[:-1]
    new[firsts] = True  # a text's first byte
    last = np.ones(len(data), bool)
    last[:-1] = ~word[1:]
    last |= new[1:] & word
    return np.flatnonzero(word & new[:-1]), np.flatnonzero(word & last) + 1


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    folded = np.zeros(len(data) + 16, np.uint8)
    folded[: len(data)] = fold[data]
    lengths = ends - starts
    # the eight bytes that begin at each place, as a number
    eight = np.ndarray(len(data) + 9, "<u8", folded, strides=(1,))
    low = eight[starts] & _MASKS[np.minimum(lengths, 8)]
    out = mixed(low ^ _SALT) + lengths.astype(np.uint64)
    more = np.flatnonzero(lengths > 8)
    high = eight[starts[more] + 8] & _MASKS[np.minimum(lengths[more] - 8, 8)]
    out[more] += mixed(high + np.uint64(_BASE))
    raw = folded.tobytes() if len(more) and int(lengths[more].max()) > 16 else b""
    for i in np.flatnonzero(lengths > 16).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return mixed(out)


def word_hashes(texts: pa.Array, separators: np.ndarray, fold: np.ndarray = LOWER_ASCII) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, bounds): text i has the words ``bounds[i]:bounds[i + 1]``. Null is no text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    parts, firsts_of_words, at = [], [], 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        if end < len(data):  # back to a text's start or just behind a separator, or on to the next one
            inside = offsets[np.searchsorted(offsets, end, "right") - 1]
            cut = np.flatnonzero(separators[data[at:end]])
            end = int(inside) if inside > at else at + int(cut[-1]) + 1 if len(cut) else end
            while end < len(data) and inside <= at and not len(cut):
                more = np.flatnonzero(separators[data[end : end + CHUNK_BYTES]])
                end, cut = (end + int(more[0]) + 1, more) if len(more) else (min(len(data), end + CHUNK_BYTES), cut)
        piece = data[at:end]
        firsts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        starts, ends = _spans(piece, firsts, separators)
        parts.append(_hash_spans(piece, starts, ends, fold))
        firsts_of_words.append(starts + at)
        at = end
    return np.concatenate(parts), np.searchsorted(np.concatenate(firsts_of_words), offsets).astype(np.int64)


def hash_word(word: str) -> int:
    """The hash that ``word_hashes`` gives to this word."""
    return int(word_hashes(pa.array([word]), np.zeros(256, bool))[0][0])


def small_batches(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts take about ``CHUNK_BYTES`` together, one row at least."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the windows of ``k`` words of each text; a text of fewer words has one window of all of them."""
    counts = np.diff(bounds)
    n_windows = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(n_windows)])
    lengths = np.repeat(np.minimum(counts, k), n_windows)
    firsts = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], n_windows) + np.repeat(bounds[:-1], n_windows)
    out = lengths.astype(np.uint64)
    for j in range(k):
        here = j < lengths
        value = hashes[np.minimum(firsts + j, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(len(firsts), np.uint64)
        out = np.where(here, mixed(out * np.uint64(_BASE) + value), out)
    return out, out_bounds
