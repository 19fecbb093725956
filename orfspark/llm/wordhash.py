"""Vectorised word and shingle hashing over the flat UTF-8 buffer of an Arrow string column.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``; those six are single bytes in
UTF-8, so the byte view and the code point view agree.  All arrays are numpy ``uint64`` with wrap-around
arithmetic.  A null text has no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values, after adding ``seed``."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0xD1342543DE82EF95 + _BASE) & _MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _byte_table(seed: int, lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint64(32), codes)
    return mix64(codes, seed + 101)


_TABLES: dict[tuple[int, bool], np.ndarray] = {}
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(_SPACES)] = True


@dataclass
class Words:
    """Words of ``n_docs`` texts, in order; ``doc`` is non-decreasing, ``first[d]:first[d + 1]`` are those of text d."""

    buffer: np.ndarray  # uint8
    start: np.ndarray  # byte where each word begins
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    text_start: np.ndarray
    text_end: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string column, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[where[0] : where[-1]], where - where[0]


def split_words(texts: pa.Array) -> Words:
    buffer, offsets = flat(texts)
    word = ~_IS_SPACE[buffer]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    # a text's end also ends a word, and its start begins one
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(buffer))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(buffer, start, end, doc, first, offsets[:-1], offsets[1:])


def word_hashes(words: Words, seed: int = 0, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, from a polynomial over random byte codes, evaluated by prefix sums."""
    key = (seed, lower)
    if key not in _TABLES:
        _TABLES[key] = _byte_table(seed, lower)
    n = len(words.buffer)
    if not len(words.start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        terms = _TABLES[key][words.buffer]
        terms *= powers(n)
        prefix = np.empty(n + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(terms, out=prefix[1:])
        total = (prefix[words.end] - prefix[words.start]) * powers(n, inverse=True)[words.start]
        return mix64(total + (words.end - words.start).astype(np.uint64), seed)


def joined(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words (those that ``keep`` marks), one space after each, and where each of them begins there; then the end."""
    start, end = (words.start, words.end) if keep is None else (words.start[keep], words.end[keep])
    begin = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start + 1, out=begin[1:])
    out = np.full(begin[-1], 0x20, np.uint8)
    size = end - start
    place = np.repeat(begin[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[place] = words.buffer[place + np.repeat(start - begin[:-1], size)]
    return out, begin


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of one odd base, or of its inverse modulo 2 ** 64. Both are kept as long as the longest step needs."""
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.ones(1, np.uint64) if have is None else have
            while len(have) < n:
                more = have[: n - len(have)] * np.uint64(pow(base, len(have), 1 << 64))
                have = np.concatenate([have, more])
        _POWERS[base] = have
    return have[:n]


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` consecutive words; entry i begins at word i. Runs over text ends are not removed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if width <= 8:
            out = np.zeros(n, np.uint64)
            for k in range(width):
                out *= np.uint64(_BASE)
                out += hashes[k : k + n]
        else:
            out = run_hashes(hashes, np.arange(n), np.arange(width, len(hashes) + 1))
        return mix64(out, seed + 7)


def run_hashes(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A polynomial of the hashes in each range [first, stop), the same wherever the range stands."""
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(len(hashes)), out=prefix[1:])
        return (prefix[stop] - prefix[first]) * powers(len(hashes), inverse=True)[first]


def shingles(texts: pa.Array, width: int = 5, seed: int = 0, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes per text: sorted values, offsets by text, and the number of words of each text.

    A text with 1 to ``width - 1`` words has one shingle, its whole word sequence.
    """
    words = split_words(texts)
    hashes = word_hashes(words, seed, lower)
    counts = words.count()
    runs = windows(hashes, width, seed)
    begin = np.arange(len(runs))
    inside = words.doc[: len(runs)] == words.doc[width - 1 :] if len(runs) else np.zeros(0, bool)
    values, owner = runs[inside], words.doc[: len(runs)][inside] if len(runs) else begin
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for i, d in enumerate(short):
                own = np.uint64(counts[d])
                for h in hashes[words.first[d] : words.first[d + 1]]:
                    own = own * np.uint64(0xFF51AFD7ED558CCD) + h
                extra[i] = own
        values, owner = np.concatenate([values, mix64(extra, seed + 11)]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    offsets = np.searchsorted(owner, np.arange(len(counts) + 1))
    return values, offsets, counts
