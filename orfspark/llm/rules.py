"""Rule statistics of whole texts, and an isolation forest over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .wordhash import Words, flat, mix64, split_words, windows, word_hashes

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
FEATURES = ("word_length", "symbols", "duplicate_lines", "repeated_words", "upper", "marks")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?;:\"'()[]{}=+/\\~^_@-"]] = True


def _per_text(flags: np.ndarray, words: Words) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[words.text_end] - total[words.text_start]


def _duplicates(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True where a value occurs at least twice under its owner, and a second array, true where it occurred before."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    o, v = owner[order], values[order]
    same = np.zeros(len(v), bool)
    same[1:] = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, later = np.zeros(len(v), bool), np.zeros(len(v), bool)
    out[order], later[order] = twice, same
    return out, later


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (int64), and ``features`` (rows by FEATURES)."""
    words = split_words(texts)
    buffer, n = words.buffer, words.count().astype(np.int64)
    hashes = word_hashes(words)
    d = len(n)
    word_chars = _per_text(_HEAD[buffer] & ~_SPACE[buffer], words)
    symbols = _per_text(_SYMBOL[buffer], words)

    # lines that hold a word: hash of the line's bytes, by text
    newline = np.flatnonzero(buffer == 10)
    line_start = np.unique(np.concatenate([words.text_start[words.text_end > words.text_start], newline + 1]))
    line_start = line_start[line_start < len(buffer)]
    text_stop = words.text_end[np.searchsorted(words.text_end, line_start, side="right")]
    line_end = np.minimum(np.append(newline, len(buffer))[np.searchsorted(newline, line_start)], text_stop)
    first_word = np.searchsorted(words.start, line_start)
    last_word = np.searchsorted(words.start, line_end)
    full = last_word > first_word
    line_start, line_end, first_word = line_start[full], line_end[full], first_word[full]
    as_words = Words(buffer, line_start, line_end, words.doc, words.first, words.text_start, words.text_end)
    line_doc = words.doc[first_word] if len(first_word) else first_word
    line_hash = word_hashes(as_words, seed=21)
    _, again = _duplicates(line_doc, line_hash)
    dup_lines = np.bincount(line_doc[again], minlength=d).astype(np.int64)
    n_lines = np.bincount(line_doc, minlength=d)

    runs = windows(hashes, 5, 3)
    inside = np.flatnonzero(words.doc[: len(runs)] == words.doc[4:]) if len(runs) else np.zeros(0, np.int64)
    twice, _ = _duplicates(words.doc[inside], runs[inside])
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, inside[twice], 1)
    np.add.at(edge, inside[twice] + 5, -1)
    covered = np.cumsum(edge[:-1]) > 0
    repeat_words = np.bincount(words.doc[covered], minlength=d).astype(np.int64)

    # shares with a few typical words added to each text, so that short texts do not look odd by chance
    features = np.stack([
        (word_chars + 50) / (n + 10), np.minimum(symbols / (n + 5), 2), dup_lines / (n_lines + 2), repeat_words / (n + 10),
        _per_text(_UPPER[buffer], words) / (_per_text(_LETTER[buffer], words) + 50), _per_text(_MARK[buffer], words) / (word_chars + 50),
    ], axis=1)
    return {"n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "features": features}


def _usual_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random split trees over a bounded sample; a point's score is 2 ** (-mean path length / usual path length).

    Trees are grown from ``sample``, the usual rows, but cut the whole box from ``low`` to ``high``: so a statistic that is
    constant among usual rows still isolates the rows that differ in it.
    """

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 100, tree_rows: int = 256, depth: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size, self.depth = min(tree_rows, len(sample)), depth
        self.trees = [self._grow(sample[rng.permutation(len(sample))[: self.size]], low, high, rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        feature, cut, right, path = [], [], [], []
        wide = np.flatnonzero(high > low)

        def node(part: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
            at = len(feature)
            for column, value in ((feature, -1), (cut, 0.0), (right, 0), (path, depth + float(_usual_path(len(part))))):
                column.append(value)
            if depth == self.depth or len(part) < 2 or not len(wide):
                return at
            f = int(rng.choice(wide))
            feature[at], cut[at] = f, float(rng.uniform(low[f], high[f]))
            below, middle = part[:, f] < cut[at], np.where(np.arange(len(low)) == f, cut[at], 0)
            node(part[below], low, np.where(np.arange(len(low)) == f, middle, high), depth + 1)
            right[at] = node(part[~below], np.where(np.arange(len(low)) == f, middle, low), high, depth + 1)
            return at

        node(rows, low, high, 0)
        return np.array(feature), np.array(cut), np.array(right), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.size or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for feature, cut, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                value = rows[np.arange(len(rows)), np.maximum(f, 0)]
                at = np.where(inner, np.where(value < cut[at], at + 1, right[at]), at)
            total += path[at]
        return np.power(2.0, -(total / len(self.trees)) / max(float(_usual_path(self.size)), 1e-9))
