"""Whole-text encoding by a public tokenizer that splits at white space: every distinct word is encoded once per worker."""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from .wordhash import Words, split_words, word_hashes

#: Distinct words that a worker remembers; beyond it the memory starts anew.
MOST_WORDS = 350_000


class WordEncoder:
    """Token ids of texts, for tokenizers whose normaliser and splitter treat white space as a boundary and drop it.

    No token of such a vocabulary spans white space and no rule looks across it, so a text's ids are its words' ids in
    order; words are the runs between the six ASCII spaces, and what other spaces do stays the tokenizer's business. The
    ASCII marks after a word's last letter or digit are always a piece of their own to the splitter, unless an apostrophe is
    about, and A-Z are lower case to the normaliser; so each piece in lower case is encoded once, many to a call.

    With ``added`` the vocabulary's added tokens are single ids where their literals stand in a text, as the vocabulary file
    has it; without it, literals are text like any other. They are told by case, before anything else is cut.
    """

    #: Pieces of one call.
    TOGETHER = 500

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # literals are cut out before, so this holds for the rest
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in tokens.values()):
            raise ValueError("added tokens must stand for their literals as they are")
        self.added = {t.content.encode(): (i, len(t.content)) for i, t in tokens.items()}
        self.slot = {literal: k for k, literal in enumerate(self.added)}
        # the longest of several that begin at a place
        self.literal = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added and self.added else None
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.size, self.used = 0, 0
        self.begin, self.number = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.left, self.right = (np.zeros(4096 + len(self.added), np.int32) for _ in range(3))
        # added tokens come first
        self.begin, self.number = (self._room(x, len(self.added)) for x in (self.begin, self.number))
        for i, size in self.added.values():
            self.begin[self.size], self.number[self.size] = self.used, 1
            self.ids[self.used], self.right[self.used] = i, size
            self.size, self.used = self.size + 1, self.used + 1

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        """Encode new pieces, put together with spaces; the offsets tell which tokens are whose."""
        groups = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        for i, e in enumerate(self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            size = np.array([len(w) for w in groups[i]])
            begin = np.cumsum(size + 1) - size - 1
            spans = np.array(e.offsets, np.int64).reshape(-1, 2)
            own = np.searchsorted(begin, spans[:, 0], side="right") - 1
            n, m = len(spans), len(size)
            self.ids, self.left, self.right = (self._room(x, self.used + n) for x in (self.ids, self.left, self.right))
            self.begin, self.number = (self._room(x, self.size + m) for x in (self.begin, self.number))
            number = np.bincount(own, minlength=m)
            self.ids[self.used : self.used + n] = e.ids
            self.left[self.used : self.used + n], self.right[self.used : self.used + n] = spans[:, 0] - begin[own], spans[:, 1] - begin[own]
            self.begin[self.size : self.size + m], self.number[self.size : self.size + m] = self.used + np.cumsum(number) - number, number
            self.used, self.size = self.used + n, self.size + m
        self.slots.update(zip(hashes, range(self.size - len(words), self.size), strict=True))

    def _literals(self, words: Words) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words cut before and after the literals of added tokens, which of them are literals, and the slots of those."""
        none = np.zeros(len(words.start), bool), np.zeros(0, np.int64)
        found = list(self.literal.finditer(words.buffer.tobytes())) if self.literal and len(words.start) else []
        begin, end = np.array([m.start() for m in found], np.int64), np.array([m.end() for m in found], np.int64)
        word = np.searchsorted(words.start, begin, side="right") - 1
        # texts lie side by side in the buffer, so what looks like a literal may run over the end of one
        within = [w >= 0 and e <= words.end[w] for w, e in zip(word, end, strict=True)]
        if not any(within):
            return words, *none
        found, begin, end, word = [m for m, x in zip(found, within, strict=True) if x], begin[within], end[within], word[within]
        starts, owner = np.concatenate([words.start, begin, end]), np.concatenate([np.arange(len(words.start)), word, word])
        kind = np.concatenate([np.zeros(len(words.start), bool), np.ones(len(begin), bool), np.zeros(len(end), bool)])
        # a literal comes after an empty piece that begins where it does
        order = np.lexsort((kind, starts, owner))
        starts, owner, kind = starts[order], owner[order], kind[order]
        ends = np.where(np.append(owner[1:] == owner[:-1], False), np.append(starts[1:], 0), words.end[owner])
        full = ends > starts
        starts, ends, owner, kind = starts[full], ends[full], owner[full], kind[full]
        before = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words.start)))])
        cut = Words(words.buffer, starts, ends, words.doc[owner], before[words.first], words.text_start, words.text_end)
        return cut, kind, np.array([self.slot[m[0]] for m in found], np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray, np.ndarray]:
        """Ids, their offsets by text, the pieces, the piece of each token, and the token's place in the memory."""
        words = split_words(texts)
        words, literal, at = self._literals(words)
        words, literal = _pieces(words, literal)
        coded = pa.array(word_hashes(words, 81, lower=True)).dictionary_encode()
        which, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.size + len(distinct) > MOST_WORDS:
            self._forget()
        slots = np.fromiter(map(self.slots.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(slots < 0)
        if len(new):
            where = np.zeros(len(distinct), np.int64)
            where[which[::-1]] = np.arange(len(which))[::-1]
            data, base = words.buffer.tobytes(), self.size
            starts, ends = words.start[where[new]].tolist(), words.end[where[new]].tolist()
            self._learn([distinct[i] for i in new.tolist()], [data[a:b].decode() for a, b in zip(starts, ends, strict=True)])
            slots[new] = np.arange(base, self.size)
        slot = slots[which]
        slot[literal] = at
        number = self.number[slot]
        before = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(number, out=before[1:])
        place = np.repeat(self.begin[slot] - before[:-1], number) + np.arange(before[-1])
        return self.ids[place], before[words.first], words, np.repeat(np.arange(len(slot)), number), place


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_ALNUM
_MARK[0x27] = False
#: Marks after a word that are told apart, at most.
_MOST_MARKS = 6


def _pieces(words: Words, literal: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words cut before the marks at their end, where these follow an ASCII letter or digit or a Latin-1 letter and no
    apostrophe is in the word; ``literal`` ones stay whole. And which of the pieces are literal."""
    buffer, start, end = words.buffer, words.start, words.end.copy()
    if not len(start):
        return words, literal
    for _ in range(_MOST_MARKS):
        end -= _MARK[buffer[end - 1]] & (end - start > 1)
    last = buffer[end - 1]
    latin = (end - start > 1) & (buffer[end - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    quotes = np.zeros(len(buffer) + 1, np.int32)
    np.cumsum(buffer == 0x27, out=quotes[1:])
    cut = ~literal & (end < words.end) & (_ALNUM[last] | latin) & (quotes[words.end] == quotes[start])
    number = 1 + cut
    first = np.cumsum(number) - number
    starts, ends = np.repeat(start, number), np.repeat(words.end, number)
    ends[first[cut]] = end[cut]
    starts[first[cut] + 1] = end[cut]
    cut_words = Words(buffer, starts, ends, np.repeat(words.doc, number), np.append(first, len(starts))[words.first], words.text_start, words.text_end)
    return cut_words, np.repeat(literal, number)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, added=True)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
