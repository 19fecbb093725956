import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from orfspark.llm import arrow, tokens
from orfspark.llm.wordhash import shingles, split_words, windows, word_hashes

TEXT = st.text("ab cA\n\tß.  é", max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    words = split_words(pa.array(texts, pa.string()))
    data = words.buffer.tobytes()
    got = [[data[a:b].decode() for a, b in zip(words.start[x:y], words.end[x:y], strict=True)] for x, y in zip(words.first, words.first[1:], strict=False)]
    assert got == [brute.WORD.findall(t or "") for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_hashes_differ_just_as_words_do(texts):
    for lower in (False, True):
        words = split_words(pa.array(texts, pa.string()))
        fold = lambda w: re.sub("[A-Z]+", lambda m: m[0].lower(), w) if lower else w
        names = [fold(w) for t in texts for w in brute.WORD.findall(t or "")]
        hashes = word_hashes(words, 3, lower).tolist()
        assert len(set(zip(names, hashes, strict=True))) == len(set(names)) == len(set(hashes))
    values, offsets, _ = shingles(pa.array(texts, pa.string()))
    assert np.diff(offsets).tolist() == [len(brute.shingles(t)) for t in texts]


def test_wide_windows_do_not_depend_on_their_place():
    h = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    h[300:360] = h[100:160]
    w = windows(h, 35, 4)
    assert (w[300:326] == w[100:126]).all() and len(np.unique(w)) == len(w) - 26


def test_steps_keep_rows_in_order():
    texts = ["x" * n for n in (0, 5, 50, 3, 3, 200, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(arrow.steps(iter([batch, batch.slice(0, 0)]), "text", 20))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts and len(parts) > 3


def test_encoder_equals_whole_text_encoding(monkeypatch):
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    monkeypatch.setattr(tokens, "MOST_WORDS", 300)  # forgets now and then
    own, rng = tokens.WordEncoder(path), random.Random(1)
    letters = "abcXYZ éÉßñÑ×÷…—'’.,!!&&&$$$--12   \n\t́éﬁİı中文😀don't it's \x1c\x85 "
    for _ in range(250):
        texts = [None if rng.random() < 0.05 else "".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(5)] + ["He said <|endoftext|>, don't!! A.B.C. 3,000.50$ wow… ok×."]
        ids, offsets, words, piece, place = own(pa.array(texts, pa.string()))
        heads = np.concatenate([[0], np.cumsum((words.buffer & 0xC0) != 0x80)])
        for i, t in enumerate(texts):
            a, b = offsets[i], offsets[i + 1]
            expected = whole.encode(t or "", add_special_tokens=False)
            assert ids[a:b].tolist() == expected.ids
            at = heads[words.start[piece[a:b]]] - heads[words.text_start[i]]
            assert list(zip((at + own.left[place[a:b]]).tolist(), (at + own.right[place[a:b]]).tolist(), strict=True)) == expected.offsets


def test_added_tokens_are_those_of_the_vocabulary_file(monkeypatch):
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    whole = Tokenizer.from_file(path)  # as it is
    monkeypatch.setattr(tokens, "MOST_WORDS", 300)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    own, rng = tokens.encoder(path), random.Random(2)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", " ", "\n", "don't", "A.B.", "x!!", "é,", "×", "中", "'", "'s", "12", "end", "…"]
    for _ in range(300):
        texts = [None if rng.random() < 0.05 else "".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(5)] + ["a<|endo", "ftext|>b<|endoftext|>", "<|endoftext|>"]
        ids, offsets, words, piece, place = own(pa.array(texts, pa.string()))
        heads = np.concatenate([[0], np.cumsum((words.buffer & 0xC0) != 0x80)])
        for i, t in enumerate(texts):
            a, b = offsets[i], offsets[i + 1]
            expected = whole.encode(t or "", add_special_tokens=False)
            assert ids[a:b].tolist() == expected.ids
            at = heads[words.start[piece[a:b]]] - heads[words.text_start[i]]
            assert list(zip((at + own.left[place[a:b]]).tolist(), (at + own.right[place[a:b]]).tolist(), strict=True)) == expected.offsets
