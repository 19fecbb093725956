"""Token counts of sections: texts encoded once, token spans joined to section intervals, boundary tokens by a stated rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import column, steps
from .scratch import Scratch
from .tokens import default_vocabulary, encoder

#: Code points of a section, at most, where sections are made from lines.
LINE_CHARS = 400
#: "start": the section of the token's first code point in any. "majority": that with most of its code points, the first of equals.
RULES = ("start", "majority")


def _heads(buffer: np.ndarray) -> np.ndarray:
    """Code points before each byte of the buffer, and in all of it."""
    out = np.zeros(len(buffer) + 1, np.int64)
    np.cumsum((buffer & 0xC0) != 0x80, out=out[1:])
    return out


def _line_sections(buffer: np.ndarray, before: np.ndarray, text_start: np.ndarray, text_end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last code point (exclusive, counted over the buffer) of each section: non-empty lines in parts of ``size``."""
    newline = np.flatnonzero(buffer == 10)
    full = text_end > text_start
    start = np.unique(np.concatenate([text_start[full], newline + 1]))
    start = start[start < len(buffer)]
    doc = np.searchsorted(text_end, start, side="right")
    end = np.minimum(np.append(newline, len(buffer))[np.searchsorted(newline, start)], text_end[doc] if len(doc) else start)
    a, b = before[start], before[end]
    parts = -(-(b - a) // size)
    which = np.repeat(np.arange(len(a)), parts)
    k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = a[which] + k * size
    return doc[which], first, np.minimum(first + size, b[which])


def _allocate(left: np.ndarray, right: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token the number of its section (-1: none), and whether more than one section has a part of it.

    Both sides are sorted and disjoint intervals, so the join is a search of each token's ends.
    """
    right = np.maximum(right, left + 1)
    low, high = np.searchsorted(last, left, side="right"), np.searchsorted(first, right, side="left")
    own = np.where(high > low, low, -1)
    cross = high - low > 1
    if rule == "majority":
        many = np.flatnonzero(cross)
        n = (high - low)[many]
        token = np.repeat(many, n)
        section = low[token] + np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        overlap = np.minimum(last[section], right[token]) - np.maximum(first[section], left[token])
        order = np.lexsort((section, -overlap, token))
        best = np.ones(len(order), bool)
        best[1:] = token[order][1:] != token[order][:-1]
        own[token[order][best]] = section[order][best]
    return own, cross


def attribute(docs: DataFrame, sections: DataFrame | None = None, rule: str = "majority", line_chars: int = LINE_CHARS, vocabulary: str | None = None) -> DataFrame:
    """One row per section: doc_id, section, start, end, tokens, crossing. Tokens of no section come in a row with section -1.

    ``sections(doc_id, start, end)`` has disjoint intervals of code points, numbered by start within a document; without it
    each non-empty line is cut into sections of ``line_chars``. A token over a boundary counts once, by ``rule``, and in
    ``crossing`` of the section that gets it. A null or empty text has no sections of its own; given ones have no tokens.
    Intervals outside a text are kept with what they hold. Rows that repeat an id each give their rows; a null id has no given
    sections. Null or empty intervals are left out. Extra columns are ignored; an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or default_vocabulary()
    Scratch(docs.sparkSession, "attribution")
    docs = docs.select("doc_id", "text")
    given = sections is not None
    if given:
        spans = F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
        docs = docs.join(sections.where("end > start and start >= 0").groupBy("doc_id").agg(spans.alias("spans")), "doc_id", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for step in steps(batches, "text"):
            texts = column(step, "text")
            _, _, words, word, place = encode(texts)
            before = _heads(words.buffer)
            begin = before[words.start[word]]
            left, right = begin + encode.left[place], begin + encode.right[place]
            origin = before[words.text_start]
            token_doc = words.doc[word]
            if not given:
                doc, first, last = _line_sections(words.buffer, before, words.text_start, words.text_end, line_chars)
                own, cross = _allocate(left, right, first, last, rule)
            else:
                # texts are moved apart, so that intervals beyond a text's end reach no other text
                spans = [s or [] for s in column(step, "spans").to_pylist()]
                ends = np.array([max([0, *(x["end"] for x in s)]) for s in spans], np.int64)
                room = np.maximum(ends, before[words.text_end] - origin) + 1
                moved = np.concatenate([[0], np.cumsum(room)])[:-1]
                doc = np.repeat(np.arange(len(step)), [len(s) for s in spans])
                first = np.array([x["start"] for s in spans for x in s], np.int64) + moved[doc]
                last = np.array([x["end"] for s in spans for x in s], np.int64) + moved[doc]
                shift = (moved - origin)[token_doc]
                own, cross = _allocate(left + shift, right + shift, first, last, rule)
                origin = moved
            inside = own >= 0
            tokens = np.bincount(own[inside], minlength=len(first))
            crossing = np.bincount(own[inside & cross], minlength=len(first))
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            outside = np.bincount(token_doc[~inside], minlength=len(step))
            some = np.flatnonzero(outside)
            row = np.concatenate([doc, some])
            none = np.full(len(some), -1)
            yield pa.RecordBatch.from_arrays([
                column(step, "doc_id").take(pa.array(row)), pa.array(np.concatenate([number, none]).astype(np.int32)),
                pa.array(np.concatenate([first - origin[doc], none]), mask=np.concatenate([np.zeros(len(doc), bool), none < 0])), pa.array(np.concatenate([last - origin[doc], none]), mask=np.concatenate([np.zeros(len(doc), bool), none < 0])),
                pa.array(np.concatenate([tokens, outside[some]])), pa.array(np.concatenate([crossing, none * 0])),
            ], ["doc_id", "section", "start", "end", "tokens", "crossing"])

    return docs.mapInArrow(rows, "doc_id long, section int, start long, end long, tokens long, crossing long")
