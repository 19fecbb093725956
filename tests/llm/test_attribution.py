import random

import pytest

import brute
from orfspark.llm import attribution
from orfspark.llm.tokens import default_vocabulary


def _tokens(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).offsets


def _lines(text, size):
    out, at = [], 0
    for line in (text or "").split("\n"):
        out += [(at + k, at + min(k + size, len(line))) for k in range(0, len(line), size)]
        at += len(line) + 1
    return out


def _expected(text, sections, rule):
    """{section: (tokens, crossing)}, -1 for those of none."""
    out = {k: [0, 0] for k in range(len(sections))}
    for a, b in _tokens(text):
        b = max(b, a + 1)
        over = [(min(b, y) - max(a, x), k) for k, (x, y) in enumerate(sections) if min(b, y) > max(a, x)]
        if not over:
            out.setdefault(-1, [0, 0])[0] += 1
            continue
        k = over[0][1] if rule == "start" else max(over, key=lambda o: (o[0], -o[1]))[1]
        out[k][0] += 1
        out[k][1] += len(over) > 1
    return {k: tuple(v) for k, v in out.items()}


def _texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdéüABC!?.,'1", k=rng.randint(1, 25)))
    return ["".join(word() + rng.choice([" ", "\n", "  ", "\n\n"]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "\n", "x" * 5000, "no end", "😀😀 中文字 naïve…\n" * 30]


@pytest.mark.parametrize("rule", attribution.RULES)
@pytest.mark.parametrize("size", [7, 400])
def test_lines(spark, rule, size):
    texts = _texts()
    got = {}
    for r in attribution.attribute(brute.clashing(brute.docs(spark, texts)), rule=rule, line_chars=size).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.tokens, r.crossing)
    for i, t in enumerate(texts):
        sections = _lines(t, size)
        expected = {k: (*(sections[k] if k >= 0 else (None, None)), *v) for k, v in _expected(t, sections, rule).items()}
        assert got.get(i, {}) == expected


def test_given_sections(spark):
    texts = ["alpha beta gamma delta", "second text here", None, ""]
    sections = [(0, 0, 8), (0, 8, 13), (0, 17, 500), (1, 3, 4), (1, 30, 40), (2, 0, 5), (9, 0, 5), (None, 0, 5), (0, 5, 5), (1, None, 3)]
    df = spark.createDataFrame(sections, "doc_id long, start long, end long")
    for rule in attribution.RULES:
        got = {(r.doc_id, r.section): (r.start, r.end, r.tokens, r.crossing) for r in attribution.attribute(brute.docs(spark, texts), df, rule).collect()}
        expected = {}
        for i, t in enumerate(texts):
            own = sorted((a, b) for d, a, b in sections if d == i and a is not None and b > a)
            for k, v in _expected(t, own, rule).items():
                expected[i, k] = (*(own[k] if k >= 0 else (None, None)), *v)
        assert got == expected


def test_counts_add_up_and_odd_rows(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "three four")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], brute.DOCS)
    assert sorted((r.doc_id or 0, r.section, r.tokens) for r in attribution.attribute(df).collect()) == [(0, 0, 2), (1, 0, 2), (1, 0, 2)]
    assert attribution.attribute(brute.docs(spark, {})).collect() == []
    with pytest.raises(ValueError, match="rule"):
        attribution.attribute(df, rule="last")
