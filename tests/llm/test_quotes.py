import random

from orfspark.llm import quotes

MESSAGES = "conv_id long, turn long, role string, text string"


def _got(spark, rows, extra=False):
    df = spark.createDataFrame(rows, MESSAGES)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({n: F.lit("x") for n in "mid line level body digest root depth kind original parent conversation".split()})
    return {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}


def test_levels_links_and_threads(spark):
    rows = [
        (1, 0, "user", "How do I boil an egg?\n\nAnd how long?"),
        (1, 1, "assistant", "Put it in water."),
        (1, 2, "user", "> put it   in WATER!\nHow much water?"),
        (1, 3, "assistant", "Ann wrote:\n>> Put it in water.\n> How much water?\nA litre."),
        (2, 0, "user", "> And how long\n\nI wonder too."),
        (2, 1, "user", "> never said by anyone\nHm."),
        (2, 2, "user", ">> put it in water\nDeep only."),
        (2, 3, "user", "> \n>\nEmpty quote"),
        (3, 0, "user", "a > b\nis no quote"),
    ]
    got = _got(spark, rows, extra=True)
    text = {k: r.text for k, r in got.items()}
    assert text[1, 0] == rows[0][3] and text[1, 2] == "How much water?" and text[1, 3] == "A litre." and text[2, 0] == "I wonder too."
    assert text[3, 0] == "a > b\nis no quote" and text[2, 3] == "Empty quote"
    reply = {k: (r.reply_conv, r.reply_turn) for k, r in got.items()}
    assert reply[1, 2] == (1, 1) and reply[1, 3] == (1, 2) and reply[2, 0] == (1, 0) and reply[2, 1] == (None, None) and reply[2, 2] == (None, None)
    assert [(got[k].n_quotes, got[k].quote_levels, got[k].n_linked) for k in ((1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (3, 0))] == [(2, 2, 2), (1, 1, 1), (1, 1, 0), (1, 2, 1), (1, 1, 0), (0, 0, 0)]
    start = {k: (r.conversation, r.conversation_turn, r.depth) for k, r in got.items()}
    assert start[1, 3] == (1, 1, 2) and start[1, 1] == (1, 1, 0) and start[2, 0] == (1, 0, 1) and start[2, 1] == (2, 1, 0)


def test_order(spark):
    rows = [(1, 0, "u", "first words"), (1, 1, "u", "second words"), (1, 2, "u", "> first words\nreply"), (1, 3, "u", "> reply\nreply to it")]
    df = quotes.link_quotes(spark.createDataFrame(rows, MESSAGES))
    assert [r.turn for r in df.collect()] == [0, 2, 3, 1]


def test_a_passage_goes_on_after_a_deeper_one(spark):
    rows = [(1, 0, "u", "alpha beta\ngamma"), (1, 1, "u", "> alpha beta\n>> deeper\n> gamma\nyes")]
    got = _got(spark, rows)
    assert got[1, 1].n_quotes == 2 and (got[1, 1].reply_conv, got[1, 1].reply_turn) == (1, 0)


def test_equal_texts_go_to_the_first_before(spark):
    rows = [(5, t, "u", "same words") for t in (1, 2, 3)] + [(4, 9, "u", "same words"), (5, 0, "u", "> same words\nx"), (5, 4, "u", "> same words\ny"), (3, 0, "u", "> same words\nz")]
    got = _got(spark, rows)
    reply = {k: (r.reply_conv, r.reply_turn) for k, r in got.items()}
    # none earlier in its conversation: the first of an earlier one; the first conversation has none
    assert (reply[5, 4], reply[5, 0], reply[3, 0]) == ((5, 1), (4, 9), (None, None))


def test_trimmed_quotations(spark):
    text = "First paragraph here.\n\nSecond one. It has two sentences\nand three lines\nof text.\n\nThird paragraph, the last."
    quoted = [
        "> First paragraph here.\n>\n> Second one. It has two sentences\n> and three lines\n> of text.",  # two of three paragraphs
        "> and three lines\n> of text.",  # some lines
        "> It has two sentences and\n> three lines of text.",  # a sentence over lines, wrapped anew
        "> Second one.",  # a sentence of a line
        "> First paragraph here.\n> [...]\n> Third paragraph, the last.",  # a gap
        ">> Second one.\n> alpha",
        "> Third paragraph, the last.\n> First paragraph here.",  # not in order
        "> Second one.\n> Never said by anyone.",
        "> econd one.",  # no whole words
    ]
    rows = [(1, 0, "u", "> Second\none"), (1, 1, "u", text), *((1, t, "u", f"{q}\nreply number {t}") for t, q in enumerate(quoted, 2)), (1, 20, "u", text), (1, 21, "u", text + " More."), (2, 0, "u", quoted[1] + "\nx"), (0, 0, "u", quoted[1] + "\ny")]
    got = _got(spark, rows)
    assert [got[1, t].reply_turn for t in range(2, 11)] == [1, 1, 1, 1, 1, None, None, None, None]
    assert [got[1, t].n_linked for t in range(2, 11)] == [1, 1, 1, 1, 1, 1, 0, 0, 0] and got[1, 4].conversation_turn == 1 and got[1, 4].depth == 1
    assert ((got[2, 0].reply_conv, got[2, 0].reply_turn), got[0, 0].reply_conv, got[1, 0].reply_turn) == ((1, 1), None, None)


def test_an_original_with_only_a_common_part(spark):
    common = [(1, t, "u", f"Yes, I agree. Number {t}.") for t in range(1, 120)]
    rows = [(1, 0, "u", "Yes, I agree. The quick brown fox jumps."), *common, (1, 200, "u", "Quick brown fox."), (2, 0, "u", "> Yes, I agree.\n> quick brown fox\nx")]
    got = _got(spark, rows)[2, 0]
    assert (got.n_linked, got.reply_conv, got.reply_turn) == (1, 1, 0)


def test_common_parts_lead_to_all_holders(spark, monkeypatch):
    rng = random.Random(3)
    lines = ["Yes.", "I agree with that.", "No way.", "a b c d e f", "b c", "Why not try it? It is easy.", "…", "d e"]
    some = lambda n: "\n".join(rng.choice(lines) for _ in range(rng.randint(1, n)))
    texts, bodies = sorted({some(6) for _ in range(150)}), sorted({some(3) for _ in range(80)})
    named, asked = spark.createDataFrame(list(enumerate(texts)), "tid long, text string"), spark.createDataFrame(list(enumerate(bodies)), "fid long, body string")
    found = []
    for few in (10**9, 20, 0):
        monkeypatch.setattr(quotes, "_FEW", few)
        found.append({(r.fid, r.tid) for r in quotes._holders(asked, named, quotes.Scratch(spark, "test")).collect()})
    assert len(found[0]) > 200 and found[0] == found[1] == found[2]


def test_odd_rows(spark):
    rows = [(None, 0, None, "hello there"), (1, None, "u", None), (1, 0, "u", ""), (1, 0, "u", ""), (2, 0, "u", "> hello there\n"), (2, 1, "u", ">" * 500 + " x\n" + "> y\n" * 3000)]
    df = quotes.link_quotes(spark.createDataFrame(rows, MESSAGES))
    out = df.collect()
    assert len(out) == 6 and {r.reply_conv for r in out} == {None} and max(r.quote_levels for r in out) == 500
    assert quotes.link_quotes(spark.createDataFrame([], MESSAGES)).collect() == []


def test_long_chain(spark):
    rows = [(1, 0, "u", "word zero")] + [(1, t, "u", f"> word {'zero' if t == 1 else t - 1}\nword {t}") for t in range(1, 40)]
    got = _got(spark, rows)
    assert [got[1, t].depth for t in range(40)] == list(range(40)) and {r.conversation_turn for r in got.values()} == {0}


def test_only_dataframe_functions(spark):
    df = quotes.link_quotes(spark.createDataFrame([(1, 0, "u", "> a\nb")], MESSAGES))
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))
