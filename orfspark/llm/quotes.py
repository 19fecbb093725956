"""Quotation linking of messages: nested quote levels, hashes of quoted passages, replies and conversations without quotes.

DataFrame functions only; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, restrict

#: What ends a line that announces a quotation.
ANNOUNCES = r"(?i)\b(wrote|writes|said|schrieb|a écrit|écrit|escribió)\s*:\s*$"
_MARKS = r"^[ \t]*((?:>[ \t]?)*)"
#: What ends a sentence, and what stands for words left out of a quotation.
_SENTENCE, _CUT = r"(?<=[.!?…])\s+|(?<=[。？！])", r"\n|\[?(?:\.\.\.|…)\]?"
#: A part of a passage that so many texts hold at most leads to all of them; a commoner one to those that also have the passage's
#: rarest run of so many words.
_FEW, _RUN = 100, 4
#: Rounds of pointer doubling, at most; enough for chains of 2 ** 40 replies.
_ROUNDS = 40


def normalised(text: Column) -> Column:
    """Lower case, words only, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _digest(text: Column) -> Column:
    return F.when(text != "", F.sha2(text, 256))


def _lines(messages: DataFrame) -> DataFrame:
    """(mid, line, level, body) of messages that quote."""
    quoting = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    each = quoting.select("mid", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line", "raw"))
    marks = F.regexp_extract("raw", _MARKS, 1)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    return each.select("mid", "line", level.alias("level"), F.regexp_replace("raw", _MARKS, "").alias("body"), "raw")


def _parts(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, digest) of the different paragraphs, lines and sentences of each text."""
    paragraphs, lines = F.split(text, r"\n\s*\n"), F.split(text, r"\n")
    sentences = F.flatten(F.transform(F.concat(F.transform(paragraphs, lambda p: F.regexp_replace(p, r"\n", " ")), lines), lambda p: F.split(p, _SENTENCE)))
    each = F.array_distinct(F.transform(F.concat(paragraphs, lines, sentences), normalised))
    return texts.select(*keys, F.explode(each).alias("part")).where("part <> ''").select(*keys, F.sha2("part", 256).alias("digest"))


def _runs(words: str) -> str:
    """Hashes of the runs of _RUN words of an array, or of all its words where it has fewer."""
    return f"transform(sequence(1, greatest(size({words}) - {_RUN - 1}, 1)), i -> xxhash64(array_join(slice({words}, i, {_RUN}), ' ')))"


def _led_by_runs(common: DataFrame, offered: DataFrame, bodies: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(fid, tid) of ``common(fid, digest)``: of the texts that ``offered(digest, tid)`` has for a digest, those that can hold all lines.

    ``bodies(fid, lines)`` and ``texts(tid, words)`` have single spaces between and around words. A text that holds all lines
    has each run of words in them, so the body's rarest run leads to it; a body with a run that no such text has has none.
    """
    asked = bodies.join(common.select("fid").distinct(), "fid", "left_semi")
    runs = f"array_distinct(flatten(transform(transform(lines, x -> split(trim(x), ' ')), w -> {_runs('w')})))"
    asked = scratch.save(asked.select("fid", F.expr(f"explode({runs})").alias("run")), "runs")
    tids = offered.join(common.select("digest").distinct(), "digest", "left_semi").select("tid").distinct()
    # shorter runs than _RUN are whole lines; a text has them at any place
    shorter = [f"transform(sequence(1, size(w)), i -> xxhash64(array_join(slice(w, i, {n}), ' ')))" for n in range(1, _RUN)]
    each = f"explode(array_distinct(concat({', '.join([_runs('w'), *shorter])})))"
    split = texts.join(tids, "tid", "left_semi").select("tid", F.split(F.trim("words"), " ").alias("w"))
    held = split.select("tid", F.expr(each).alias("run"))
    counted = restrict(held, asked.select("run").distinct(), "run").groupBy("run").agg(F.count(F.lit(1)).alias("texts"))
    rarest = asked.join(counted, "run", "left").groupBy("fid").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "run")).alias("least"))
    rarest = scratch.save(rarest.where("least.texts > 0").select("fid", "least.run"), "rarest")
    found = restrict(held, rarest.select("run").distinct(), "run").join(rarest, "run").select("fid", "tid")
    return found.join(common, "fid").join(offered, ["digest", "tid"], "left_semi").select("fid", "tid").distinct()


def _holders(bodies: DataFrame, named: DataFrame, scratch: Scratch) -> DataFrame:
    """(fid, tid) of ``bodies(fid, body)`` and ``named(tid, text)``: the texts that hold all lines of a body, word by word and in order.

    A text is found by a part that it has in common with the body. Equal texts are looked up once.
    """
    asked = scratch.save(_parts(bodies, "body", "fid"), "asked")
    offered = _parts(named, "text", "tid").join(asked.select("digest").distinct(), "digest", "left_semi").distinct()
    offered = scratch.save(offered, "offered")
    known = scratch.save(asked.join(offered.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")), "digest"), "known")
    texts = named.join(offered.select("tid").distinct(), "tid", "left_semi").groupBy("tid").agg(F.min("text").alias("text"))
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    lines = F.filter(F.transform(F.split("body", _CUT), normalised), lambda x: x != "")
    bodies, texts = bodies.select("fid", F.transform(lines, spaced).alias("lines")), texts.select("tid", spaced(normalised(F.col("text"))).alias("words"))
    pairs = known.where(F.col("texts") <= _FEW).join(offered, "digest").select("fid", "tid").distinct()
    common = known.where(F.col("texts") > _FEW).select("fid", "digest")
    if not common.limit(1).isEmpty():
        bodies, texts = scratch.save(bodies, "body-lines"), scratch.save(texts, "words")
        pairs = pairs.union(_led_by_runs(common, offered, bodies, texts, scratch)).distinct()
    # the place after each line, from which the next one is looked for; 0 where one is missing
    end = "aggregate(lines, 1, (at, x) -> if(at = 0 or locate(x, words, at) = 0, 0, locate(x, words, at) + length(x) - 1))"
    return scratch.save(pairs.join(bodies, "fid").join(texts, "tid").where(F.expr(end) > 0).select("fid", "tid"), "holders")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages(conv_id, turn, role, text)``, ordered by conversation, depth, conv_id and turn.

    Columns: conv_id, turn, role, text (without quotes and the lines that announce them), n_quotes (quoted passages),
    quote_levels (deepest nesting), n_linked (passages with an original), reply_conv and reply_turn (the message replied to;
    null if none), conversation and conversation_turn (the message that the thread starts with), depth (replies from it).

    A passage is a run of lines of one level; deeper lines between do not end it, so a passage goes on after a quotation
    inside it. Its words, in lower case, are hashed and looked up among whole unquoted texts, then paragraphs, then lines of
    messages; of equal texts the first of the same conversation before the reply counts, else the first of an earlier
    conversation (by conv_id and turn). A passage not found so is trimmed or put together from parts: it goes, by the same
    choice, to a message that shares a paragraph, line or sentence with it and holds the words of all its lines in order,
    with gaps between lines or where it has an ellipsis. However many messages share a part, none is left out. The message replied to is that of the first level-1 passage with an original.
    Passages without words link to nothing. A message without a link starts a thread. Null texts are empty; null conv_id or
    turn sort first as usual and are not linked to. Rows that repeat a message are messages of their own. Extra columns are
    ignored; an empty table gives an empty result.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    base = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("mid", F.monotonically_increasing_id())
    base = scratch.save(base, "messages")
    lines = scratch.save(_lines(base), "lines")

    # own words of quoting messages; a line that announces a quotation goes with it
    by_message = Window.partitionBy("mid").orderBy("line")
    announces = (F.col("level") == 0) & (F.lead("level").over(by_message) > 0) & F.col("raw").rlike(ANNOUNCES)
    own_lines = lines.withColumn("announces", announces).where("level = 0 and not announces").groupBy("mid")
    own = own_lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n").alias("own"))
    quoting = lines.select("mid").distinct().join(own, "mid", "left").select("mid", F.trim(F.coalesce("own", F.lit(""))).alias("own"))
    bare = base.join(quoting, "mid", "left").select("mid", "conv_id", "turn", "role", F.coalesce(F.regexp_replace("own", r"^\s+|\s+$", ""), "text").alias("text"))
    bare = scratch.save(bare, "bare")

    # passages: for each level, runs of lines not interrupted by a shallower one
    levels = lines.where("level > 0").select("mid", F.col("level").alias("depth")).distinct()
    reach = lines.join(levels, "mid").withColumn("breaks", (F.col("level") < F.col("depth")).cast("int"))
    at_level = Window.partitionBy("mid", "depth").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = reach.withColumn("run", F.sum("breaks").over(at_level)).where("level = depth").groupBy("mid", "depth", "run")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n")
    passages = runs.agg(F.min("line").alias("line"), body.alias("body"))
    passages = scratch.save(passages.select("mid", "depth", "line", "body", _digest(normalised(F.col("body"))).alias("digest")), "passages")

    # originals: whole texts, paragraphs and lines, only where a passage asks for their hash
    wanted = scratch.save(passages.where("digest is not null").select("digest").distinct(), "wanted")
    named = bare.where("conv_id is not null and turn is not null")
    part = lambda rank, pattern: named.select("mid", "conv_id", "turn", F.lit(rank).alias("kind"), F.explode(F.split("text", pattern)).alias("part"))
    whole = named.select("mid", "conv_id", "turn", F.lit(0).alias("kind"), F.col("text").alias("part"))
    parts = whole.unionByName(part(1, r"\n\s*\n")).unionByName(part(2, r"\n")) if not wanted.limit(1).isEmpty() else whole.limit(0)
    offered = parts.withColumn("digest", _digest(normalised(F.col("part")))).join(wanted, "digest", "left_semi")
    asked = passages.where("digest is not null").join(bare.select("mid", "conv_id", "turn"), "mid")

    def before(asked: DataFrame, offered: DataFrame, key: str, name: str) -> DataFrame:
        """``asked`` with the first message offered by its key in its conversation, and that in all, if before it."""
        inside = scratch.save(offered.groupBy(key, "conv_id").agg(F.min(F.struct("turn", "kind", "mid")).alias("near")), f"{name}-inside")
        anywhere = inside.groupBy(key).agg(F.min(F.struct("conv_id", F.col("near.turn").alias("turn"), F.col("near.mid").alias("mid"))).alias("far"))
        found = asked.join(inside, [key, "conv_id"], "left").join(anywhere, key, "left")
        near = F.col("near.turn") < F.col("turn")
        far = F.struct(F.col("far.conv_id").alias("c"), F.col("far.turn").alias("t")) < F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
        return scratch.save(found.select("mid", "depth", "line", "body", "conv_id", "turn", F.when(near, F.col("near")).alias("near"), F.when(far, F.col("far")).alias("far")), name)

    original = F.coalesce("near.mid", "far.mid").alias("original")
    found = before(asked, offered, "digest", "found")
    linked = found.select("mid", "depth", "line", original).where("original is not null")
    loose = found.where("near is null and far is null").select("mid", "depth", "line", "body", "conv_id", "turn", F.sha2("body", 256).alias("fid"))
    if not loose.limit(1).isEmpty():
        named = named.withColumn("tid", F.sha2("text", 256))
        holders = _holders(scratch.save(loose.select("fid", "body").distinct(), "bodies"), named, scratch)
        held = named.join(holders.select("tid").distinct(), "tid", "left_semi").withColumn("kind", F.lit(0))
        trimmed = before(loose.join(holders, "fid"), held, "tid", "trimmed").groupBy("mid", "depth", "line").agg(F.min("near").alias("near"), F.min("far").alias("far"))
        linked = linked.unionByName(trimmed.select("mid", "depth", "line", original).where("original is not null"))
    linked = scratch.save(linked, "linked")

    parent = linked.where("depth = 1").groupBy("mid").agg(F.min(F.struct("line", "original")).alias("at")).select("mid", F.col("at.original").alias("parent"))
    parent = scratch.save(parent, "parents")
    counted = passages.groupBy("mid").agg(F.count(F.lit(1)).alias("n_quotes"), F.max("depth").alias("quote_levels"))
    hits = linked.groupBy("mid").agg(F.count(F.lit(1)).alias("n_linked"))

    # thread starts by pointer doubling: each message names an ancestor and its distance
    up = scratch.save(parent.select("mid", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "up-0")
    for i in range(1, _ROUNDS + 1):
        a, b = up.alias("a"), up.alias("b")
        step = a.join(b, F.col("a.root") == F.col("b.mid"), "left").select("a.mid", F.coalesce("b.root", "a.root").alias("root"), (F.col("a.depth") + F.coalesce("b.depth", F.lit(0).cast("long"))).alias("depth"), F.col("b.mid").isNotNull().alias("moved"))
        step = scratch.save(step, f"up-{i}")
        up = step.drop("moved")
        if step.where("moved").limit(1).isEmpty():
            break

    place = bare.select(F.col("mid").alias("p"), F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    replies = parent.join(up, "mid").join(place.select(F.col("p").alias("parent"), F.col("c").alias("reply_conv"), F.col("t").alias("reply_turn")), "parent")
    replies = replies.join(place.select(F.col("p").alias("root"), F.col("c").alias("conversation"), F.col("t").alias("conversation_turn")), "root").drop("root", "parent")
    out = bare.join(counted, "mid", "left").join(hits, "mid", "left").join(replies, "mid", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    start = lambda c, own: F.when(F.col("depth").isNull(), F.col(own)).otherwise(F.col(c)).alias(c)
    out = out.select("conv_id", "turn", "role", "text", zero("n_quotes"), zero("quote_levels"), zero("n_linked"), "reply_conv", "reply_turn", start("conversation", "conv_id"), start("conversation_turn", "turn"), zero("depth"))
    return out.orderBy("conversation", "conversation_turn", "depth", "conv_id", "turn")
