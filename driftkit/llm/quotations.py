"""Conversations linked by what their messages quote, in DataFrame functions only.

A line's quote level is the number of ``>`` before it. The lines of one level
that follow each other are unwrapped and cut into sentences, the passages;
passages are normalised (lower case, single spaces) and hashed. A quoted passage
links to the newest earlier message of the conversation that wrote it itself;
a message replies to the one that most passages of its first quote level link
to. Lines such as "... wrote:" before a quote belong to the quote.

Texts stay in their rows: only hashes of passages are shuffled. The newest
earlier writer is found by ranges of turns, with what comes before a range
carried into it, so a passage that a third of all messages repeat is spread
over as many groups as it has ranges of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RANGE = 4096
# How mail programs introduce a quote.
_INTRODUCES = r"(?i)(?:wrote|writes|schrieb|schreibt|a écrit|écrit|escribió|escribe) ?:$"
_QUOTED = r"^(?:[ \t]*>)+"


def quote_lines(text: Column) -> Column:
    """The lines of a text as (``level``, ``body``) without those that introduce a quote."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, f"({_QUOTED})", 1), "[ \t]", "")).alias("level"),
            F.trim(F.regexp_replace(x, _QUOTED, "")).alias("body"),
        ),
    )
    after = lambda i: F.coalesce(F.get(lines, i + 1)["level"], F.lit(0))
    return F.filter(lines, lambda x, i: ~(x["body"].rlike(_INTRODUCES) & (after(i) > x["level"])))


def own_text(lines: Column) -> Column:
    """What a message says itself: its lines outside quotes, without white space around them."""
    own = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"])
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def passages(lines: Column, level: Column) -> Column:
    """The normalised passages of one level; lines of another level end a passage."""
    joined = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["body"]).otherwise("\u0001")), " ")
    cut = F.split(F.regexp_replace(joined, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda p: F.lower(F.trim(F.regexp_replace(p, r"\s+", " ")))), lambda p: p != "")


def _newest_writer(quoted: DataFrame, written: DataFrame) -> DataFrame:
    """``quoted`` (``conv``, ``hash``, ``turn``) with ``source``: the last earlier turn that wrote the passage."""
    own = written.select("conv", "hash", "turn", F.col("turn").alias("own"))
    rows = own.unionByName(quoted.withColumn("own", F.lit(None).cast("long")))
    rows = rows.withColumn("range", F.floor(F.col("turn") / RANGE))
    before = Window.partitionBy("conv", "hash", "range").orderBy("turn", F.col("own").isNotNull())
    rows = rows.withColumn("near", F.max("own").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = own.groupBy("conv", "hash", F.floor(F.col("turn") / RANGE).alias("range")).agg(F.max("own").alias("last"))
    steps = quoted.select("conv", "hash", F.floor(F.col("turn") / RANGE).alias("range")).distinct()
    ranges = ranges.unionByName(steps.withColumn("last", F.lit(None).cast("long")))
    ranges = ranges.groupBy("conv", "hash", "range").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("conv", "hash").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("conv", "hash", "range", F.max("last").over(earlier).alias("far"))
    # a writer at the quoting turn itself sorts after the quotes of that turn
    found = rows.filter("own is null").join(carried, ["conv", "hash", "range"])
    return found.select("conv", "hash", "turn", F.coalesce("near", "far").alias("source")).filter("source is not null")


def _threads(replies: DataFrame) -> DataFrame:
    """(``conv``, ``turn``, ``thread``, ``depth``) from (``conv``, ``turn``, ``reply_to``), by doubling the steps up."""
    state = stored(
        replies.select("conv", "turn", F.coalesce("reply_to", "turn").alias("up"), F.col("reply_to").isNotNull().cast("int").alias("hops")), "threads"
    )
    while True:
        above = state.select("conv", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("hops").alias("more"))
        joined = stored(state.filter("hops > 0").join(above, ["conv", "up"]), "threads")
        if joined.filter("more > 0").isEmpty():
            return state.select("conv", "turn", F.col("up").alias("thread"), F.col("hops").alias("depth"))
        moved = joined.select("conv", "turn", F.col("top").alias("up"), (F.col("hops") + F.col("more")).alias("hops"))
        state = stored(moved.unionByName(state.filter("hops = 0")), "threads")


def linked_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: (``conv_id``, ``turn``, ``role``, ``reply_to``, ``thread``, ``depth``, ``n_quoted``, ``n_linked``, ``text``).

    ``text`` is the message without quotes, ``reply_to`` the turn it answers
    (null if it quotes nothing known), ``thread`` the turn at the top of its
    replies: ordered by (conv_id, thread, turn), every message follows what it
    answers. ``n_quoted`` and ``n_linked`` count its different quoted passages.
    A null text is an empty message; a null conversation or turn links nothing
    (``thread`` is its turn). Rows with the same conversation and turn are one
    message as far as links go, and each is returned. Of equal votes the newest
    turn wins.
    """
    messages = df.select(
        df[conv].cast("long").alias("conv"), df[turn].cast("long").alias("turn"), df[role].cast("string").alias("role"),
        quote_lines(df[text].cast("string")).alias("lines"),
    )
    levels = F.array_distinct(F.transform("lines", lambda x: x["level"]))
    leveled = messages.filter("conv is not null and turn is not null").select("conv", "turn", "lines", F.explode(levels).alias("level"))
    cut = leveled.select("conv", "turn", "level", F.explode(passages(F.col("lines"), F.col("level"))).alias("passage"))
    hashed = stored(cut.select("conv", "turn", "level", F.xxhash64("passage").alias("hash")).distinct(), "passages")
    quoted, written = hashed.filter("level > 0"), hashed.filter("level = 0").select("conv", "hash", "turn")
    linked = _newest_writer(quoted.select("conv", "hash", "turn").distinct(), written)
    votes = quoted.join(linked, ["conv", "hash", "turn"], "left")
    votes = votes.groupBy("conv", "turn", "level", "source").agg(F.count("*").alias("n"))
    best = F.max(F.when((F.col("level") == 1) & F.col("source").isNotNull(), F.struct("n", "source")))["source"]
    counts = votes.groupBy("conv", "turn").agg(
        best.alias("reply_to"), F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("source").isNotNull(), F.col("n"))).alias("n_linked")
    )
    counts = stored(counts, "votes")
    told = messages.filter("conv is not null and turn is not null").select("conv", "turn").distinct()
    threads = _threads(told.join(counts.select("conv", "turn", "reply_to"), ["conv", "turn"], "left"))
    out = messages.join(counts, ["conv", "turn"], "left").join(threads, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), own_text(F.col("lines")).alias("text"),
    )
