"""Conversations in reply order, without quotes.

Lines that begin with ``>`` signs quote; their number is the level. Runs of lines of one level are passages. Passages are hashed after
normalising (small letters, runs of white space as one space) and joined with the hashes of what earlier messages of the conversation
said themselves: whole, by passage, and by line. Of a passage that nobody said as it is, each line is looked for, and counts if only
one message of the conversation said it. The earliest message that said a unit is the original. A message answers the original of
most quoted characters on its outermost linked level (of as many, the latest); passages that only one message said come before others.
A message without linked quotes answers the message of the turn before; if there is none either, it begins a thread. The conversation is
then put in the order of a walk through this tree in which every message is followed by its answers, each with its own answers,
earlier ones first.

A message that is given twice is one message. Messages of one turn are ordered by a hash. A null conversation is a conversation, a null
turn comes before all others, a null text is empty. Quotes of nothing known are dropped like all others. Lines that announce a quote
(such as "... wrote:") go with it.

The walk is made with joins by message, each round doubling how far a message sees, so that no conversation meets in one task,
however long it is; brothers are put in order by ranges of the whole table, so neither do the answers to one message.
"""

from __future__ import annotations

import re
from functools import reduce
from hashlib import md5
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.arrow import append_columns
from reelmill.llm.store import stored

# Ends of lines that announce a quote.
ANNOUNCES = re.compile(r"(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$")
QUOTE_SIGNS = re.compile(r"(?:[ \t]*>)+")
LINE_END = re.compile(r"\r?\n")
QUOTE = pa.struct([("run", pa.int32()), ("level", pa.int32()), ("h", pa.binary()), ("chars", pa.int64()), ("is_line", pa.bool_())])
NO_TURN = -(1 << 62)
MESSAGE = ["c", "m"]


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def keyed(messages: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Different messages, each with a key: its conversation ``c`` and its place ``m`` in it."""
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    place = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("turn"), F.xxhash64("role", "text").alias("tie"))
    return rows.distinct().select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c"), place.alias("m"), "*")


def units(text: str) -> tuple[str | None, int, list[bytes], list[dict]]:
    """A message's own words, its number of quoted lines, hashes of what it says itself, and what it quotes, by passage and line."""
    lines = []
    for line in LINE_END.split(text):
        signs = QUOTE_SIGNS.match(line)
        lines.append((signs[0].count(">"), line[signs.end() :].removeprefix(" ")) if signs else (0, line))
    following = [level for level, _ in lines[1:]] + [0]
    own, said, quoted, n_quoted = [], [], [], 0
    for run, (level, rows) in enumerate(groupby(zip(lines, following), lambda row: row[0][0])):
        bodies = [body for (_, body), after in rows if level or not (after and ANNOUNCES.search(body))]
        own_words = [n for n in map(normal, bodies) if n]
        passage = " ".join(own_words)
        if not level:
            own += bodies
            said += [passage, *own_words]
            continue
        n_quoted += len(bodies)
        parts = [(passage, False)] + [(n, True) for n in own_words if len(own_words) > 1]
        quoted += [{"run": run, "level": level, "h": md5(n.encode()).digest(), "chars": len(n), "is_line": line} for n, line in parts if n]
    said.append(normal("\n".join(own)))
    return "\n".join(own) if own else None, n_quoted, [md5(n.encode()).digest() for n in dict.fromkeys(said) if n], quoted


def with_units(messages: DataFrame) -> DataFrame:
    """``messages`` with their own words, ``n_quoted``, ``said`` and ``quoted`` in place of ``text``."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            own, n_quoted, said, quoted = zip(*map(units, texts.to_pylist()))
            return [pa.array(own, pa.string()), pa.array(n_quoted, pa.int64()), pa.array(said, pa.list_(pa.binary())), pa.array(quoted, pa.list_(QUOTE))]

        return work

    added = "own string, n_quoted long, said array<binary>, quoted array<struct<run:int,level:int,h:binary,chars:bigint,is_line:boolean>>"
    return append_columns(messages, "text", added, make).drop("text")


def answered(messages: DataFrame) -> DataFrame:
    """For messages with linked quotes: the message ``up`` that they answer, and how many of their quoted units were found."""
    said = messages.select(*MESSAGE, F.explode("said").alias("h"))
    originals = said.groupBy("c", "h").agg(F.min("m").alias("original"), (F.count("*") == 1).alias("clear"))
    quoted = messages.select(*MESSAGE, F.inline("quoted"))
    found = quoted.join(originals, ["c", "h"]).where(F.col("original") < F.col("m"))
    # one deal by message serves the window (a passage, part of one text) and both sums
    passage = F.max((~F.col("is_line")).cast("int")).over(Window.partitionBy(*MESSAGE, "run"))
    found = found.drop("h").repartition(*MESSAGE).withColumn("whole", passage)
    found = found.where(~F.col("is_line") | ((F.col("whole") == 0) & F.col("clear")))
    votes = found.groupBy(*MESSAGE, "level", "clear", "original").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("near"), "clear", "chars", "original"))
    return votes.groupBy(*MESSAGE).agg(best["original"].alias("up"), F.sum("n").alias("n_linked"))


def doubled(pointers: DataFrame, add: bool) -> DataFrame:
    """Follow ``to`` from each message (``c``, ``m``) to the end of its way, each round twice as far; with ``add``, sum ``steps``.

    A message that is at its end isn't joined again, so a round works on the conversations that are longer than it sees."""
    rounds = [stored(pointers, "pointers")]

    def ended() -> DataFrame:
        return reduce(DataFrame.unionByName, [r.where("to is null") for r in rounds])

    while (going := rounds[-1].where("to is not null")).limit(1).count():
        known = ended().unionByName(going)
        far = known.select("c", F.col("m").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("end").alias("far_end"))
        step = going.join(far, ["c", "to"], "left").select(
            *MESSAGE,
            F.col("far").alias("to"),
            (F.col("steps") + F.coalesce("more", F.lit(0)) if add else F.col("steps")).alias("steps"),
            F.coalesce("far_end", "end").alias("end"),
        )
        rounds.append(stored(step, "pointers"))
    return ended()


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (``c``, ``up``, ``m``) with the ``next`` message that has the same ``up``.

    Rows are dealt by ranges of (``c``, ``up``, ``m``); the last row of a range looks at the first one of the range after it."""
    ranged = stored(rows.repartitionByRange("c", "up", "m").withColumn("slice", F.spark_partition_id()), "tree")
    ranged = ranged.withColumn("next", F.lead("m").over(Window.partitionBy("slice", "c", "up").orderBy("m")))
    # a row per range, of which there are at most as many as shuffle partitions
    firsts = ranged.groupBy("slice").agg(F.min(F.struct("c", "up", "m")).alias("first"))
    after = firsts.select("slice", F.lead("first").over(Window.orderBy("slice")).alias("after"))
    beyond = F.when((F.col("after.c") == F.col("c")) & (F.col("after.up") == F.col("up")), F.col("after.m"))
    ranged = ranged.join(F.broadcast(after), "slice", "left").withColumn("next", F.coalesce("next", beyond))
    return stored(ranged.drop("slice", "after"), "tree")


def walk_order(tree: DataFrame) -> DataFrame:
    """The place of each message (``c``, ``m``, ``up``) in the walk through the trees of its conversation, from 0 on."""
    top = F.struct(F.lit(NO_TURN).cast("long").alias("turn"), F.lit(NO_TURN).cast("long").alias("tie"))  # a root above all threads
    rooted = with_next(tree.select(*MESSAGE, F.coalesce("up", top).alias("up")))
    eldest = rooted.groupBy("c", "up").agg(F.min("m").alias("child")).withColumnRenamed("up", "m")
    # the nearest message from here upwards that has a later sibling
    upward = rooted.select(
        *MESSAGE,
        F.when(F.col("next").isNull() & (F.col("up") != top), F.col("up")).alias("to"),
        F.lit(0).cast("long").alias("steps"),
        F.col("next").alias("end"),
    )
    after = doubled(upward, add=False).select(*MESSAGE, F.col("end").alias("later"))
    follows = rooted.select(*MESSAGE).join(eldest, MESSAGE, "left").join(after, MESSAGE)
    follower = F.coalesce("child", "later")
    chain = follows.select(*MESSAGE, follower.alias("to"), F.when(follower.isNull(), 0).otherwise(1).cast("long").alias("steps"), follower.alias("end"))
    rest = doubled(chain, add=True).select(*MESSAGE, F.col("steps").alias("rest"))
    size = rest.groupBy("c").agg(F.max("rest").alias("last"))
    return rest.join(size, "c").select(*MESSAGE, (F.col("last") - F.col("rest")).alias("position"))


def reply_ordered(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per different message: ``conv_id``, ``position`` (its place in the conversation in reply order, from 0), ``turn``, ``role``,
    ``text`` (its own words, without quotes), ``reply_to`` (turn of the message that it answers), ``n_quoted`` (quoted lines),
    ``n_linked`` (quoted passages and lines whose original was found) and ``formatted`` (the message in the chat template)."""
    all_messages = stored(with_units(keyed(messages, conv_id, turn, role, text)), "messages")
    linked = answered(all_messages)
    before = all_messages.where(F.col("m.turn") > NO_TURN).groupBy("c", F.col("m.turn").alias("t")).agg(F.max("m").alias("previous"))
    tree = all_messages.select(*MESSAGE, (F.col("m.turn") - 1).alias("t")).join(before, ["c", "t"], "left").join(linked, MESSAGE, "left")
    tree = stored(tree.select(*MESSAGE, F.coalesce("up", "previous").alias("up"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "answers")
    placed = all_messages.select(*MESSAGE, "conv_id", "turn", "role", "own", "n_quoted").join(tree, MESSAGE).join(walk_order(tree), MESSAGE)
    words = F.regexp_replace(F.btrim(F.coalesce("own", F.lit("")), F.lit(" \t\r\n")), r"\n{3,}", "\n\n")
    return placed.select(
        "conv_id", "position", "turn", "role", words.alias("text"),
        F.col("up.turn").alias("reply_to"),
        "n_quoted",
        "n_linked",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), words, F.lit("\n<|end|>\n")).alias("formatted"),
    )
