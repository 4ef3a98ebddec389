"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of
one role are merged into one message by array aggregation, and the messages
are concatenated::

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

Control strings inside texts are escaped reversibly: every ``\\`` is doubled and
``<|`` becomes ``<\\|``, so ``<|`` occurs in the output as markup only.  A new line
inside a role becomes ``<|nl|>``.  The loss mask is kept as segments
(text, loss) whose concatenation is the formatted string; assistant texts are
under the mask, markup is not.

Edge cases: null text and null role are empty; turns are ordered by (turn, role,
text) with nulls first, so ties are defined and repeated rows stay; a null
``conv_id`` is one conversation with a null id; other columns are not read; an
empty table gives an empty result.  One conversation is one output row, so a
conversation must fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
START, SEP, END, NEWLINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"
LOSS_ROLE = "assistant"


def _lit_replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape_text(c: Column) -> Column:
    return _lit_replace(_lit_replace(c, "\\", "\\\\"), "<|", "<\\|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return _lit_replace(escape_text(c), "\n", NEWLINE)


def unescape_role(c: Column) -> Column:
    return unescape_text(_lit_replace(c, NEWLINE, "\n"))


def format_chats(conversations: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """``conv_id``, ``segments`` (array of text and loss) and ``formatted`` of every conversation."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    sorted_turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # where a message starts: the first turn, and each whose role differs from the one before
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get(F.col("turns"), i)["role"] != F.get(F.col("turns"), F.greatest(i - 1, F.lit(0)))["role"]),
    )
    bounds = sorted_turns.withColumn("starts", starts)
    messages = F.transform(
        F.col("starts"),
        lambda s, k: F.struct(
            F.get(F.col("turns"), s)["role"].alias("role"),
            F.transform(
                F.slice(F.col("turns"), s + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns")) - s),
                lambda t: escape_text(t["text"]),
            ).alias("texts"),
        ),
    )
    no = F.lit(False)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of(m: Column) -> Column:
        own = m["role"] == F.lit(loss_role)
        body = F.flatten(
            F.transform(
                m["texts"],
                lambda t, k: F.when(k == 0, F.array(segment(t, own))).otherwise(F.array(segment(F.lit(SEP), no), segment(t, own))),
            )
        )
        head = F.array(segment(F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")), no))
        return F.concat(head, body, F.array(segment(F.lit(END + "\n"), no)))

    return (
        bounds.withColumn("messages", messages)
        .withColumn("segments", F.flatten(F.transform("messages", of)))
        .select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    )


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, as an array."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape_role(F.substring_index(F.substr(block, F.lit(len(START) + 1)), "\n", 1))
        body = F.substr(block, F.instr(block, "\n") + 1)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape_text(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape_text(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
