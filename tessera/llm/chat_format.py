"""Operator 10: conversations as training texts with a loss mask, by Spark expressions only.

A text is `<s>`, blocks of turns and `</s>`. A block is `[INST:role]`, the texts of adjacent
turns of that role with `[NEXT]` between them, and `[/INST]`. Texts and roles are escaped,
so that none of these strings can be in them, and reading a text gives each turn back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
HEAD, HEAD_END, TAIL, NEXT = "[INST:", "]", "[/INST]", "[NEXT]"
#: What starts a control string, or an escape, becomes ~ and a letter.
ESCAPES = [("~", "~t"), ("<", "~l"), ("[", "~b"), ("]", "~r")]


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row for each conversation.

    Turns are put in order of turn, equal ones by role and text; null turns come first,
    null roles and texts are empty. Adjacent turns of a role are merged into one block.
    loss_spans holds (start, length), in code points of `formatted` from 1, of the escaped
    text of each turn of the trained role; marks and separators lie outside. A row without a
    conversation id is a conversation of its own, and repeated rows are repeated turns. An
    empty table gives no rows. Other columns are not read. A conversation's turns meet in
    one row, as it is one training text.
    """
    columns = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
        ).alias("one"),
    )
    each = columns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    each = each.union(columns.where("conv_id is null").select("conv_id", F.array("one")))

    def piece(one: Column, i: Column) -> Column:
        """Marks before a turn's text, the text, marks after it."""
        all_turns = F.col("turns")
        begins = F.coalesce(F.get(all_turns, i - 1)["role"] != one["role"], F.lit(True))
        ends = F.coalesce(F.get(all_turns, i + 1)["role"] != one["role"], F.lit(True))
        before = F.when(begins, F.concat(F.lit(HEAD), escape(one["role"]), F.lit(HEAD_END))).otherwise(NEXT)
        return F.struct(
            before.alias("before"),
            escape(one["text"]).alias("body"),
            F.when(ends, TAIL).otherwise("").alias("after"),
            (one["role"] == trained).alias("trained"),
        )

    def place(so_far: Column, one: Column) -> Column:
        """Where the next piece begins, and the spans of the trained texts up to there."""
        start = so_far["at"] + F.length(one["before"])
        span = F.struct(start.alias("start"), F.length(one["body"]).alias("length"))
        return F.struct(
            (start + F.length(one["body"]) + F.length(one["after"])).alias("at"),
            F.when(one["trained"], F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"]).alias("spans"),
        )

    pieces = each.withColumn("pieces", F.transform("turns", piece))
    begin = F.struct(F.lit(len(BEGIN) + 1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    parts = F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"]))
    return pieces.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(parts, ""), F.lit(END)).alias("formatted"),
        F.aggregate("pieces", begin, place)["spans"].alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), in order, from a formatted conversation."""
    inner = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted) - len(BEGIN) - len(END))
    blocks = F.filter(F.split(inner, r"\[INST:"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        cut = F.instr(block, HEAD_END)
        role = unescape(F.substring(block, F.lit(1), cut - 1))
        texts = F.substring(block, cut + 1, F.length(block) - cut - len(TAIL))
        return F.transform(F.split(texts, r"\[NEXT\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, with nothing between its spans."""
    texts = F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"])))
    return F.array_join(texts, "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations gets back, as counts and digests."""
    turns, loss = F.col("turns"), F.col("loss")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.withColumns({"turns": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("loss_spans"))})
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
