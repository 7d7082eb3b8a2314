"""Chat formatting with Spark expressions only, and reading the format back.

A conversation's turns are collected as structs, sorted by turn, and adjacent
turns of one role are merged into a block:

    <|start|>role<|text|>first text<|next|>second text of the same role<|end|>

Control strings inside roles and texts are escaped: ``~`` becomes ``~0`` and then
``<|`` becomes ``<~1``, so what is left of ``<|`` is the template's own, and the
two replacements undone in reverse order give every text back.

Defined results
---------------
* A null role or text is the empty one. Rows of a conversation without turns do
  not exist, so neither does its output; an empty table gives an empty result.
* Turns with equal numbers are ordered by role and then text; a null number is first.
* A null conversation id is a conversation of its own.
* Repeated rows are turns of their own. Very long texts are carried whole; one
  conversation is one output row, so it has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("<~1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def _blocks(turns: Column) -> Column:
    """Arrays of adjacent turns with the same role."""
    last = F.size(turns) - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (
        F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return F.transform(starts, lambda s, j: F.slice(
        turns, s + 1, F.coalesce(F.get(starts, j + 1), F.size(turns)) - s))


def format_chats(df: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv_id: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, and ``segments`` of the same string.

    ``segments`` are its pieces in order; ``loss`` marks those that are texts of
    a role in ``loss_roles``. Put together they are ``formatted``.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = df.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    blocks = turns.select("conv_id", _blocks(F.col("turns")).alias("blocks"))

    def piece(string: Column, loss: Column) -> Column:
        return F.struct(string.alias("string"), loss.alias("loss"))

    def segments(block: Column) -> Column:
        own = F.get(block, F.lit(0))["role"]
        head = piece(F.concat(F.lit(START), escape(own), F.lit(TEXT)), F.lit(False))
        texts = F.transform(block, lambda t, i: F.array(
            piece(F.when(i == 0, F.lit("")).otherwise(F.lit(NEXT)), F.lit(False)),
            piece(escape(t["text"]), own.isin(*loss_roles))))
        return F.concat(F.array(head), F.flatten(texts), F.array(piece(F.lit(END), F.lit(False))))

    made = blocks.select("conv_id", F.filter(
        F.flatten(F.transform("blocks", segments)), lambda s: s["string"] != "").alias("segments"))
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["string"]), "").alias("formatted"),
                       "segments")


def parse_chats(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Add ``turns`` (role, text), taken from the formatted string alone."""
    def quoted(token: str) -> str:
        return rf"\Q{token}\E"

    blocks = F.filter(F.split(formatted, quoted(END)), lambda b: b != "")

    def turns(block: Column) -> Column:
        halves = F.split(block, quoted(TEXT), 2)
        role = unescape(F.substr(F.get(halves, F.lit(0)), F.lit(len(START) + 1)))
        return F.transform(F.split(F.get(halves, F.lit(1)), quoted(NEXT)),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return df.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def digest(df: DataFrame) -> DataFrame:
    """Figures per formatted conversation, read back from the string and its segments."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["string"])), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (parse_chats(df).withColumn("loss", loss)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars")))
