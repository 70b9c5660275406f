"""Chat formatting by prefix-target expansion; built-in functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and
only its reply is trainable (the span loss_start, loss_end in characters of the formatted
text). Turns after the last assistant turn, or a conversation without one, give one last
example with nothing trainable, so that every turn can be read back from the output.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``. The role is URL-encoded. In a text a
backslash is doubled and each control string gets a backslash after its first character,
which is undone by dropping each backslash that no other one follows and halving pairs.

A conversation is one record: its turns meet in one row, as each example holds all turns
before its target. Examples are built one at a time from that row.

Defined results: a null text is empty, a null role is the empty role; rows are ordered by
turn (null first), ties by role and text; repeated rows are turns each; a null id is a
conversation; other columns of the input play no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this template and of the instruction format next to it.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
TARGET = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv, example (from 1), formatted, loss_start, loss_end
    (null: nothing trainable), is_last (it holds the whole conversation)."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    conversations = turns.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(one)).alias("t"))
    pieces = conversations.select(conv, F.transform("t", lambda x: F.struct(
        (x["role"] == TARGET).alias("target"), F.length(escape(x["text"])).alias("n"),
        F.concat(F.lit(START), F.url_encode(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(END)).alias("piece"))).alias("t"))
    ends = F.expr("filter(sequence(1, size(t)), i -> t[i - 1].target or i = size(t))")
    each = pieces.select(conv, "t", F.posexplode(ends).alias("k", "upto"))
    made = each.select(conv, (F.col("k") + 1).alias("example"),
                       F.array_join(F.transform(F.slice("t", F.lit(1), F.col("upto")), lambda x: x["piece"]), "").alias("formatted"),
                       F.element_at("t", F.col("upto")).alias("last"), (F.col("upto") == F.size("t")).alias("is_last"))
    end = F.when(F.col("last.target"), F.length("formatted") - len(END))
    return made.select(conv, "example", "formatted", (end - F.col("last.n")).alias("loss_start"), end.alias("loss_end"), "is_last")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(START) + 1))
        cut = F.instr(body, "\n")
        return F.struct(F.url_decode(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """Text under the loss mask, as it was before the template; null without a mask."""
    return unescape(F.substr(formatted, start + 1, end - start))


def chat_digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back from the examples of each conversation."""
    turns = F.when(F.col("is_last"), read_turns(F.col("formatted")))
    read = examples.select(conv, "example", F.length("formatted").alias("chars"), turns.alias("turns"),
                           read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    line = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = read.select(conv, "example", "chars", F.size("turns").alias("n"), F.when(F.col("turns").isNotNull(), F.sha2(line, 256)).alias("sha"), "loss")
    done = read.groupBy(conv).agg(
        F.max("n").alias("n"), F.max("sha").alias("turns_sha256"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("l"))
    loss = F.array_join(F.transform("l", lambda x: x["loss"]), "")
    return done.select(conv, F.col("n").cast("long").alias("n_turns"), "turns_sha256", F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
