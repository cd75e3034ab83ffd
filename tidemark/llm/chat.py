"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context,
and only its text is under the loss mask. If a conversation does not end with an assistant
turn, one more example holds all of it, with an empty mask, so that no turn is lost.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn. Control strings start with
``<|``. Inside roles and texts a backslash is written twice and ``<|`` as ``<\\|``, so the
escaped text holds no control string and gives the text back.

The last example of a conversation holds all its turns, so a conversation is put together
in one task; examples are rendered one at a time from it.

Results for odd input: null texts and roles are empty; turns are ordered by number (null
first), role and text; rows that repeat a turn are turns of their own; rows with a null
conversation id are one conversation.
Texts are taken whole, however long; an empty table gives an empty result; other columns are
left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def _render(turn: Column) -> Column:
    return F.concat(F.lit(TURN), escaped(turn["role"]), F.lit(TEXT), escaped(turn["text"]), F.lit(END))


def examples(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``example``, ``formatted``, ``loss_start``, ``loss_length`` (characters), ``whole``."""
    turns = (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    count = F.size("turns")
    numbers = F.sequence(F.lit(1), count)
    target = F.filter(
        numbers, lambda i: (F.element_at("turns", i)["role"] == ASSISTANT) | (i == count)
    )
    each = turns.select(
        "conv_id", F.transform("turns", _render).alias("rendered"), "turns", F.posexplode(target).alias("example", "upto")
    )
    last = F.element_at("turns", F.col("upto"))
    trained = last["role"] == ASSISTANT
    formatted = F.array_join(F.slice("rendered", 1, F.col("upto")), "")
    loss_length = F.length(escaped(last["text"]))
    return each.select(
        "conv_id",
        "example",
        formatted.alias("formatted"),
        (F.length(formatted) - F.when(trained, loss_length).otherwise(0) - len(END)).alias("loss_start"),
        F.when(trained, loss_length).otherwise(0).alias("loss_length"),
        (F.col("upto") == F.size("turns")).alias("whole"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    parts = F.split(formatted, "<[|]turn[|]>")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, TEXT, 1)
        text = F.substring_index(F.substring_index(part, TEXT, -1), END, 1)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.slice(parts, 2, F.size(parts) - 1), turn)


def summary(written: DataFrame) -> DataFrame:
    """What the written examples of each conversation hold."""
    turns = parsed(F.col("formatted"))
    plain = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    reply = unescaped(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    read = written.select(
        "conv_id",
        F.when(F.col("whole"), F.size(turns)).alias("n_turns"),
        F.when(F.col("whole"), F.sha2(plain, 256)).alias("turns_sha256"),
        F.struct("example", reply.alias("reply")).alias("reply"),
        F.length("formatted").alias("chars"),
    )
    replies = F.array_join(F.transform(F.sort_array(F.collect_list("reply")), lambda r: r["reply"]), "")
    return (
        read.groupBy("conv_id")
        .agg(
            F.max("n_turns").cast("long").alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            replies.alias("replies"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length("replies").cast("long").alias("loss_chars"),
            F.sha2("replies", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
