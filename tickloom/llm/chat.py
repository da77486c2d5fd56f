"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; each run of one role is sliced out and its texts aggregated into
a block; and blocks are concatenated under a template. Control strings inside texts are escaped reversibly: ``&``, ``<`` and ``[`` become
``&amp;``, ``&lt;`` and ``&lb;``, so no mark of the template can occur in a text, and the output can be read back.

Template: ``<s>`` block ... ``</s>``; a block is ``<|role|>`` + turn (``<|and|>`` turn)* + ``<|end|>``; roles are escaped
likewise. A role of ``assistant`` carries the loss.

Defined results: null text or role counts as empty; a null turn sorts first; equal turns sort by role, then text, and
all of them stay; a null conv_id is a conversation of its own; an empty table gives an empty result; other columns are
ignored. Only the turns of one conversation meet in a task: they make one string by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, HEAD, TAIL, AND, END = "<s>", "</s>", "<|", "|>", "<|and|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))
#: In roles only, as their mark ends with a bar.
BAR = ("|", "&vb;")


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(BAR[0]), F.lit(BAR[1]))


def unescape(text: Column) -> Column:
    for plain, safe in (BAR, *reversed(ESCAPES)):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def join(parts: Column, between: str = "") -> Column:
    return F.array_join(parts, between)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: one row per conversation of ``turns`` (conv_id, turn, role, text)."""
    said = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("t"))
    t = F.col("t")
    first = F.filter(
        F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1)["role"] != F.get(t, i - 2)["role"])
    )

    def block(run: Column) -> Column:
        texts = join(F.transform(run, lambda x: escape(x["text"])), AND)
        return F.concat(F.lit(HEAD), escape_role(F.get(run, F.lit(0))["role"]), F.lit(TAIL), texts, F.lit(END))

    def blocks(starts: Column) -> Column:
        after = lambda i: F.coalesce(F.get(starts, i + 1), F.size(t) + 1)
        return join(F.transform(starts, lambda at, i: block(F.slice(t, at, after(i) - at))))

    merged = F.get(F.transform(F.array(first), blocks), F.lit(0))
    return sorted_turns.select("conv_id", F.concat(F.lit(OPEN), merged, F.lit(CLOSE)).alias("formatted"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: array of (role, text) parsed from the formatted string alone."""
    body = F.substring(
        F.col("formatted"), F.lit(len(OPEN) + 1), F.char_length("formatted") - F.lit(len(OPEN + CLOSE))
    )
    blocks = F.filter(F.split(body, r"<\|end\|>", -1), lambda b: b != "")

    parsed = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.regexp_replace(b, r"^<\|[^<]*?\|>", ""), r"<\|and\|>", -1),
            lambda t: F.struct(
                unescape(F.regexp_extract(b, r"^<\|([^<]*?)\|>", 1)).alias("role"), unescape(t).alias("text")
            ),
        ),
    )
    return chats.select("conv_id", "formatted", F.flatten(parsed).alias("turns"))


def digests(chats: DataFrame) -> DataFrame:
    """The figures of ``read_back``: turns, loss mask and length, with SHA-256 digests."""
    turn = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    loss = join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]))
    return (
        read_back(chats)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            join(F.transform("turns", turn)).alias("all_turns"),
            loss.alias("loss"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "n_turns",
            F.sha2(F.col("all_turns").cast("binary"), 256).alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
