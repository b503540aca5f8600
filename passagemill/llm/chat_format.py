"""Operator 8: chat formatting by prefix-target expansion. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Reversible; the result holds no ``<|``. A backslash becomes \\0 and the bar of ``<|`` becomes \\1."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("<\\1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\1"), F.lit("|")), F.lit("\\0"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\2"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\2"), F.lit("\n")))


def _alone(conv: Column) -> Column:
    """Tells rows without a conversation apart."""
    return F.when(conv.isNull(), F.monotonically_increasing_id()).alias("_alone")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): one row for each assistant turn.

    ``text`` holds all turns before it as context and the reply itself; only the code points from loss_start up to
    loss_end, the reply's text, are trainable. If turns follow the last reply, one more row holds the whole
    conversation with nothing trainable, so that no turn is lost.

    A conversation's turns are gathered in one row, in the order of turn, then role and text (ties, repeated rows).
    Null role or text: empty. A row with a null conv_id is a conversation of its own: it says nothing of what came
    before it. Empty table: no rows. Each example repeats what precedes its reply, so a conversation of n replies
    takes room in proportion to n squared, as the method has it.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = turns.select(F.col(conv_col).alias("conv_id"), _alone(F.col(conv_col)), turn_col, role_col, text_col)
    whole = turns.groupBy("conv_id", "_alone").agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")))).alias("_turns"))
    whole = whole.withColumn("_done", F.transform("_turns", lambda t: F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))))
    whole = whole.withColumn("_ends", F.filter(F.transform("_turns", lambda t, i: F.when((t["role"] == "assistant") | (i == F.size("_turns") - 1), i + 1)), lambda i: i.isNotNull()))
    rows = whole.select("conv_id", "_turns", "_done", F.posexplode("_ends").alias("example", "_n"))
    text = F.array_join(F.slice("_done", F.lit(1), F.col("_n")), "")
    reply = F.get(F.col("_turns"), F.col("_n") - 1)
    rows = rows.select("conv_id", "example", text.alias("text"), (reply["role"] == "assistant").alias("_is_reply"), F.length(escape(reply["text"])).alias("_size"))
    end = F.when(F.col("_is_reply"), F.length("text") - len(CLOSE)).otherwise(F.length("text"))
    return rows.select("conv_id", "example", "text", F.when(F.col("_is_reply"), end - F.col("_size")).otherwise(end).alias("loss_start"), end.alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss array<string>, formatted_chars) parsed from formatted rows.

    Turns come from the last example, which holds the whole conversation; loss lists the trainable text of each
    example in order, unescaped; formatted_chars counts the code points of all examples. An example without
    conv_id is a conversation of its own, as ``format_conversations`` makes them.
    """
    trainable = F.expr("substring(text, loss_start + 1, loss_end - loss_start)")
    whole = examples.select("*", _alone(F.col("conv_id"))).groupBy("conv_id", "_alone").agg(
        F.max_by("text", "example").alias("_text"),
        F.array_sort(F.collect_list(F.when(F.col("loss_end") > F.col("loss_start"), F.struct("example", unescape(trainable).alias("text"))))).alias("_loss"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    parts = F.filter(F.split("_text", r"<\|im_end\|>\n"), lambda p: p != "")
    head = len(OPEN)
    turn = lambda p: F.struct(
        _unescape_role(F.substring_index(F.substr(p, F.lit(head + 1)), "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text")
    )
    return whole.select("conv_id", F.transform(parts, turn).alias("turns"), F.transform("_loss", lambda x: x["text"]).alias("loss"), "formatted_chars")
