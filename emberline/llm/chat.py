"""Chat formatting by prefix-target expansion (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import text_of

#: A turn is OPEN role newline text CLOSE. Strings that steer other chat templates are escaped inside texts as well.
OPEN, CLOSE = "<s>", "</s>"
CONTROL = r"(<|\[|<<)(/?(?:s>|INST\]|SYS>>)|\|)"


def escape(text: Column) -> Column:
    """A backslash doubles; the first bracket of a control string gets a backslash behind it."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    """A role on one line: a newline in it is written as backslash N, which escaped text never holds."""
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("\\N"))


def _unrole(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\N"), F.lit("\n")), F.lit("\\"), F.lit("")))
    return F.array_join(parts, "\\")


def expand(turns: DataFrame) -> DataFrame:
    """One row per trainable example of (conv_id, turn, role, text) rows: conv_id, example, n_turns, text, loss_start,
    loss_end, trainable.

    Each assistant turn becomes an example: all turns before it as context, then that reply, whose text alone is under the
    loss mask [loss_start, loss_end) in characters of the formatted text. Turns after the last assistant turn, or all of a
    conversation without one, come as one more example with an empty mask (trainable false), so nothing is dropped.
    Turns are ordered by turn (null first), then role and text; repeated rows are turns of their own. Null texts are empty,
    null roles an empty role; rows with a null conv_id are one conversation. An empty table gives no examples.

    The output holds each turn once for every later reply; that is what the expansion asks for. Contexts are cut from one
    array a conversation, so the shuffle carries every turn once.
    """
    t = turns.select("conv_id", "turn", F.col("role").alias("who"), F.concat(F.lit(OPEN), _role(F.col("role")), F.lit("\n")).alias("head"), escape(text_of()).alias("body"))
    whole = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "head", "body", F.coalesce(F.col("who") == "assistant", F.lit(False)).alias("reply")))).alias("t"))
    n = F.size("t")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(F.col("t"), i - 1)["reply"])
    ends = F.when(F.get(F.col("t"), n - 1)["reply"], replies).otherwise(F.concat(replies, F.array(n)))
    one = whole.select("conv_id", "t", F.posexplode(ends).alias("example", "end"))
    last = F.get(F.col("t"), F.col("end") - 1)
    context = F.array_join(F.transform(F.slice("t", 1, F.col("end") - 1), lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    made = one.select("conv_id", "example", F.col("end").alias("n_turns"), F.concat(context, last["head"]).alias("before"), last["body"].alias("body"), last["reply"].alias("trainable"))
    start = F.length("before")
    return made.select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("before", "body", F.lit(CLOSE)).alias("text"),
        start.alias("loss_start"),
        (start + F.when(F.col("trainable"), F.length("body")).otherwise(0)).alias("loss_end"),
        "trainable",
    )


def parsed(text: Column) -> Column:
    """The turns (role, text) of one formatted example. Escaped texts hold no CLOSE, so splitting is exact."""
    turns = F.transform(F.filter(F.split(text, CLOSE), lambda x: x != ""), lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    return F.transform(
        turns,
        lambda x: F.struct(_unrole(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text")),
    )


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """What the mask covers, unescaped."""
    return unescape(F.substr(text, start + 1, end - start))
