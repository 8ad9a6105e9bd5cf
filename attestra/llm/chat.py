"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its reply, the only trainable
part, given as code points ``mask_start`` to ``mask_end`` of the example. Turns after the last reply are in no
example's context; a conversation that has some gets one more example, with all its turns and an empty mask.

Template of a turn: ``<|im_start|>role``, a newline, the text, ``<|im_end|>``, a newline. In roles and texts ``&`` becomes
``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles also a newline ``&#10;``), so no text can hold a control string, and
reading back undoes it exactly.

Defined results: a null text or role counts as empty; turns go by number (null first), ties by role, then text; rows
that repeat are turns of their own; rows with a null conv_id are one conversation; other columns are ignored; an empty table gives
no examples. Only built-in functions are used. A conversation's turns are gathered into one row, as each example needs all turns
before it: a conversation must fit a task's memory, and its examples take the square of its turns, which is the method's nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))
    return F.replace(c, F.lit("\n"), F.lit("&#10;")) if role else c


def unescaped(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("&#10;"), F.lit("\n")) if role else c
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, mask_start, mask_end, last): examples by number from 0; ``last`` is the one that holds all turns."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escaped(t["role"], role=True), F.lit("\n"))
    tail = F.lit(END + "\n")
    # A turn's text up to its reply and with it: lengths let every mask be told without looking for it again.
    rows = rows.select("conv_id", F.size("turns").alias("n"), F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.length(head(t)).alias("head"), F.concat(head(t), escaped(t["text"]), tail).alias("said"))).alias("turns"))
    ends = F.filter(F.transform("turns", lambda t, i: F.when(t["reply"], i + 1)), lambda i: i.isNotNull())
    ends = F.when(F.coalesce(F.element_at(F.col("turns"), -1)["reply"], F.lit(False)), ends).otherwise(F.concat(ends, F.array("n")))
    rows = rows.select("conv_id", "n", "turns", F.posexplode(ends).alias("example", "end"))
    own = F.element_at("turns", F.col("end"))
    rows = rows.select("conv_id", "example", F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("end")), lambda t: t["said"]), "").alias("formatted"), own.alias("own"), (F.col("end") == F.col("n")).alias("last"))
    stop = F.length("formatted") - len(END) - 1
    start = F.length("formatted") - F.length("own.said") + F.col("own.head")
    return rows.select("conv_id", "example", "formatted", F.when(F.col("own.reply"), start).otherwise(0).alias("mask_start"), F.when(F.col("own.reply"), stop).otherwise(0).alias("mask_end"), "last")


def turns_of(formatted: Column) -> Column:
    """The (role, text) structs that a formatted example holds."""
    said = F.split(formatted, r"<\|im_end\|>\n")
    said = F.slice(said, F.lit(1), F.size(said) - 1)
    role = lambda s: F.substring_index(F.substr(s, F.lit(len(START) + 1)), "\n", 1)
    return F.transform(said, lambda s: F.struct(unescaped(role(s), role=True).alias("role"), unescaped(F.substr(s, F.length(role(s)) + (len(START) + 2))).alias("text")))


def reply_of(formatted: Column, start: Column, end: Column) -> Column:
    """What the mask covers, unescaped."""
    return unescaped(F.substr(formatted, start + 1, end - start))
