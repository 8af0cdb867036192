"""Chat formatting by prefix-target expansion.

A conversation becomes one stream: for every turn `### role: text</turn>` and a line feed.  Every
assistant turn is an example, a row of its own: all preceding turns are its context and only its text
is trainable.  `format_conversations` makes for each what the stream gained since the example before it
(`part`), where the whole context ends, and the span of the trainable text in code points of the
escaped stream; `expand` then writes every example's whole text out, prefix and target, and
`read_examples` reads those texts back.

Inside roles and texts the characters \\ # < : of the control strings are written as \\b \\h \\l \\c, so no
control string can occur in a text and `unescape` gives back every text exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Written form of each reserved character; the backslash comes first and is read back last.
RESERVED = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, written in RESERVED:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(RESERVED):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """(conv_id, example, part, part_start, loss_start, loss_length, context_end): one row per assistant turn.

    Turns follow their number, nulls first; ties by role, then text.  Null roles and texts are empty.
    Repeated rows are turns of their own.  A null conv_id is a conversation like any other.  Turns
    after the last assistant turn are a row without a loss span, so nothing is lost.  Offsets are sums
    over the turns before, so no conversation is gathered; a row holds the turns between two
    assistant turns, which must fit it.  An empty table gives no rows; other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    train = (F.col("role") == trainable).cast("long")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    rows = rows.select("conv_id", train.alias("train"), F.row_number().over(by).alias("at"), F.coalesce(F.sum(train).over(before), F.lit(0)).alias("example"), F.length(head).alias("lead"), F.length(escape(F.col("text"))).alias("body"), F.concat(head, escape(F.col("text")), F.lit(CLOSE)).alias("piece"))
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    size = F.length("piece").cast("long")
    # the assistant turn, if there is one, is the last of its part
    done = rows.groupBy("conv_id", "example").agg(pieces.alias("part"), F.sum(size).alias("n"), F.max("train").alias("train"), F.max(F.when(F.col("train") == 1, F.col("body"))).cast("long").alias("loss_length"))
    done = done.withColumn("part_start", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    end = F.col("part_start") + F.col("n")
    return done.select("conv_id", "example", "part", "part_start", (end - len(CLOSE) - F.col("loss_length")).alias("loss_start"), "loss_length", end.alias("context_end"))


def expand(formatted: DataFrame, rest: bool = False) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_length, last): every example with its whole context written out.

    last marks the longest text of a conversation.  With rest, turns after the last assistant turn make a text
    without a loss span.  A text must fit a row; texts are made where the parts lie and not shuffled.
    """
    by = Window.partitionBy("conv_id").orderBy("example")
    text = F.array_join(F.collect_list("part").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "")
    full = formatted.select("conv_id", "example", text.alias("text"), "loss_start", "loss_length", F.lead("example").over(by).isNull().alias("last"))
    return full if rest else full.where("loss_length IS NOT NULL")


def _turns(units: Column) -> Column:
    field = lambda u, i: unescape(F.regexp_extract(u, r"(?s)\A### ([^:]*): (.*)\z", i))
    return F.transform(units, lambda u: F.struct(field(u, 1).alias("role"), field(u, 2).alias("text")))


def read_examples(expanded: DataFrame) -> DataFrame:
    """(conv_id, example, turns ARRAY<STRUCT<role, text>>, loss, n_chars), from the examples' whole texts and spans, with the rest.

    Each loss is cut from its own example's text; a conversation's turns are read from its longest text, once.
    """
    units = F.when(F.col("last"), F.filter(F.split("text", CLOSE), lambda u: u != "")).otherwise(F.array().cast("array<string>"))
    loss = unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    size = F.when(F.col("last"), F.length("text")).otherwise(0)
    return expanded.select("conv_id", "example", _turns(units).alias("turns"), F.coalesce(loss, F.lit("")).alias("loss"), size.cast("long").alias("n_chars"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, example, turns ARRAY<STRUCT<role, text>>, loss, n_chars), from the examples' parts and spans alone."""
    turns = _turns(F.filter(F.split("part", CLOSE), lambda u: u != ""))
    loss = unescape(F.substring("part", (F.col("loss_start") - F.col("part_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    return formatted.select("conv_id", "example", turns.alias("turns"), F.coalesce(loss, F.lit("")).alias("loss"), F.length("part").cast("long").alias("n_chars"))


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: one row per conversation.

    formatted_chars counts the stream once.  The hashes run over a conversation's examples in order as
    they stream by, so a task holds a batch of them and never a whole conversation.
    """
    kind = read.schema["conv_id"].dataType
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select(F.col("conv_id").cast("string").alias("conv"), "example", F.size("turns").cast("long").alias("n"), said.alias("said"), "loss", F.length("loss").cast("long").alias("m"), "n_chars")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, some = None, None
        close = lambda: pd.DataFrame([(now, some[0], some[1].hexdigest(), some[2], some[3].hexdigest(), some[4])], columns=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        for part in parts:
            done = []
            for conv, n, text, loss, m, size in zip(part["conv"], part["n"], part["said"], part["loss"], part["m"], part["n_chars"], strict=True):
                if some is None or conv != now:
                    if some is not None:
                        done.append(close())
                    now, some = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                some[1].update(text.encode("utf-8"))
                some[3].update(loss.encode("utf-8"))
                some[0], some[2], some[4] = some[0] + n, some[2] + m, some[4] + size
            if done:
                yield pd.concat(done)
        if some is not None:
            yield close()

    sorted_ = rows.repartition("conv").sortWithinPartitions("conv", "example")
    out = sorted_.mapInPandas(run, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.select(F.col("conv").cast(kind).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
