"""Chat formatting: every assistant turn becomes an example of its own. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Break every ``<|`` by a backslash, one more than it has already: no control string is left, and it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on a line of its own: percent signs, line ends and ``<`` are written as codes."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def prefix_target_examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                           text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per example: ``conv_id``, ``example`` (from 0), ``n_turns``, ``formatted``, ``loss_start``, ``loss_end``.

    Each turn of role ``target`` gives an example of all turns up to it; the span from ``loss_start`` to
    ``loss_end`` (code points, from 0) holds its escaped text and nothing else. Turns behind the
    last target, or a conversation without one, come in a closing example without span (null), so no
    turn is lost. Null texts and roles are empty. Turns go by number (null first), then role, then
    text; repeated rows are repeated turns. A conversation is one row here, because every
    example holds all of its past; its examples grow with the square of its turns, by definition.
    """
    one = F.struct(
        F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    whole = turns.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    heads = F.transform("t", lambda x: F.concat(F.lit(START), escape_role(x.role), F.lit("\n")))
    parts = whole.select(
        "conv_id", heads.alias("h"), F.transform("t", lambda x: escape(x.text)).alias("b"),
        F.filter(F.transform("t", lambda x, i: F.when(x.role == target, i + 1)), lambda i: i.isNotNull()).alias("ends"),
    ).withColumn("n", F.size("b"))
    parts = parts.withColumn("s", F.zip_with("h", "b", lambda h, b: F.concat(h, b, F.lit(END))))
    last = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0))
    stops = F.concat(F.transform("ends", lambda e: F.struct(e.alias("stop"), F.lit(True).alias("trained"))),
                     F.when(last < F.col("n"), F.array(F.struct(F.col("n").alias("stop"), F.lit(False).alias("trained"))))
                     .otherwise(F.array().cast("array<struct<stop:int,trained:boolean>>")))
    rows = parts.select("conv_id", "s", "b", F.posexplode(stops).alias("example", "e"))
    rows = rows.select("conv_id", "example", F.col("e.stop").alias("n_turns"), F.col("e.trained").alias("trained"),
                       F.array_join(F.slice("s", F.lit(1), F.col("e.stop")), "").alias("formatted"),
                       F.length(F.element_at("b", F.col("e.stop"))).alias("size"))
    end = F.length("formatted") - len(END)
    return rows.select("conv_id", "example", "n_turns", "formatted",
                       F.when(F.col("trained"), end - F.col("size")).alias("loss_start"), F.when(F.col("trained"), end).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turn(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(blocks, turn)


def trained_text(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped; null without a mask."""
    return unescape(F.substr(formatted, start + 1, end - start))
