"""Chat conversations as training strings, with Spark expressions alone, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, TURN, END = "<|start|>", "<|sep|>", "<|turn|>", "<|end|>\n"
#: Beginnings of control strings, of this template and of other public ones; a backslash parts each in a text.
CONTROL = r"([<\[])(\||/?s>|</?SYS>>|/?INST\])"
#: Numbers that one running sum goes over.
RUN = 256


def escape(text: Column) -> Column:
    """Double every backslash, then put one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role as one block: ``array<struct<role, texts>>`` of a sorted array of turns."""
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))

    def block(start: Column, end: Column) -> Column:
        own = F.slice(turns, start + 1, end - start)
        return F.struct(F.get(turns, start)["role"].alias("role"), F.transform(own, lambda t: t["text"]).alias("texts"))

    return F.zip_with(starts, ends, block)


def _running(numbers: Column, first: Column) -> Column:
    """What stands before each of some numbers, added to ``first``."""
    state = F.struct(first.alias("at"), F.expr("cast(array() as array<bigint>)").alias("all"))
    return F.aggregate(numbers, state, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]


def _sums_before(numbers: Column) -> Column:
    """The same for a long array, RUN numbers at a time, as every step of an array aggregation copies what it has made."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / RUN)), lambda k: F.slice(numbers, (k * RUN + 1).cast("int"), RUN))
    totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda acc, n: acc + n))
    return F.flatten(F.zip_with(runs, _running(totals, F.lit(0).cast("long")), _running))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_spans)`` from rows ``(conv_id, turn, role, text)``.

    A conversation is its rows by turn; rows of equal turn go by role, then text, and repeated rows all stay.
    Null roles and texts are empty. Adjacent turns of one role are merged to a block, their texts parted by a mark, so
    nothing is lost. ``loss_spans`` has (start from 0, length) in code points of each text of ``loss_role``.
    Rows of null id form one conversation; an empty table gives an empty table. A conversation is one string, so it
    must fit one (2 GB).
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    merged = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", _merged(F.col("turns")).alias("blocks"))

    def escaped(b: Column) -> Column:
        return F.struct(escape(b["role"]).alias("role"), (b["role"] == loss_role).alias("loss"), F.transform(b["texts"], escape).alias("texts"))

    def pieces(b: Column, k: Column) -> Column:
        opens = F.length(b["role"]) + len(START) + len(SEP) + F.when(k > 0, len(END)).otherwise(0)
        return F.transform(b["texts"], lambda t, i: F.struct(F.when(i > 0, len(TURN)).otherwise(opens).cast("long").alias("mark"), F.length(t).cast("long").alias("size"), b["loss"].alias("loss")))

    blocks = merged.select("conv_id", F.transform("blocks", escaped).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit(SEP), F.array_join(b["texts"], TURN), F.lit(END))), "")
    laid = blocks.select("conv_id", text.alias("formatted"), F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    laid = laid.withColumn("before", _sums_before(F.transform("pieces", lambda p: p["mark"] + p["size"])))
    placed = F.zip_with("pieces", "before", lambda p, at: F.struct((at + p["mark"]).alias("start"), p["size"].alias("length"), p["loss"].alias("loss")))
    spans = F.transform(F.filter(placed, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return laid.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` that a formatted conversation was made of."""
    blocks = F.split(formatted, r"<\|end\|>\n", -1)

    def turns(block: Column) -> Column:
        parts = F.split(F.substr(block, F.lit(len(START) + 1)), r"<\|sep\|>", 2)
        texts = F.split(F.element_at(parts, 2), r"<\|turn\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescape(F.element_at(parts, 1)).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
