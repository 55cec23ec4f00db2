"""Texts that begin others, by one pass over sorted texts with a stack.

In sorted order all that a text begins stands right behind it. A range of texts is read once; on the stack are the texts that the one
just read begins with. What stands in an earlier range can only be on the stack if it begins the first text of this one, so each
range is given the beginnings of its first text, looked up by equality: a row for each character of one text a range. No text is
cut into its beginnings, and a beginning of very many texts costs its pairs, split by range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorloom.operators.shared import materialize

_PAIRS = 50_000


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each range; its rows are the beginnings carried into it, then its own texts in order."""
    part, held, shorter, longer = None, [], [], []
    for b in batches:
        for own, text, begins, free, asked in zip(*(b.column(c).to_pylist() for c in ("part", "text", "begins", "free", "asked")), strict=True):
            if own != part:
                part, held = own, []
            while held and not text.startswith(held[-1][0]):
                held.pop()
            if begins:
                held.append((text, free))
            if not asked:
                continue
            for s, any_place in held:
                if any_place or len(s) == len(text) or text[len(s)] == " ":
                    shorter.append(s)
                    longer.append(text)
            if len(shorter) >= _PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(shorter), pa.array(longer)], ["shorter", "longer"])
                shorter, longer = [], []
    if shorter:
        yield pa.RecordBatch.from_arrays([pa.array(shorter), pa.array(longer)], ["shorter", "longer"])


def prefix_pairs(begins: DataFrame, texts: DataFrame) -> DataFrame:
    """``(shorter, longer)``: each text of ``begins`` with the texts of ``texts`` that it begins, itself included. ``begins`` has
    ``text`` and ``free``: true if anything may follow, false if a text must end or go on with a space there. Texts are
    distinct or not; null ones are in no pair, nor does an empty text begin any."""
    one = begins.filter("text != ''").select("text", F.lit(True).alias("begins"), "free", F.lit(False).alias("asked"))
    one = one.union(texts.filter("text is not null").select("text", F.lit(False), F.lit(False), F.lit(True)))
    each = one.groupBy("text").agg(*(F.max(c).alias(c) for c in ("begins", "free", "asked")))
    rows = each.repartitionByRange("text").sortWithinPartitions("text").withColumn("part", F.spark_partition_id())
    rows = materialize(rows, "sorted")
    first = rows.groupBy("part").agg(F.min("text").alias("first"))
    starts = first.filter("length(first) > 1").select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("first") - 1), lambda n: F.substr("first", F.lit(1), n))).alias("text"))
    carried = rows.filter("begins").select("text", "begins", "free").join(starts, "text").select("part", "text", "begins", "free", F.lit(False).alias("asked"), F.lit(0).alias("place"))
    both = rows.select("part", "text", "begins", "free", "asked", F.lit(1).alias("place")).union(carried)
    return both.repartition("part").sortWithinPartitions("part", "place", "text").mapInArrow(_stack, "shorter string, longer string")
