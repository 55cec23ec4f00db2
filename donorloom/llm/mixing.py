"""Mixing sources to target weights: documents counted by length, budgets filled by bounded-knapsack sums."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from donorloom.operators.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a source's budget that are left to the exact sum, and documents of one length that are numbered together.
EXACT_WORDS, PART_ROWS = 20_000, 50_000


def fit_budget(lengths: list[int], counts: list[int], budget: int, exact: int = EXACT_WORDS) -> list[int]:
    """How many documents of each length to take for words near to ``budget``. Each length first gives its share of the
    budget, rounded down; longest lengths fill what is left down to about ``exact`` words; those are met as nearly as
    the documents still free can (from below, if two sums are as near), by a subset sum kept as a bit a sum."""
    words = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if words == 0 or budget <= 0:
        return [0] * len(lengths)
    if budget >= words:
        return list(counts)
    taken = [c * budget // words for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    for i in order:
        more = min(counts[i] - taken[i], max(0, left - exact) // lengths[i])
        taken[i] += more
        left -= more * lengths[i]
    most = 2 * left  # a sum further above is not as near as none
    reach, mask = 1, (1 << (most + 1)) - 1
    layers: list[tuple[int, int, int]] = []
    for i in reversed(order):
        free = counts[i] - taken[i]
        if lengths[i] > most or reach >> left & 1:
            break
        free, size = min(free, most // lengths[i]), 1
        while free > 0:
            part = min(size, free)
            layers.append((i, part, reach))
            reach |= reach << (part * lengths[i]) & mask
            free, size = free - part, size * 2
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    over = (above & -above).bit_length()
    at = left + over if over and over < left - below else below
    for i, part, before in reversed(layers):
        if not before >> at & 1:
            taken[i] += part
            at -= part * lengths[i]
    return taken


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    take = fit_budget([int(x) for x in pdf["size"]], [int(x) for x in pdf["count"]], int(pdf["budget"].iloc[0]))
    return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "take": take})


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with ``rank`` (from 0) by code point, null last: sorted over all tasks, then each task's rows are counted on from
    those before it."""
    rows = materialize(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources")
    rows = rows.withColumn("_task", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a task
    starts = rows.groupBy("_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).withColumn("_before", before)
    return rows.join(starts, "_task").withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_task", "_at", "_n", "_first", "_before")


def source_targets(sources: DataFrame, weights: tuple[float, ...], percent: int, repeats: int) -> DataFrame:
    """``target`` for each row ``(key, source, source_size)``: shares of ``percent`` of all sizes by weight, the weights
    repeating over sources by code point (null last), none above ``repeats`` times the source's size, the excess
    shared by weight again among the others until none is above. Each sharing is one sum over the sources."""
    weight = F.element_at(F.lit(list(map(float, weights))), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    rows = _ranked(sources).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats)).drop("rank")
    rows = materialize(rows, "weights")
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    level, full = 0.0, F.col("cap") <= 0
    while True:
        met = rows.agg(F.sum(F.when(full, F.col("cap"))).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if not met["free"]:
            break
        found = (total - (met["capped"] or 0.0)) / met["free"]
        if found <= level:
            break
        level, full = found, F.col("cap") <= F.lit(found) * F.col("weight")
    return rows.withColumn("target", F.when(full, F.col("cap")).otherwise(F.lit(level) * F.col("weight"))).drop("weight", "cap")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), percent: int = 150, repeats: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for every row of ``docs``.

    ``size`` is the number of words (null text: 0). A source's target is met by whole passes over all its documents
    and, for the rest, by documents chosen by length counts; within a length, by a seeded hash of id and text. So a
    document is taken ``copies`` times, at most ``repeats``, and ``taken`` is that many times its size. Documents without
    words are never taken. Null sources are one source; null and repeated ids are rows like others. Reruns agree.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("s"), source_col), F.lit("n")).alias("key"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text_col).alias("order"),
        ),
        "lengths",
    )
    lengths = materialize(rows.groupBy("key", "source", "size").count(), "length-counts")
    sources = lengths.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("count")).cast("long").alias("source_size"))
    sources = source_targets(sources, weights, percent, repeats)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = materialize(
        sources.withColumn("passes", passes).withColumn("budget", F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size")).drop("source"), "targets"
    )
    lengths = lengths.filter("size > 0")
    takes = lengths.join(sources.select("key", "budget"), "key").groupBy("key").applyInPandas(_fit, "key string, size long, take long")
    hot = materialize(lengths.filter(F.col("count") > PART_ROWS).select("key", "size", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts")), "hot-lengths")
    dealt = rows.filter("size > 0").join(hot, ["key", "size"], "left").withColumn("part", F.pmod("order", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    before = F.coalesce(F.sum("count").over(W.partitionBy("key", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = dealt.groupBy("key", "size", "part").count().withColumn("before", before)
    share = cells.join(materialize(takes, "takes"), ["key", "size"])
    share = share.select("key", "size", "part", F.greatest(F.lit(0), F.least(F.col("count"), F.col("take") - F.col("before"))).alias("quota"))
    place = F.row_number().over(W.partitionBy("key", "size", "part").orderBy("order", "doc_id"))
    chosen = dealt.withColumn("place", place).join(share, ["key", "size", "part"]).select("doc_id", "source", "key", "size", (F.col("place") <= F.col("quota")).cast("int").alias("more"))
    chosen = chosen.union(rows.filter("size = 0").select("doc_id", "source", "key", "size", F.lit(0))).join(sources, "key")
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("more")).otherwise(0)
    return chosen.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
