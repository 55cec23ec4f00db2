"""Rows restated by a later filing whose period covers them.

Rows never meet filings. Their distinct filers, forms, periods and days are written once; each filer's periods are swept in order
of their beginnings, with a heap of those still open by how new they are, which gives disjoint segments of one winner each; days find
the last segment that has begun. A filer costs its filings and its calendar, not their product.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from donorloom.functions.cleaning import day_number
from donorloom.operators.shared import materialize


def attach_insert_keys(df: DataFrame, registry: DataFrame) -> DataFrame:
    """``df`` with the insert key of each row's form; 0 for forms that the registry lacks."""
    return df.join(registry.select("form_id", "insert_key"), "form_id", "left").withColumn("insert_key", F.coalesce("insert_key", F.lit(0)))


def filings(df: DataFrame, registry: DataFrame, ein: str = "recipient_ein") -> DataFrame:
    """``(ein, form, pb, pe, insert_key)``: the numeric filings of each filer that has two or more. A form's period is its
    least (begin, end); ends that are no digits count as 0."""
    number = F.when(F.col("form_id").rlike("^[0-9]+$"), F.col("form_id").try_cast("bigint"))
    period = [F.coalesce(F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("bigint")), F.lit(0)) for c in ("period_begin", "period_end")]
    seen = df.select(F.col(ein).alias("ein"), "form_id", number.alias("form"), F.struct(period[0].alias("pb"), period[1].alias("pe")).alias("p")).filter("form is not null")
    seen = seen.groupBy("ein", "form_id", "form").agg(F.min("p").alias("p"))
    periods = seen.groupBy("form_id").agg(F.min("p").alias("p"))
    several = seen.groupBy("ein").agg(F.countDistinct("form").alias("n")).filter("n > 1").select("ein")
    keyed = attach_insert_keys(seen.select("ein", "form_id", "form").join(several, "ein", "left_semi").join(periods, "form_id"), registry)
    return keyed.select("ein", "form", "p.pb", "p.pe", "insert_key")


def calendar(df: DataFrame, ein: str = "recipient_ein") -> DataFrame:
    """All of ``df`` that decides which filing is the newest: distinct filers, forms, periods and days, written once."""
    return materialize(df.select(ein, "form_id", "period_begin", "period_end", "date").distinct(), "calendar")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of filings in order of filer and beginning; only periods that are still open are held."""
    ein, at, begun, out = None, 0, [], []

    def until(stop: int | None) -> None:
        """Segments from ``at`` up to the day before ``stop``, or to the last end."""
        nonlocal at
        while begun and (stop is None or at < stop):
            key, form, end = -begun[0][0], -begun[0][1], begun[0][2]
            if end < at:
                heappop(begun)
                continue
            end = end if stop is None else min(end, stop - 1)
            if out and out[-1][0] == ein and out[-1][3] == form and out[-1][2] == at - 1:
                out[-1][2] = end
            else:
                out.append([ein, at, end, form])
            at = end + 1

    def batch(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["ein", "start", "end", "winner"])

    for b in batches:
        for own, form, first, last, key in zip(*(b.column(c).to_pylist() for c in ("ein", "form", "pb", "pe", "insert_key")), strict=True):
            if own != ein:
                until(None)
                ein = own
                begun.clear()
            else:
                until(first)
            at = first
            if last >= first:
                heappush(begun, (-key, -form, last))
        if len(out) > 1:
            yield batch(out[:-1])
            del out[:-1]
    until(None)
    if out:
        yield batch(out)


def segments(found: DataFrame) -> DataFrame:
    """``(ein, start, end, winner)`` of ``filings``: the days of each filer that some period covers, cut where the newest
    filing (by insert key, then number) changes."""
    rows = found.filter("ein is not null").select(F.col("ein").cast("string").alias("ein"), F.col("form").cast("long").alias("form"), "pb", "pe", F.col("insert_key").cast("long").alias("insert_key"))
    return rows.repartition("ein").sortWithinPartitions("ein", "pb").mapInArrow(_sweep, "ein string, start long, end long, winner long")


def winners(df: DataFrame, registry: DataFrame, ein: str = "recipient_ein") -> DataFrame:
    """``(ein, day, winner)``: the newest filing that covers each day of a filer, as far as any does."""
    days = df.select(F.col(ein).alias("ein"), day_number(F.col("date")).cast("long").alias("day")).filter("day is not null").distinct()
    parts = segments(filings(df, registry, ein)).select("ein", F.col("start").alias("day"), F.struct("end", "winner").alias("segment"))
    both = parts.unionByName(days, allowMissingColumns=True)
    before = W.partitionBy("ein").orderBy("day", F.isnull("segment")).rowsBetween(W.unboundedPreceding, 0)
    found = both.select("ein", "day", F.isnull("segment").alias("asked"), F.last("segment", ignorenulls=True).over(before).alias("segment"))
    return found.filter("asked and day <= segment.end").select("ein", "day", "segment.winner")


def mark_superseded(df: DataFrame, registry: DataFrame, ein: str = "recipient_ein", days: DataFrame | None = None) -> DataFrame:
    """``df`` with ``winner`` (null: no filing covers the row's day) and ``superseded``. ``days`` is the ``calendar`` of ``df``, where
    it has been made already; else it is made here, so ``df`` is read twice, once for five of its columns."""
    best = materialize(winners(calendar(df, ein) if days is None else days, registry, ein), "winners")
    own = F.when(F.col("form_id").rlike("^[0-9]+$"), F.col("form_id").try_cast("bigint"))
    keyed = df.withColumn("_day", day_number(F.col("date")))
    joined = keyed.join(best.withColumnRenamed("ein", "_ein").withColumnRenamed("day", "_d"), (F.col(ein) == F.col("_ein")) & (F.col("_day") == F.col("_d")), "left")
    gone = F.col("winner").isNotNull() & ~F.coalesce(own == F.col("winner"), F.lit(False))
    return joined.withColumn("superseded", gone).drop("_day", "_ein", "_d")


def drop_superseded(df: DataFrame, registry: DataFrame, ein: str = "recipient_ein", days: DataFrame | None = None) -> DataFrame:
    """Rows whose own filing is the newest that covers their day. Undated rows, days that no filing covers and rows of
    filers with fewer than two numeric filings stay; equal rows of one filing all stay."""
    return mark_superseded(df, registry, ein, days).filter(~F.col("superseded")).drop("winner", "superseded")
