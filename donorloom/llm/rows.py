"""Keys of rows, and joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorloom.operators.shared import materialize

#: Rows of one key that one task of a join takes.
KEY_ROWS = 200_000


def row_key(doc_id: Column | str, text: Column | str) -> Column:
    """Key of a row, never null: a 64-bit hash of its id and its text. Rows equal in both have the same."""
    return F.xxhash64(F.isnull(doc_id), doc_id, F.isnull(text), text)


def spread_join(many: DataFrame, few: DataFrame, on: list[str], key_rows: int | None = None, most: int | None = None) -> DataFrame:
    """Inner join of ``many`` with ``few``. Keys with more than ``key_rows`` rows of ``many`` are found by counting; those
    rows are dealt by a hash of all their columns, which a task that runs again deals alike, to as many parts as they need, and the
    rows of ``few`` of such a key go to each of its parts. Keys are not counted where the rows of the largest are known to be fewer:
    by ``most``, or as a written table has no more in all (its footers tell)."""
    size = key_rows or KEY_ROWS
    if most is None and hasattr(many, "_table"):
        most = many.count()
    if most is not None and most <= size:
        return many.join(few, on)
    hot = many.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > size)
    hot = materialize(hot.select(*on, F.ceil(F.col("_n") / size).cast("int").alias("_parts")), "hot-keys")
    if hot.isEmpty():
        return many.join(few, on)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(F.lit(17), *many.columns), parts).cast("int")).drop("_parts")
    copied = few.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*on, "_part"]).drop("_part")
