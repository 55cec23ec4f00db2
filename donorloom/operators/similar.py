"""Pairs of names that may be similar, without comparing all names of a block: an index of segments, and bounds from counts.

Two names whose longest common subsequence leaves d characters over (inserted or deleted) agree in one of d + 1 segments into
which the shorter is cut: of all places where the characters left over can stand, take the first segment i before whose end at most i of them
do; it holds none, and exactly i stand before it. So it is found whole in the longer name, moved by at most i places and by as many
modulo 2; what stands behind it bounds the move from the other side. How many can be left over follows from both
lengths and the ratio asked for. Names meet on (block, both lengths, segment's number, its text), nothing else is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that names share at their beginning, the block they are compared in.
BLOCK = 5
#: Fixed values of the comparison: least length, the length from which a lower ratio is enough, both thresholds, and how far below
#: them a pair is still of interest.
LEAST, LONG, THRESHOLDS, BELOW = 15, 20, (92, 90), 5
#: Characters whose counts bound a ratio; all others count as one.
LETTERS = " ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def letter_counts(c: Column) -> Column:
    """How often each character of LETTERS is in a text, and all others together."""
    own = [F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in LETTERS]
    return F.array(*own, F.length(F.translate(c, LETTERS, "")))


def ratio_bound(x: Column, y: Column) -> Column:
    """The most that ``indel_ratio`` of two texts can be, from their ``letter_counts``: no subsequence has more of a character than
    both texts; two empty ones 100."""
    shared = F.aggregate(F.zip_with(x, y, lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
    total = F.aggregate(F.zip_with(x, y, lambda a, b: a + b), F.lit(0), lambda a, b: a + b)
    return F.when(total == 0, 100.0).otherwise(200.0 * shared / total)


def threshold(x: Column, y: Column) -> Column:
    """Ratio from which two names of such lengths are one donor's."""
    return F.when(F.least(x, y) < LONG, float(THRESHOLDS[0])).otherwise(float(THRESHOLDS[1]))


def _least(short: Column) -> Column:
    return F.when(short < LONG, THRESHOLDS[0] - BELOW).otherwise(THRESHOLDS[1] - BELOW)


def _left_over(short: Column, long: Column) -> Column:
    """The most characters that similar names of two lengths leave over."""
    most = F.floor((short + long) * (100 - _least(short)) / 100).cast("int")
    return most - F.pmod(most - (long - short), F.lit(2))


def _cut(i: Column, tail: Column, left_over: Column) -> Column:
    return F.floor(i * tail / (left_over + 1)).cast("int")


def _key(block: Column, short: Column, long: Column, i: Column, text: Column) -> Column:
    return F.xxhash64(block, short, long, i, text)


def _segments(name: Column, block: Column) -> Column:
    """Keys of a name as the shorter of a pair, for each length of the longer; with it, whether both are of one length."""
    n = F.length(name)

    def each(long: Column) -> Column:
        d = _left_over(n, long)
        keys = F.transform(F.sequence(F.lit(0), d), lambda i: _key(block, n, long, i, F.substr(name, BLOCK + 1 + _cut(i, n - BLOCK, d), _cut(i + 1, n - BLOCK, d) - _cut(i, n - BLOCK, d))))
        return F.transform(keys, lambda k: F.struct(k.alias("key"), (long == n).alias("even")))

    return F.flatten(F.transform(F.sequence(n, F.floor(n * (200 - _least(n)) / _least(n)).cast("int")), each))


def _places(name: Column, block: Column) -> Column:
    """Keys of a name as the longer of a pair, for each length of the shorter and each place where a segment can be."""
    n = F.length(name)
    none = F.array().cast("array<bigint>")

    def each(short: Column) -> Column:
        d, more = _left_over(short, n), n - short

        def at(i: Column) -> Column:
            low, high = F.greatest(-i, more - (d - i)), F.least(i, more + (d - i))
            start, size = _cut(i, short - BLOCK, d), _cut(i + 1, short - BLOCK, d) - _cut(i, short - BLOCK, d)
            moves = F.when(low <= high, F.filter(F.sequence(low, F.greatest(low, high), F.lit(2)), lambda s: (start + s >= 0) & (start + s + size <= n - BLOCK))).otherwise(F.array().cast("array<int>"))
            return F.transform(moves, lambda s: _key(block, short, n, i, F.substr(name, BLOCK + 1 + start + s, size)))

        return F.when((n * _least(short) <= short * (200 - _least(short))) & (d >= more), F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(d, F.lit(0))), at))).otherwise(none)

    shortest = F.greatest(F.lit(LEAST), F.ceil(n * (THRESHOLDS[1] - BELOW) / (200 - (THRESHOLDS[1] - BELOW))).cast("int"))
    return F.array_distinct(F.flatten(F.transform(F.sequence(shortest, n), each)))


def similar_candidates(names: DataFrame, block_names: int) -> DataFrame:
    """``(a, b, threshold)`` of all pairs of names (``canonical``, of LEAST characters and two words or more, with their ``block``)
    that can be similar to within BELOW of their threshold. Blocks of up to ``block_names`` names are compared by length
    and by their characters' counts; names of larger ones meet by the index of segments first."""
    own = names.withColumns({"n": F.length("canonical"), "counts": letter_counts(F.col("canonical")), "id": F.xxhash64("canonical")})
    large = names.groupBy("block").agg(F.count("*").alias("size")).filter(F.col("size") > block_names).select("block")
    few = own.join(large, "block", "left_anti")
    side = lambda df, a: df.select("block", *(F.col(c).alias(f"{a}_{c}") for c in ("canonical", "n", "counts")))
    pairs = side(few, "x").join(side(few, "y"), "block").filter(F.col("x_canonical") < F.col("y_canonical")).drop("block")
    many = own.join(large, "block", "left_semi")
    short = many.select("id", F.explode(_segments(F.col("canonical"), F.col("block"))).alias("s")).select(F.col("id").alias("x"), "s.key", "s.even")
    long = many.select(F.col("id").alias("y"), F.explode(_places(F.col("canonical"), F.col("block"))).alias("key"))
    met = short.join(long, "key").filter((~F.col("even") & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y"))).select("x", "y").distinct()
    text = lambda a: many.select(F.col("id").alias(a), *(F.col(c).alias(f"{a}_{c}") for c in ("canonical", "n", "counts")))
    met = met.join(text("x"), "x").join(text("y"), "y").drop("x", "y")
    both = pairs.unionByName(met)
    near = both.withColumn("threshold", threshold(F.col("x_n"), F.col("y_n"))).filter(200 * F.least("x_n", "y_n") / (F.col("x_n") + F.col("y_n")) >= F.col("threshold") - BELOW)
    near = near.filter(ratio_bound(F.col("x_counts"), F.col("y_counts")) >= F.col("threshold") - BELOW)
    x, y = F.col("x_canonical"), F.col("y_canonical")
    return near.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "threshold")
