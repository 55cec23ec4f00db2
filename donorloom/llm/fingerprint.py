"""Homomorphic multiset fingerprints of texts, with Spark expressions alone.

A text is the multiset of its paragraphs (lines) and a number of line breaks. A paragraph is hashed as a whole, to a vector of four
numbers of 60 bits (of its SHA-256 sum); the text's is the sum of them modulo 2**60. So order does not count, paragraphs can be
put in or taken out, and texts of different paragraphs have different fingerprints. An empty paragraph is 0.

For likeness there stands beside it a vector of the clauses of all paragraphs: pieces that end after stops, or after 32
characters. A clause is hashed to 120 bits (of its MD5 sum); the vector counts, for each bit, the clauses that have it set, packed
as 60 numbers of two lanes of 30 bits, and is added modulo 2**60 as well. A clause and what parts it from the next
take two bytes at least, so a text (2 GB at most) has fewer than 2**30 of them and no lane of it overflows. As every bit is a
random vote of a clause, the cosine of two vectors, votes counted as +1 and -1, estimates how much of the texts agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from donorloom.operators.shared import materialize

CLAUSE = r"[^.,;:!?|]{0,31}[.,;:!?|]+ *|[^.,;:!?|]{1,32}"
STEPS, WIDTH = 30, 30
#: Numbers of a paragraph's vector.
WIDE = 4
_PICK = 1 | (1 << WIDTH)
_MODULO = (1 << (2 * WIDTH)) - 1
_LANE = (1 << WIDTH) - 1
#: Rows that a bucket of neighbours should have, and the buckets that one is cut into at a time.
BUCKET_ROWS, FAN = 2000, 1024
#: First rows of buckets whose keys are sent to every executor (16 bytes each) to find their texts; more are joined by a shuffle.
SENT_HEADS = 1 << 18


def _wide(line: Column) -> list[Column]:
    """A paragraph's vector: 60 bits of each quarter of its SHA-256 sum; 0 for an empty one."""
    digits = F.sha2(line.cast("binary"), 256)
    return [F.when(line != "", F.conv(F.substr(digits, F.lit(16 * i + 1), F.lit(15)), 16, 10).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(WIDE)]


def _halves(digits: Column) -> tuple[Column, Column]:
    """60 bits of each half of a sum's 32 hexadecimal digits."""
    return tuple(F.conv(F.substr(digits, F.lit(at), F.lit(15)), 16, 10).cast("long") for at in (1, 17))


def _lane(x: Column, j: int) -> Column:
    return F.shiftrightunsigned(x, j).bitwiseAND(F.lit(_PICK))


def vector(text: Column) -> Column:
    """``array<bigint>`` of one text: clauses, line breaks, the sum of its paragraphs, then the packed counts. Null is as empty. For single values; tables
    go through ``vectors``, which gives the same."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    clauses = F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(CLAUSE), F.lit(0))))
    hashes = F.transform(F.transform(clauses, lambda c: F.md5(c.cast("binary"))), lambda d: F.struct(*(h.alias(n) for h, n in zip(_halves(d), "xy", strict=True))))

    paragraphs = F.transform(lines, lambda line: F.array(*_wide(line)))
    zero = F.array(*[F.lit(0).cast("long")] * WIDE)
    whole = F.aggregate(paragraphs, zero, lambda acc, p: F.zip_with(acc, p, lambda x, y: (x + y).bitwiseAND(F.lit(_MODULO))))

    def packed(h: Column) -> Column:
        def summed(p: str, j: int) -> Column:
            return F.aggregate(h, F.lit(0).cast("long"), lambda acc, v: acc + _lane(v[p], j))

        return F.array(*(summed(p, j) for p in "xy" for j in range(STEPS)))

    counts = F.element_at(F.transform(F.array(hashes), packed), 1)
    return F.concat(F.array(F.size(clauses).cast("long"), (F.size(lines) - 1).cast("long")), whole, counts)


def vectors(rows: DataFrame, text_col: str = "text", name: str = "print") -> DataFrame:
    """The other columns of ``rows``, which must tell the rows apart, and the vector of each text: clauses are rows, added up
    in one aggregation. Where ``rows`` are partitioned by some of these columns, nothing moves."""
    keys = [c for c in rows.columns if c != text_col]
    lines = rows.select(*keys, F.explode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("_line"))
    wide = [f"_w{i}" for i in range(WIDE)]
    lines = lines.select(*keys, "_line", *(w.alias(n) for w, n in zip(_wide(F.col("_line")), wide, strict=True)))
    each = lines.select(*keys, *wide, F.posexplode_outer(F.regexp_extract_all("_line", F.lit(CLAUSE), F.lit(0))).alias("_i", "_c"))
    each = each.withColumn("_d", F.md5(F.col("_c").cast("binary")))
    x, y = (F.coalesce(h, F.lit(0).cast("long")) for h in _halves(F.col("_d")))
    first = F.coalesce("_i", F.lit(0)) == 0  # a paragraph counts at its first clause
    each = each.select(*keys, F.col("_c").isNotNull().cast("int").alias("_n"), first.cast("int").alias("_first"), x.alias("_x"), y.alias("_y"), *(F.when(first, F.col(w)).otherwise(F.lit(0).cast("long")).alias(w) for w in wide))
    sums = {f"_{p}{j}": F.sum(_lane(F.col(f"_{p}"), j)) for p in "xy" for j in range(STEPS)}
    # halves of 30 bits are summed, as a text has fewer than 2**31 paragraphs
    low, high = ({f"{w}{half}": F.sum(f(F.col(w))) for w in wide} for half, f in (("l", lambda c: c.bitwiseAND(F.lit(_LANE))), ("h", lambda c: F.shiftright(c, WIDTH))))
    summed = each.groupBy(*keys).agg(F.sum("_n").alias("_clauses"), (F.sum("_first") - 1).alias("_breaks"), *(s.alias(n) for n, s in (low | high | sums).items()))
    whole = [(F.shiftleft(F.col(f"{w}h").bitwiseAND(F.lit(_LANE)), WIDTH) + F.col(f"{w}l")).bitwiseAND(F.lit(_MODULO)) for w in wide]
    return summed.select(*keys, F.array("_clauses", "_breaks", *whole, *sums).alias(name))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the texts of both, one after the other; the first one ends with its line."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_MODULO)))


def remove(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(_MODULO)))


def printed(v: Column) -> Column:
    """Fingerprint as hexadecimal numbers with dots between."""
    return F.array_join(F.transform(v, lambda x: F.hex(x)), ".")


def votes(v: Column) -> Column:
    """Bits set less bits not set, for each of the 120 bits."""
    counts = F.slice(v, 3 + WIDE, 2 * STEPS)

    def lane(shift: int) -> Column:
        return F.transform(counts, lambda x: F.shiftright(x, shift).bitwiseAND(F.lit(_LANE)))

    return F.transform(F.concat(lane(0), lane(WIDTH)), lambda c: (2 * c - F.element_at(v, 1)).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of structs of a fingerprint ``print``, its ``votes`` and their squared ``norm``: 1 for equal fingerprints,
    otherwise the cosine of the votes, 0 at least."""
    size = F.sqrt(a["norm"] * b["norm"])
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a["votes"], b["votes"]) / size))
    return F.when(a["print"] == b["print"], F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(cosine)


def _place(cuts: Column, value: Column) -> Column:
    """How many of the sorted ``cuts`` are ``value`` or less, by binary search."""
    steps = [1 << i for i in reversed(range(FAN.bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(F.get(cuts, at + s - 1) <= value, at + s).otherwise(at))


def _dealt(rows: DataFrame, keys: list[str], levels: list[DataFrame]) -> DataFrame:
    """``rows`` with ``_bucket``, by the cuts of each level in turn."""
    rows = rows.withColumns({"_bucket": F.lit(0).cast("long"), "_salt": F.monotonically_increasing_id()})
    for cuts in levels:
        value = F.element_at(F.array(*keys, "_salt"), F.col("_by") + 1)
        rows = rows.join(cuts, "_bucket", "left").withColumn("_bucket", F.col("_bucket") * FAN + F.coalesce(_place(F.col("_cuts"), value), F.lit(0))).drop("_by", "_cuts")
    return rows.drop("_salt")


def _levels(slim: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Cuts of buckets, until none has more than twice BUCKET_ROWS rows: quantiles of the first key that differs in the
    bucket; rows equal in all keys are dealt out by their place. The number of buckets follows from that of the rows."""
    levels: list[DataFrame] = []
    while len(levels) < 6:  # the buckets of six levels fill 60 bits
        now = _dealt(slim, keys, levels)
        differs = F.lit(len(keys))
        for i in reversed(range(len(keys))):
            differs = F.when(F.min(keys[i]) < F.max(keys[i]), i).otherwise(differs)
        big = now.groupBy("_bucket").agg(F.count("*").alias("_n"), differs.alias("_by")).filter(F.col("_n") > 2 * BUCKET_ROWS)
        big = materialize(big.withColumn("_parts", F.least(F.lit(FAN), F.ceil(F.col("_n") / BUCKET_ROWS)).cast("int")).drop("_n"), "buckets")
        if big.isEmpty():
            break
        value = F.element_at(F.array(*keys, "_salt"), F.col("_by") + 1)
        found = now.withColumn("_salt", F.monotonically_increasing_id()).join(big, "_bucket").groupBy("_bucket", "_by", "_parts").agg(F.percentile_approx(value, [i / FAN for i in range(1, FAN)], 10 * FAN).alias("_q"))
        chosen = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.element_at("_q", F.ceil(i * FAN / F.col("_parts")).cast("int")))
        levels.append(materialize(found.select("_bucket", "_by", F.array_distinct(chosen).alias("_cuts")), "cuts"))
    return levels


def _in_order(rows: DataFrame, id_col: str, tie: str) -> DataFrame:
    """``rows`` with ``_bucket`` and ``_place`` in order of id (``_at``), then of a hash of ``tie`` (``_tie``); the row after a bucket's last one
    (the first row of all after the very last) is in the bucket as well, as a ``_guest``. Null is the least id."""
    keys = ["_at", "_tie"]
    rows = rows.withColumns({"_at": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "_tie": F.shiftrightunsigned(F.xxhash64(tie), 1)})
    slim = materialize(rows.select(*keys), "keys")
    levels = _levels(slim, keys)
    least = materialize(_dealt(slim, keys, levels).groupBy("_bucket").agg(F.min(F.struct(*keys)).alias("_least")).select("_bucket", "_least.*"), "heads")
    first = least.groupBy(F.floor(F.col("_bucket") / FAN).alias("_group")).agg(F.max("_bucket").alias("_last"))
    in_group = W.partitionBy("_group").orderBy("_bucket")
    everything = W.orderBy("_group")  # one row for up to FAN buckets of rows
    first = first.select("_group", F.coalesce(F.lag("_last").over(everything), F.max("_last").over(everything.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_before_group"))
    before = least.withColumn("_group", F.floor(F.col("_bucket") / FAN)).withColumn("_before", F.lag("_bucket").over(in_group)).join(first, "_group")
    heads = before.select(F.coalesce("_before", "_before_group").alias("_bucket"), *keys)
    one = W.partitionBy(*keys).orderBy(*keys)
    buckets = least.count()
    wanted = heads.select(*keys).distinct()
    wanted = F.broadcast(wanted) if buckets <= SENT_HEADS else wanted
    texts = rows.join(wanted, keys).withColumn("_one", F.row_number().over(one)).filter("_one = 1").drop("_one")
    guests = texts.join(heads, keys).withColumn("_guest", F.lit(1))
    both = _dealt(rows, keys, levels).withColumn("_guest", F.lit(0)).unionByName(guests).repartition(max(1, buckets // 2), "_bucket")
    return both.withColumn("_place", F.row_number().over(_order()))


def _order():
    return W.partitionBy("_bucket").orderBy("_guest", "_at", "_tie")


def with_next(rows: DataFrame, id_col: str, carried: list[str], tie: str) -> DataFrame:
    """Each row with ``next``: the struct of ``carried`` of the row next in order of id (then of a hash of ``tie``), the first
    row's for the last. Rows are dealt to buckets between their quantiles, as many as the rows ask for."""
    following = F.lead(F.struct(*carried)).over(_order())
    return _in_order(rows, id_col, tie).withColumn("next", following).filter("_guest = 0").select(*rows.columns, "next")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, and that of its edit: its last floor(n/2) code points replaced by the first as
    many (or all) of the next text by id. Null texts are empty; two empty texts are alike (1); an empty and
    another are not (0). Rows of equal id go by a hash of the text, null is the least id, repeated rows have a row each; an
    empty table gives an empty table. Texts move once, to their bucket; all else happens there."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edit = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next", F.lit(1), half))
    placed = _in_order(rows, "doc_id", "text").withColumn("next", F.lead("text").over(_order()))
    placed = placed.withColumn("edited", F.coalesce(edit, F.lit("")))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))
    keys = ["_bucket", "_place", "_guest", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")]
    sided = placed.select(*keys, F.explode(F.when(F.col("_guest") == 0, sides).otherwise(F.slice(sides, 1, 1))).alias("s"))
    made = vectors(sided.select("_bucket", "_place", "_guest", "doc_id", "n_chars", "edited_sha256", "s.side", "s.text"))
    made = made.withColumn("votes", votes(F.col("print")))
    made = made.withColumn("own", F.struct("print", "votes", _dot(F.col("votes"), F.col("votes")).alias("norm")))
    order = W.partitionBy("_bucket").orderBy("_place", "side")
    made = made.withColumns({"other": F.lead("own", 1).over(order), "next": F.lead("own", 2).over(order)}).filter("side = 0 and _guest = 0")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("own.print")).alias("fingerprint"), printed(F.col("other.print")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
