"""Shards of nearly equal bytes for groups that must stay together, by Karmarkar-Karp differencing.

Groups are summed before anything else, dealt to buckets by hash, and differenced bucket by bucket; what a bucket
leaves is a partial partition, one sum a shard. Partial partitions are differenced again, some hundred at a
time, level by level, until one is left. No task sees more than one bucket or one level's handful.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from donorloom.llm.rows import spread_join
from donorloom.operators.shared import materialize

#: Groups in a bucket, partial partitions differenced together, and rows numbered together.
BUCKET_GROUPS, FAN_IN, SLOT_ROWS = 4096, 512, 20_000


def difference(parts: list[list[int]], shards: int) -> list[list[int]]:
    """For each partial partition (a sum a slot), the shard that each of its slots goes to.

    The two partitions of largest spread are combined, the largest of one with the smallest of the other, until
    one is left. Ties go by place in the list.
    """
    orders = [sorted(range(len(p)), key=lambda i, p=p: (p[i], i)) for p in parts]
    sums = [[p[i] for i in o] for p, o in zip(parts, orders, strict=True)]
    heap = [(s[0] - s[-1], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = [x + y for x, y in zip(sums[a], reversed(sums[b]), strict=True)]
        order = sorted(range(shards), key=both.__getitem__)
        made.append((a, b, order))
        sums[a] = sums[b] = []
        sums.append([both[i] for i in order])
        heapq.heappush(heap, (sums[-1][0] - sums[-1][-1], len(sums) - 1))
    place: dict[int, list[int]] = {len(sums) - 1: list(range(shards))}
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        mine = place.pop(len(parts) + k)
        to_a, to_b = [0] * shards, [0] * shards
        for rank, i in enumerate(order):
            to_a[i] = to_b[shards - 1 - i] = mine[rank]
        place[a], place[b] = to_a, to_b
    out = []
    for i, o in enumerate(orders):
        to = [0] * shards
        for rank, slot in enumerate(o):
            to[slot] = place[i][rank]
        out.append(to)
    return out


def _bucket_slots(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        to = difference([[0] * (shards - 1) + [int(b)] for b in pdf["bytes"]], shards)
        return pd.DataFrame({"node": pdf["node"], "key": pdf["key"], "bytes": pdf["bytes"], "slot": [t[-1] for t in to]})

    return run


def _level_slots(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="node", columns="slot", values="bytes").reindex(columns=range(shards)).fillna(0).sort_index()
        to = difference([[int(x) for x in row] for row in wide.to_numpy(dtype="int64")], shards)
        return pd.DataFrame([(n, s, t[s]) for n, t in zip(wide.index, to, strict=True) for s in range(shards)], columns=["node", "slot", "to"])

    return run


def shard_groups(groups: DataFrame, shards: int, bucket_groups: int = BUCKET_GROUPS, fan_in: int = FAN_IN) -> DataFrame:
    """``(key, shard)`` for groups ``(key, bytes)``, one row a key: each whole group in one shard, bytes near equal."""
    total = groups.count()
    nodes = max(1, -(-total // bucket_groups))
    dealt = groups.select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(nodes)).alias("node"))
    slots = materialize(dealt.groupBy("node").applyInPandas(_bucket_slots(shards), "node long, key string, bytes long, slot int"), "slots")
    level = slots.groupBy("node", "slot").agg(F.sum("bytes").alias("bytes"))
    to = slots.select("key", "node", "slot")
    while nodes > 1:
        level = level.withColumn("parent", F.floor(F.col("node") / fan_in))
        moved = materialize(
            level.groupBy("parent").applyInPandas(_level_slots(shards), "node long, slot int, to int"), "level"
        )
        to = to.join(moved, ["node", "slot"]).select("key", F.floor(F.col("node") / fan_in).alias("node"), F.col("to").alias("slot"))
        level = (
            level.join(moved, ["node", "slot"]).groupBy(F.col("parent").alias("node"), F.col("to").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        )
        nodes = -(-nodes // fan_in)
    return to.select("key", F.col("slot").alias("shard"))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """All columns of ``docs`` but the text's use, as ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1), ``text_crc32`` unsigned (null: 0). Rows of equal text,
    and rows of null text, go to one shard whole; sums of ``size`` are near equal. ``slot`` counts from 0 within a
    shard without gaps, by a hash of the id. An empty table gives an empty table. ``grown_shard`` is null.
    """
    text = F.col(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("key"),
        ), "sizes",
    )
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    dealt = spread_join(rows, shard_groups(groups.select("key", "bytes"), shards), ["key"]).drop("key")
    cells = max(1, -(-total // (shards * slot_rows)))
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(cells)))
    cell = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(cell), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")
    return (
        dealt.withColumn("place", F.row_number().over(within) - 1).join(starts, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
