"""Benchmark decontamination by greedy string tiling.

Documents and test items are token sequences (lower-cased letters and digits). Those that share a run of
``seed`` tokens are joined; for each such pair the longest runs that neither side has used yet are found by
running Karp-Rabin and marked, again and again, so a passage whose parts were put in another order is
still covered. An item leaks into a document when its tiles cover ``coverage`` of the item.

Rows and items are told apart by keys that are never null, so both ways of joining give the same rows.
"""

from __future__ import annotations

from collections import defaultdict

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorloom.llm import text as X
from donorloom.llm.rows import row_key, spread_join
from donorloom.operators.shared import materialize

#: The items are sent to every executor only up to so many tokens (8 bytes each, twice); else they are joined.
SENT_TOKENS = 1 << 20
#: Bits of the sieve of item seeds that documents are held against before a join (8 MB), and those one task makes.
SIEVE_BITS, SIEVE_PART = 26, 20
_MOD, _RADIX = (1 << 61) - 1, 1_000_003

_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_tokens", pa.int32()), ("matched", pa.int32()), ("tiles", pa.int32())])
_ITEM_SEEDS = pa.schema([("item", pa.int64()), ("seed", pa.int64()), ("size", pa.int32()), ("places", pa.int32()), ("need", pa.int32())])
_SEEDS = pa.schema([("row", pa.int64()), ("seed", pa.int64())])
_DDL = "doc_id bigint, item_id bigint, item_tokens int, matched int, tiles int"


def token_hashes(texts: pa.Array):
    """(row, token hashes) of each text."""
    for piece in X.pieces(pc.utf8_lower(texts.fill_null(""))):
        found = X.words(piece, X.NOT_ALNUM)
        for i in range(piece.n):
            yield piece.first + i, found.hashes[found.bounds[i] : found.bounds[i + 1]]


def seeds_of(tokens: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the runs of ``seed`` tokens; a shorter sequence is one run of its own."""
    if not len(tokens):
        return tokens
    bounds = np.array([0, len(tokens)])
    return X.grams(X.Words(tokens, bounds, bounds, bounds), min(seed, len(tokens)))[0]


def tile(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping common runs (place in a, place in b, length) of ``least`` tokens or
    more, longest first; equal lengths by place in a, then b. Negative tokens match nothing."""
    used_a, used_b = [x < 0 for x in a], [x < 0 for x in b]
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(a), len(b)) // 2)
    while True:
        found = _longest_runs(a, b, used_a, used_b, size)
        longest = found[0][2] if found else 0
        if longest > 2 * size:
            size = longest
            continue
        for i, j, n in found:
            if any(used_a[i : i + n]) or any(used_b[j : j + n]):
                break  # what is left of it may still be longer than the next
            used_a[i : i + n] = used_b[j : j + n] = [True] * n
            tiles.append((i, j, n))
        if found:
            continue
        if size <= least:
            return tiles
        size = max(least, size // 2)


def _windows(x: list[int], used: list[bool], size: int):
    """Rolling hash of every unmarked window of ``size`` tokens."""
    drop = pow(_RADIX, size - 1, _MOD)
    h, clear = 0, 0
    for i, t in enumerate(x):
        if clear >= size:
            h = (h - (x[i - size] % _MOD) * drop) % _MOD
        if used[i]:
            h = clear = 0
            continue
        h = (h * _RADIX + t % _MOD) % _MOD
        clear += 1
        if clear >= size:
            yield i - size + 1, h


def _longest_runs(a, b, used_a, used_b, size) -> list[tuple[int, int, int]]:
    """Maximal common unmarked runs of ``size`` tokens or more, longest first; of those that go on from one
    another only the first."""
    at: dict[int, list[int]] = defaultdict(list)
    for j, h in _windows(b, used_b, size):
        at[h].append(j)
    runs = []
    for i, h in _windows(a, used_a, size):
        for j in at.get(h, ()):
            if i and j and not used_a[i - 1] and not used_b[j - 1] and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                n += 1
            if n >= size:
                runs.append((i, j, n))
    return sorted(runs, key=lambda r: (-r[2], r[0], r[1]))


def _near(tokens: np.ndarray, hits: np.ndarray, seed: int) -> list[int]:
    """Tokens of a document that seeds at ``hits`` cover; a mark (-1) stands for each gap."""
    covered = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(covered, hits, 1)
    np.add.at(covered, np.minimum(hits + seed, len(tokens)), -1)
    inside = np.cumsum(covered[:-1]) > 0
    at = np.flatnonzero(inside)
    gaps = np.flatnonzero(np.diff(at) > 1)
    return np.insert((tokens[at] >> np.uint64(1)).astype(np.int64), gaps + 1, -1).tolist()


def _matched(tokens: np.ndarray, hits: np.ndarray, item: np.ndarray, seed: int) -> tuple[int, int]:
    seed = min(seed, len(item))
    tiles = tile((item >> np.uint64(1)).astype(np.int64).tolist(), _near(tokens, hits, seed), seed)
    return sum(n for _, _, n in tiles), len(tiles)


class _Items:
    """Items by seed, for look-up in whole batches of seeds."""

    def __init__(self, items: list[tuple[int, np.ndarray]], seed: int):
        self.items, self.seed = items, seed
        self.by_length: list[tuple[int, np.ndarray, np.ndarray]] = []
        for k in sorted({min(seed, len(t)) for _, t in items if len(t)}):
            pairs = [(seeds_of(t, seed), i) for i, (_, t) in enumerate(items) if len(t) and min(seed, len(t)) == k]
            hashes = np.concatenate([p[0] for p in pairs])
            owner = np.repeat([p[1] for p in pairs], [len(p[0]) for p in pairs])
            order = np.argsort(hashes, kind="stable")
            self.by_length.append((k, hashes[order], owner[order]))

    def hits(self, piece_words: X.Words):
        """{(text, item): places of shared seeds} of a piece."""
        out: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for k, hashes, owner in self.by_length:
            found, bounds = X.grams(piece_words, k)
            lo = np.searchsorted(hashes, found)
            for g in np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == found):
                i = int(np.searchsorted(bounds, g, side="right")) - 1
                if piece_words.bounds[i + 1] - piece_words.bounds[i] < k:
                    continue
                hi = np.searchsorted(hashes, found[g], side="right")
                for o in set(owner[lo[g] : hi].tolist()):
                    out[i, o].append(g - bounds[i])
        return out


def _tiled(sent, least_coverage: float):
    def run(batches):
        items: _Items = _Items(*sent.value)
        for b in batches:
            ids = b.column(0)
            out = []
            for piece in X.pieces(pc.utf8_lower(b.column(1).fill_null(""))):
                found = X.words(piece, X.NOT_ALNUM)
                for (i, o), hits in items.hits(found).items():
                    item_id, item = items.items[o]
                    tokens = found.hashes[found.bounds[i] : found.bounds[i + 1]]
                    matched, tiles = _matched(tokens, np.array(hits), item, items.seed)
                    if matched >= least_coverage * len(item):
                        out.append((ids[piece.first + i].as_py(), item_id, len(item), matched, tiles))
            if out:
                yield X.batch(_FOUND, list(zip(*out, strict=True)))

    return run


def _sent_items(benchmark: DataFrame, seed: int) -> list[tuple[int, np.ndarray]]:
    table = benchmark.toArrow()
    ids = table.column(0).to_pylist()
    return [(ids[i], tokens.copy()) for i, tokens in token_hashes(table.column(1).combine_chunks())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, seed: int = 5, sent_tokens: int = SENT_TOKENS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, item_tokens, matched, tiles, coverage)`` for each document and test item whose tiles of
    ``seed`` tokens or more cover at least ``coverage`` of the item's tokens.

    Items of fewer tokens than ``seed`` must appear whole. Null and empty texts and items match nothing. Rows of
    equal or null id are documents of their own, and items likewise: each pair of rows has its row. The items go to all
    executors while they have at most ``sent_tokens`` tokens; above that, documents and items are joined on their seeds.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= 2 * sent_tokens:  # a token and what parts it take two bytes at least
        sent = docs.sparkSession.sparkContext.broadcast((_sent_items(items, seed), seed))
        found = texts.mapInArrow(_tiled(sent, coverage), _DDL)
    else:
        found = _joined(texts, items, seed, coverage)
    return found.withColumn("coverage", F.col("matched") / F.col("item_tokens"))


def _sieve(seeds: DataFrame) -> np.ndarray:
    """A bit for the first SIEVE_BITS bits of each seed: a fixed 8 MB, whatever the items."""
    slot = F.shiftrightunsigned("seed", 64 - SIEVE_BITS)

    def part(pdf):
        bits = np.zeros(1 << SIEVE_PART, bool)
        bits[pdf["slot"].to_numpy() & ((1 << SIEVE_PART) - 1)] = True
        return pdf.head(1).assign(bits=[np.packbits(bits, bitorder="little").tobytes()])[["part", "bits"]]

    parts = seeds.select(slot.alias("slot")).distinct().withColumn("part", F.shiftright("slot", SIEVE_PART))
    whole = np.zeros((1 << (SIEVE_BITS - SIEVE_PART), 1 << (SIEVE_PART - 3)), np.uint8)
    for r in parts.groupBy("part").applyInPandas(part, "part long, bits binary").toLocalIterator():
        whole[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return whole.ravel()


def _joined(texts: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame:
    """The same when the items are too many to send: seeds are joined, then each document meets its items. Documents give
    out only seeds of the lengths that items have, and only those that the sieve lets through; a document and an item are compared
    if they share as many seeds as the coverage asks for; hot seeds, items and rows are dealt out."""
    texts = texts.withColumn("row", row_key("doc_id", "text"))
    items = items.withColumn("item", row_key("item_id", "text"))

    def item_seeds(batches):
        for b in batches:
            out = [
                (b.column(0)[i].as_py(), s, k, n, max(1, math.ceil(coverage * len(t) / k - 1e-9)))
                for i, t in token_hashes(b.column(1)) if (k := min(seed, len(t))) for s, n in Counter(X.signed(seeds_of(t, seed)).tolist()).items()
            ]
            if out:
                yield X.batch(_ITEM_SEEDS, list(zip(*out, strict=True)))

    keyed = materialize(items.select("item", "text").mapInArrow(item_seeds, "item bigint, seed bigint, size int, places int, need int").distinct(), "item-seeds")
    sizes = sorted(r["size"] for r in keyed.select("size").distinct().collect())  # at most ``seed`` numbers
    sieve = texts.sparkSession.sparkContext.broadcast(_sieve(keyed))

    def doc_seeds(batches):
        for b in batches:
            for i, t in token_hashes(b.column(1)):
                own = [seeds_of(t, k) for k in sizes if len(t) >= k]
                own = np.unique(np.concatenate(own)) if own else t[:0]
                slot = (own >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
                own = own[(sieve.value[slot >> 3] >> (slot & 7)) & 1 == 1]
                if len(own):
                    yield X.batch(_SEEDS, [np.full(len(own), b.column(0)[i].as_py()), X.signed(own)])

    mine = materialize(texts.select("row", "text").mapInArrow(doc_seeds, "row bigint, seed bigint"), "doc-seeds")
    # tiles of at least ``seed`` tokens that cover c of them hold c / seed of the item's seeds or more
    shared = spread_join(mine, keyed.select("item", "seed", "places", "need"), ["seed"]).groupBy("row", "item").agg(F.sum("places").alias("places"), F.max("need").alias("need"))
    pairs = materialize(shared.filter("places >= need").select("row", "item"), "pairs")
    met = materialize(spread_join(pairs, items.withColumnRenamed("text", "item_text"), ["item"]), "met")
    met = spread_join(texts, met, ["row"])

    def tiled(batches):
        for b in batches:
            mine, theirs = (dict(token_hashes(b.column(c))) for c in (2, 3))
            out = []
            for i in range(b.num_rows):
                item, tokens = mine[i], theirs[i]
                k = min(seed, len(item))
                hits = np.flatnonzero(np.isin(seeds_of(tokens, k), seeds_of(item, k))) if len(tokens) >= k else []
                if len(hits):
                    matched, tiles = _matched(tokens, hits, item, seed)
                    if matched >= coverage * len(item):
                        out.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), len(item), matched, tiles))
            if out:
                yield X.batch(_FOUND, list(zip(*out, strict=True)))

    return met.select("doc_id", "item_id", "item_text", "text").mapInArrow(tiled, _DDL)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that an item leaks into. A row goes by its own text: others of its id, or of null id, stay.
    The keys of those that go are written first, so texts move only where the keys are too many to be sent."""
    keyed = docs.withColumn("_row", row_key(F.col(id_col).cast("long"), F.col(text_col)))
    leaks = find_leaks(keyed, benchmark, coverage, seed, id_col="_row", text_col=text_col)
    return keyed.join(materialize(leaks.select(F.col("doc_id").alias("_row")).distinct(), "leaks"), "_row", "left_anti").drop("_row")
