"""Scores of texts by a probabilistic suffix tree: contexts of varying length, kept where they tell the next word.

Words are counted over all training texts, then level by level which word follows a context of one, two, ... words. A context or
a context with its next word takes part if its share of all training tokens is at least ``SHARE``; what follows a frequent string
is found by counting all occurrences, and no string can be more frequent than a part of it, so each level needs only the one before.
A context is kept if its own distribution of the next word tells more than that of the context without its first word: the gain
in log-likelihood over the training texts must pay for its entries. With a context its shorter ones are kept.

A kept context gives its next words what was counted less a discount, and leaves the rest to the shorter context; below all stands
the share of the word itself, with half a count added. The longest kept context that a text's last words end with is its state.

Strings of at least a share S of all tokens number at most 1/S a level, so the tree that is sent to all tasks is bounded (some
40 MB), whatever the corpus. Counts of all other words stay distributed, and meet the texts that hold them in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorloom.llm import text as T
from donorloom.operators.shared import materialize

#: Least share of all tokens of a context, and of a context with its next word; words of a share of WORD_SHARE are sent with their counts.
SHARE, WORD_SHARE = 2**-19, 2**-22
#: Least number of them, for small corpora.
LEAST = 2
DEPTH = 3
DISCOUNT = 0.75
#: Gain in log-likelihood (natural units) that each entry of a kept context must bring on average.
GAIN = 3.0
#: Counts that a task holds before it gives them away.
HELD = 1 << 21

_END = np.uint64(0x5851F42D4C957F2D)
_BITS = 20
_COUNT = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key among sorted keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _tokens(piece: T.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with an end after each text, and where each text begins."""
    found = T.words(piece)
    bounds = found.bounds + np.arange(piece.n + 1)
    out = np.full(bounds[-1], _END)
    inside = np.ones(len(out), dtype=bool)
    inside[bounds[1:] - 1] = False
    out[inside] = found.hashes
    return out, bounds


def _counted(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """Counts of the keys of all texts, added up within the task as far as they fit."""
    held, size = [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)

    for b in batches:
        for piece in T.pieces(b.column(0)):
            held.append(np.unique(keys_of(piece), return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held[:] = [added()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield T.batch(_COUNT, list(held[0]))
                    held, size = [], 0
    if size:
        yield T.batch(_COUNT, list(added()))


def count_words(docs: DataFrame) -> DataFrame:
    """``(key, n)`` of every distinct token of all texts (the end among them)."""
    run = lambda batches: _counted(batches, lambda piece: T.signed(_tokens(piece)[0]))
    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _walk(model: dict, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Place of each token among the words sent, its symbol, and for each level the context before it and the entry of both."""
    word = _find(model["words"], hashes)
    symbol = np.where(word >= 0, model["symbols"][word], -1) if len(model["words"]) else word
    context = np.concatenate([[-1], symbol[:-1]])
    context[bounds[:-1]] = 0  # the beginning of a text
    contexts, entries = [], []
    for level in model["levels"]:
        entry = np.full(len(symbol), -1)
        both = np.flatnonzero((context >= 0) & (symbol >= 0))
        entry[both] = _find(level["keys"], context[both] << _BITS | symbol[both])
        contexts.append(context)
        entries.append(entry)
        context = np.concatenate([[-1], entry[:-1]])
        context[bounds[:-1]] = -1
    contexts.append(context)
    return word, symbol, contexts, entries


def _followers(sent):
    """Counts of what follows the contexts of the next level."""

    def keys_of(piece: T.Piece) -> np.ndarray:
        _, symbol, contexts, _ = _walk(sent.value, *_tokens(piece))
        both = (contexts[-1] >= 0) & (symbol >= 0)
        return contexts[-1][both] << _BITS | symbol[both]

    return lambda batches: _counted(batches, keys_of)


def _level(model: dict, depth: int, keys: np.ndarray, n: np.ndarray) -> dict:
    """A level of the tree from its counts: probabilities of entries, what contexts leave, and which are worth it."""
    context, symbol = keys >> _BITS, keys & ((1 << _BITS) - 1)
    above = model["levels"][-1] if depth > 1 else None
    whole = above["n"] if above else model["symbol_n"]
    shorter = _find(above["keys"], above["shorter"][context] << _BITS | symbol) if above else symbol
    before = above["p"][shorter] if above else model["symbol_p"][symbol]
    size = len(whole)
    entries = np.bincount(context, minlength=size)
    own = (n - DISCOUNT) / whole[context]
    leaves = 1 - np.bincount(context, own, size)
    p = own + leaves[context] * before
    rest = whole - np.bincount(context, n, size)
    gain = np.bincount(context, n * np.log(p / before), size) + rest * np.log(np.where(entries, leaves, 1))
    return {"keys": keys, "n": n, "shorter": shorter, "p": p, "own": own, "leaves": leaves, "kept": (entries > 0) & (gain >= GAIN * entries)}


def fit_suffix_tree(docs: DataFrame, words: DataFrame) -> dict:
    """The tree of the training texts ``docs``, whose tokens ``words`` has counted. One pass over the texts a level."""
    context = docs.sparkSession.sparkContext
    total, distinct = (int(x or 0) for x in words.agg(F.sum("n"), F.count("*")).first())
    least, least_word = (max(LEAST, int(np.ceil(total * s))) for s in (SHARE, WORD_SHARE))
    sent = words.filter(F.col("n") >= least_word).toPandas()  # at most 1 / WORD_SHARE
    hashes, n = T.unsigned(sent["key"].to_numpy(np.int64)), sent["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    frequent = n >= least
    scale = total + 0.5 * (distinct + 1)
    ends = n[_find(hashes, np.array([_END]))[0]] if total else 0  # as many as texts; each begins once
    model = {
        "total": total, "scale": scale, "least_word": least_word, "words": hashes, "counts": n, "symbols": np.where(frequent, np.cumsum(frequent), -1), "levels": [],
        "symbol_n": np.concatenate([[max(ends, 1)], n[frequent]]), "symbol_p": np.concatenate([[1.0], (n[frequent] + 0.5) / scale]),
    }
    for depth in range(1, DEPTH + 1):
        counts = docs.select("text").mapInArrow(_followers(context.broadcast(model)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        found = counts.filter(F.col("n") >= least).toPandas().sort_values("key")  # at most 1 / SHARE
        if found.empty:
            break
        model["levels"].append(_level(model, depth, found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)))
    for low, high in zip(model["levels"][-2::-1], model["levels"][:0:-1], strict=False):
        # contexts of the higher level are entries of the lower; without their first word they are contexts of the lower
        low["kept"][low["shorter"][high["kept"].nonzero()[0]]] = True
    for level in model["levels"]:
        at = level["keys"] >> _BITS
        level["own"] = np.where(level["kept"][at], level["own"], 0.0)
        level["leaves"] = np.where(level["kept"], level["leaves"], 1.0)
    return model


def _scores(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, row = sent.value, TaskContext.get().partitionId() << 33
        for b in batches:
            first = 0
            for piece in T.pieces(b.column(1)):
                hashes, bounds = _tokens(piece)
                word, _, contexts, entries = _walk(model, hashes, bounds)
                known = word >= 0
                p = np.ones(len(hashes))
                p[known] = (model["counts"][word[known]] + 0.5) / model["scale"]
                base = np.add.reduceat(np.log10(p), bounds[:-1])
                for level, context, entry in zip(model["levels"], contexts, entries, strict=False):
                    at = np.flatnonzero(context >= 0)
                    p[at] *= level["leaves"][context[at]]
                    at = np.flatnonzero(entry >= 0)
                    p[at] += level["own"][entry[at]]
                score = np.add.reduceat(np.log10(p), bounds[:-1])
                rare = np.concatenate([[0], np.cumsum(~known)])[bounds].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + piece.n)), b.column(0).slice(first, piece.n), pa.array(np.diff(bounds)), pa.array(np.add.reduceat(known.astype(np.int64), bounds[:-1])), pa.array(base), pa.array(score),
                     pa.ListArray.from_arrays(rare, pa.array(T.signed(hashes[~known])))],
                    ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
                )
                row, first = row + piece.n, first + piece.n

    return run


def score_texts(docs: DataFrame, model: dict, words: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every text: the log10 probabilities of its tokens by their
    counts alone (``base_score``) and by the tree (``score``).

    Null and empty texts have one token, the end. Every row is one text, also where ids are null or repeated. Without training
    texts both scores are 0 for every text; an empty table gives an empty table. ``docs`` has ``doc_id`` and ``text``; other columns
    are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast({**model, "levels": [{c: level[c] for c in ("keys", "own", "leaves")} for level in model["levels"]]})
    rows = docs.select("doc_id", "text").mapInArrow(_scores(sent), "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>")
    rows = materialize(rows, "scored")
    few = words.filter(F.col("n") < model["least_word"])
    met = rows.select("row", F.explode("rare").alias("key")).join(few, "key", "left")
    sums = met.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5) - float(np.log10(model["scale"]))).alias("more"), F.count("n").alias("seen"))
    whole = rows.drop("rare").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(model["total"]).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
