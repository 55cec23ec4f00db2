"""Quality scores: histogram gradient-boosted trees over statistics of a text, walked as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorloom.llm import text as X

#: Labelled rows that the trees are fitted on, at most: those of least hash.
FIT_ROWS = 20_000
FEATURES = (
    "log_words", "mean_word", "distinct_words", "top_word", "top_run", "upper", "digits", "letters", "wide", "symbols", "stops",
    "pipes", "exclaims", "percents", "stars", "ands", "hashes", "dollars", "braces", "at_signs", "lines", "distinct_lines", "longest_word",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_ALNUM = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_CLASSES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _class("0123456789"), "letters": _class("abcdefghijklmnopqrstuvwxyz"),
    "wide": np.arange(256) >= 128, "symbols": ~_ALNUM & ~X.SPACE & (np.arange(256) < 128), "stops": _class(".,;:?"), "pipes": _class("|"),
    "exclaims": _class("!"), "percents": _class("%"), "stars": _class("*"), "ands": _class("&"), "hashes": _class("#"), "dollars": _class("$"),
    "braces": _class("{}[]<>()"), "at_signs": _class("@"),
}
_LINE = np.zeros(256, bool)
_LINE[10] = True


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; an empty or null text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    column = {name: i for i, name in enumerate(FEATURES)}
    for piece in X.pieces(texts):
        rows = slice(piece.first, piece.first + piece.n)
        size = np.maximum(np.diff(piece.offsets), 1)
        for name, members in _CLASSES.items():
            run = np.concatenate([[0], np.cumsum(members[piece.data])])
            out[rows, column[name]] = (run[piece.offsets[1:]] - run[piece.offsets[:-1]]) / size
        found, lines = X.words(piece), X.words(piece, _LINE)
        length = found.ends - found.starts + 1
        for i in range(piece.n):
            a, b = found.bounds[i], found.bounds[i + 1]
            if a == b:
                continue
            own, n, r = found.hashes[a:b], b - a, piece.first + i
            _, times = np.unique(own, return_counts=True)
            out[r, column["log_words"]] = np.log1p(n)
            out[r, column["mean_word"]] = length[a:b].mean()
            out[r, column["longest_word"]] = min(length[a:b].max(), 200)
            out[r, column["distinct_words"]] = len(times) / n
            out[r, column["top_word"]] = times.max() / n
            out[r, column["top_run"]] = (own[1:] == own[:-1]).mean() if n > 1 else 0
            own = lines.hashes[lines.bounds[i] : lines.bounds[i + 1]]
            out[r, column["lines"]] = np.log1p(len(own))
            out[r, column["distinct_lines"]] = len(np.unique(own)) / max(len(own), 1)
    return out


@dataclass
class Trees:
    """Trees of one shape, side by side: node i has the children 2i+1 and 2i+2; the last level holds the leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: int = 8) -> Trees:
    """Boosted trees for the log-odds of ``y``, split on histograms of gradients in ``bins`` bins a feature.

    With no rows, or one class alone, every score is that class's smoothed share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes, leaves = (1 << depth) - 1, 1 << depth
    feature, cut, leaf = [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            own_f, own_c = np.zeros(nodes, np.int64), np.full(nodes, np.inf, np.float32)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                local = node - first
                best = np.zeros(width)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    key = local * bins + binned[f]
                    gs, hs, ns = (np.bincount(key, weights=w, minlength=width * bins).reshape(width, bins).cumsum(axis=1) for w in (g, h, None))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                    gain[(ns < least) | (nt - ns < least)] = 0
                    gain = gain[:, : len(c)]
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    own_f[first : first + width][better] = f
                    own_c[first : first + width][better] = c[at[better]]
                node = 2 * node + 1 + (x[np.arange(len(y)), own_f[node]] > own_c[node])
            local = node - nodes
            value = -rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + l2)
            raw += value[local]
            feature.append(own_f)
            cut.append(own_c)
            leaf.append(value)
    shape = (len(feature), nodes)
    return Trees(base, np.array(feature, np.int64).reshape(shape), np.array(cut, np.float32).reshape(shape), np.array(leaf, float).reshape(len(leaf), leaves))


def _stats_udf():
    @F.pandas_udf("array<float>")
    def stats(text: pd.Series) -> pd.Series:
        return pd.Series(list(statistics(pa.Array.from_pandas(text, type=pa.string()))))

    return stats


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Trees:
    """Trees fitted on the labelled documents, ``fit_rows`` at most (of least id hash). Null labels and labels
    without a document are left out; an id labelled twice counts once, its greatest label."""
    wanted = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # at most fit_rows ids
    rows = rows.select("doc_id", "y", _stats_udf()("text").alias("x")).orderBy("doc_id").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    return fit(np.stack(rows["x"].to_numpy()).astype(np.float32), rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs``, by its whole text; empty and null texts are scored
    from zeros. Repeated rows, and those of null or equal ids, are scored each; an empty table gives an empty table."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.probability(statistics(b.column(1))), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
