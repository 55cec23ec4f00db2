"""Language of a text by Bayesian evidence fusion.

Likelihoods of the text under each language (hashed byte trigrams, counted over all labelled rows) are combined with
the language that the markup declares, the suffix of the address, and a prior of the host, smoothed towards the prior of
its parent domain, its suffix and the whole corpus in turn. All counts are grouped aggregations over the whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorloom.llm import text as X
from donorloom.operators.shared import materialize

BINS = 1 << 14
#: Languages that a model may hold (their tables are sent to each executor: BINS * 4 bytes each).
LANGUAGES = 256
#: Rows that a level of the host hierarchy counts as, evidence of a declaration that is right, and
#: the most that a text counts as (trigrams), so that other evidence is heard.
PRIOR_ROWS, DECLARED, TEXT_WEIGHT = 10.0, 0.9, 50.0
REJECT = "und"

_GRAM = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _bins(piece: X.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each byte trigram with a letter in its middle, and the text that it is of."""
    d = piece.data
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = X._LOWER[d].astype(np.uint64)
    h = low[:-2] * _GRAM[0] + low[1:-1] * _GRAM[1] + low[2:] * _GRAM[2]
    owner = np.repeat(np.arange(piece.n), np.diff(piece.offsets))
    letter = (d[1:-1] >= 128) | ((low[1:-1] >= 97) & (low[1:-1] <= 122))
    keep = letter & (owner[2:] == owner[:-2])
    return (h[keep] >> np.uint64(50)).astype(np.int64), owner[:-2][keep]


def count_grams(docs: DataFrame) -> DataFrame:
    """``(lang, bin, n)`` over all rows ``(text, lang)``; each task adds up its own rows first."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for piece in X.pieces(b.column(0)):
                bins, owner = _bins(piece)
                own = langs[piece.first : piece.first + piece.n]
                names = sorted({x for x in own if x is not None})
                code = np.array([names.index(x) if x is not None else -1 for x in own], np.int64)[owner]
                for i, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + np.bincount(bins[code == i], minlength=BINS)
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], ["lang", "bin", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def fit_text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities (bins x languages) with one count added to each bin. Rows without a language
    teach nothing. Raises beyond LANGUAGES languages, before anything is collected, as the model is sent to every executor."""
    labelled = docs.filter(F.col("lang").isNotNull())
    names = sorted(r["lang"] for r in labelled.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = count_grams(labelled).toPandas()
    table = np.ones((BINS, max(len(names), 1)))
    for i, name in enumerate(names):
        own = counts[counts["lang"] == name]
        table[own["bin"].to_numpy(int), i] += own["n"].to_numpy(float)
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def text_scores(rows: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """``rows`` (doc_id, text, others) without the text, with ``grams`` and ``loglik`` (mean of a trigram, by language)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c != "text"]

    def run(batches):
        table = sent.value
        for b in batches:
            at = b.schema.get_field_index("text")
            mean, total = np.zeros((b.num_rows, table.shape[1])), np.zeros(b.num_rows, np.int64)
            for piece in X.pieces(b.column(at)):
                bins, owner = _bins(piece)
                n = np.bincount(owner, minlength=piece.n)
                rows_ = slice(piece.first, piece.first + piece.n)
                total[rows_] = n
                for i in range(table.shape[1]):
                    mean[rows_, i] = np.bincount(owner, table[bins, i], minlength=piece.n) / np.maximum(n, 1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * table.shape[1], pa.int32()), pa.array(mean.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(total), flat], [*keep, "grams", "loglik"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{schema}, grams bigint, loglik array<double>")


def host_levels(host: Column) -> dict[str, Column]:
    """Host, its domain (last two labels) and its suffix (last label), each '' where there is none."""
    h = F.coalesce(F.lower(host), F.lit(""))
    return {"host": h, "domain": F.substring_index(h, ".", -2), "suffix": F.when(h.contains("."), F.substring_index(h, ".", -1)).otherwise(F.lit(""))}


def host_priors(rows: DataFrame, names: list[str]) -> DataFrame:
    """``(host, log_prior)``, by language: counts of a host, smoothed by its domain's, those by its suffix's, those by the
    corpus's, each level counting as PRIOR_ROWS rows. ``rows`` has (host, domain, suffix, lang)."""

    def counted(level: list[str]) -> DataFrame:
        return rows.groupBy(*level).agg(*(F.count_if(F.col("lang") == n).alias(f"n{i}") for i, n in enumerate(names)))

    total = counted([]).first()
    share = [(total[i] + 1) / (sum(total) + len(names)) for i in range(len(names))]
    counts = materialize(counted(["suffix", "domain", "host"]), "hosts")
    level = counts.groupBy("suffix").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))))
    above = F.array(*map(F.lit, share))

    def smooth(df: DataFrame, over: Column) -> DataFrame:
        n = F.array(*(F.col(f"n{i}").cast("double") for i in range(len(names))))
        whole = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0.0)) + PRIOR_ROWS
        return df.withColumn("prior", F.zip_with(n, over, lambda x, p: (x + PRIOR_ROWS * p) / whole))

    suffixes = smooth(level, above).select("suffix", "prior")
    domains = counts.groupBy("suffix", "domain").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))))
    domains = smooth(domains.join(suffixes.withColumnRenamed("prior", "up"), "suffix"), F.col("up")).select("suffix", "domain", "prior")
    hosts = smooth(counts.join(domains.withColumnRenamed("prior", "up"), ["suffix", "domain"]), F.col("up"))
    return hosts.select("host", F.transform("prior", lambda p: F.log(p)).alias("log_prior"))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, text: str = "text", lang: str = "lang", declared: str | None = "lang", host: str | None = "source", accept: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, language, confidence, grams, kept)`` for every row of ``docs``.

    ``declared`` is the language that the markup or the record declares (null or unknown: no evidence), ``host`` the
    address or source (null: one host of its own); the text model learns from ``lang``. ``kept`` tells whether the
    text has a letter and the best language's posterior reaches ``accept``; ``language`` is REJECT for texts without a
    letter (null and empty ones too). Texts too short for a trigram go by the other evidence. Ties go to the first language by name. A table without
    labelled rows has every row rejected; an empty table gives an empty table. Repeated rows, and those of null or equal ids, are judged each.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"),
        (F.col(declared) if declared else F.lit(None).cast("string")).alias("declared"),
        (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"), *(c.alias(n) for n, c in host_levels(F.col(host) if host else F.lit(None)).items()),
    )
    names, table = model or fit_text_model(rows)
    if not names:
        return rows.select("doc_id", F.lit(REJECT).alias("language"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("grams"), F.lit(False).alias("kept"))
    priors = host_priors(rows.drop("text"), names)
    scored = text_scores(rows.drop("lang", "domain", "suffix"), names, table).join(priors, "host", "left")
    known = F.lit(names)
    other = (1 - DECLARED) / max(len(names) - 1, 1)
    declares = F.transform(known, lambda n: F.when(F.col("declared").isNull() | ~F.array_contains(known, F.col("declared")), F.lit(0.0)).otherwise(F.when(n == F.col("declared"), F.lit(float(np.log(DECLARED)))).otherwise(F.lit(float(np.log(max(other, 1e-9)))))))
    weight = F.least(F.col("grams").cast("double"), F.lit(TEXT_WEIGHT))
    fused = F.zip_with(F.zip_with(F.transform("loglik", lambda x: x * weight), "log_prior", lambda a, b: a + b), declares, lambda a, b: a + b)
    best = scored.withColumn("fused", fused).withColumn("top", F.array_max("fused"))
    total = F.aggregate("fused", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    confidence = F.when(F.col("letters"), 1 / total).otherwise(0.0)
    name = F.when(F.col("letters"), F.element_at(known, F.array_position("fused", F.col("top")).cast("int"))).otherwise(F.lit(REJECT))
    return best.select("doc_id", name.alias("language"), confidence.alias("confidence"), "grams", (F.col("letters") & (confidence >= accept)).alias("kept"))
