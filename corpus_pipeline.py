"""The stages of a corpus build: each works on all that the one before it kept, and its decisions take effect.

1. language: documents whose language cannot be told go;
2. near duplicates: of each group of linked documents (5-word shingles, similarity of 0.8 or more) the one of least id stays;
3. decontamination: documents that a test item leaks into go;
4. mixing: each document stays as often as the mix takes it, documents that it does not take go;
5. sharding: every row gets its shard and its place in it.

Every stage gives back the columns of documents, the last one adds ``shard``, ``slot`` and ``size``. Texts are whole; null
texts have no language and go with the first stage. Decisions are on rows, told apart by a 64-bit hash of id and text: null ids
and ids of several texts are documents each. From stage 2 on, rows equal in id and text are one. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorloom.llm.decontaminate import drop_leaks
from donorloom.llm.language_id import identify
from donorloom.llm.mixing import mix
from donorloom.llm.ngram_join import linked_rows
from donorloom.llm.rows import row_key
from donorloom.llm.sharding import shard_by_bytes
from donorloom.operators.shared import materialize, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    return _rows(docs).withColumn("row", row_key("doc_id", "text"))


def _once(docs: DataFrame) -> DataFrame:
    """One row of those equal in id and text, where a table repeats any: the least of their other columns, so that reruns agree."""
    if _keyed(docs).groupBy("row").count().filter("count > 1").isEmpty():
        return _rows(docs)
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    return _rows(docs).groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("least")).select("doc_id", "text", "least.*").select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows of some keys ``row``. The keys are written first, so their size is known when the join is
    planned: texts move only where the keys are too many to be sent."""
    return _keyed(docs).join(materialize(gone.select("row").distinct(), "gone"), "row", "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = identify(_keyed(docs), id_col="row")
    return _without(docs, judged.filter(~F.col("kept")).select(F.col("doc_id").alias("row")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined = linked_rows(_rows(docs), k=5, percent=80)
    return _without(_once(docs), joined.filter(F.col("row") != F.col("stays")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), coverage=0.5, seed=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _keyed(_once(docs))
    copies = mix(docs, weights=(5, 2, 1), percent=150, repeats=2, id_col="row").filter("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    return docs.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(_rows(docs), shards=16)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: Several stages have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
