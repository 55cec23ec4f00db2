"""New filings as a stream: raw files are cleaned as they arrive and running totals by recipient and year kept.

Supersession needs all filings of a filer and stays with the batch build; totals here are of matched rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorloom.operators.rollup import matched_rows
from donorloom.sources.filings import RAW_SCHEMA


def raw_stream(spark: SparkSession, path: str) -> DataFrame:
    """Raw filings arriving as Parquet files."""
    return spark.readStream.schema(RAW_SCHEMA).parquet(path)


def running_totals(raw: DataFrame, parents: DataFrame, affiliated: DataFrame) -> DataFrame:
    """Totals by recipient and year over a stream of raw filings (complete or update mode): one small row of state a
    recipient and year. Cents are summed as whole numbers, so the order of arrival does not count."""
    rows = matched_rows(raw, parents, affiliated)
    cents = F.sum(F.round(F.col("amount") * 100).cast("bigint"))
    totals = rows.groupBy("recipient", "recipient_ein", F.year("date").alias("year")).agg(cents.alias("cents"), F.count("*").alias("transactions"))
    return totals.select("recipient", "recipient_ein", "year", (F.col("cents") / 100).alias("total_amount"), "transactions")
