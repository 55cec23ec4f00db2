"""The test tables seen as filings: a line item is a contribution, a supplier's nation its recipient."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorloom.operators.rollup import CONTRIBUTION_COLUMNS, donor_dictionary, matched_rows
from donorloom.operators.shared import ship_package
from donorloom.operators.supersession import calendar, drop_superseded
from donorloom.sources.filings import registry

TARGETS, AFFILIATES = range(12), range(12, 22)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contributions_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = (
        _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    b = joined.withColumns({
        "nk": F.col("s_nationkey"), "y": F.year("l_shipdate"), "q": F.quarter("l_shipdate"), "h": F.when(F.quarter("l_shipdate") <= 2, 1).otherwise(2),
        "amended": (F.col("l_linenumber") % 3 == 2) & (F.col("s_nationkey") % 2 == 0), "person": F.col("l_orderkey") % 4 == 0,
    })
    first = F.when(F.col("c_custkey") % 3 == 0, ", Ann").when(F.col("c_custkey") % 3 == 1, ", Bob J.").otherwise(", Cy Jr")
    p, n = F.col("p_name"), F.col("l_linenumber")
    firm = (
        F.when(n == 1, F.concat(p, F.lit(" Inc."))).when(n == 2, F.concat(p, F.lit(", LLC"))).when(n == 3, F.concat(F.lit("The "), p, F.lit(" Corp")))
        .when(n == 4, F.concat(p, F.lit(" (In-Kind)"))).when(n == 5, F.concat(p, F.lit(" & Co"))).when(n == 6, F.concat(p, F.lit(" Assoc"))).otherwise(F.concat(p, F.lit(" PAC")))
    )
    qty = F.col("l_quantity")
    day = F.date_format("l_shipdate", "yyyyMMdd")
    begin_month = F.when(F.col("amended"), F.col("h") * 6 - 5).otherwise(F.col("q") * 3 - 2)
    end_month = F.when(F.col("amended"), F.col("h") * 6).otherwise(F.col("q") * 3)
    return b.select(
        F.when(F.col("person"), F.concat("c_mktsegment", first)).otherwise(firm).alias("contributor_name"),
        F.when(F.col("person") & (qty > 10), "Acme").otherwise("N/A").alias("employer"), F.when(F.col("person") & (qty > 25), "Retired").otherwise("NA").alias("occupation"),
        F.concat((F.col("c_custkey") % 40).cast("string"), F.lit(" Main St Suite "), (F.col("c_custkey") % 3).cast("string")).alias("address"),
        F.concat(F.lit("City "), F.col("c_nationkey").cast("string")).alias("city"), F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("state"),
        F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0").alias("zipcode"), F.col("l_extendedprice").cast("string").alias("amount"),
        F.when(qty == 1, "").when(qty == 2, F.date_format(F.date_add("l_shipdate", 200), "yyyyMMdd")).otherwise(day).alias("date"),
        F.date_format(F.make_date("y", begin_month, F.lit(1)), "yyyyMMdd").alias("period_begin"), F.date_format(F.last_day(F.make_date("y", end_month, F.lit(1))), "yyyyMMdd").alias("period_end"),
        F.lpad((100000000 + F.col("nk")).cast("string"), 9, "0").alias("recipient_ein"), F.concat(F.lit("Org "), F.col("nk").cast("string")).alias("recipient_name"),
        (F.col("nk") * 1000000 + F.col("y") * 10 + F.when(F.col("amended"), 4 + F.col("h")).otherwise(F.col("q"))).cast("string").alias("form_id"),
    )


def registry_src(src: DataFrame) -> DataFrame:
    last = F.max("period_end")
    return src.groupBy("form_id").agg(F.when(F.col("form_id").cast("bigint") % 10 > 4, F.concat(last, F.lit("235959"))).otherwise(F.concat(last, F.lit("000000"))).alias("insert_dt"))


def parents(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{100000000 + k}', 'Org {k}', '{'Democrats' if k % 2 == 0 else 'Republicans'}')" for k in TARGETS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ein, recipient, party)")


def affiliated(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{100000000 + k}', '{100000000 + k - 12}')" for k in AFFILIATES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ein, parent_ein)")


def matched(spark: SparkSession, sf_dir: str, dictionary: bool = False) -> DataFrame:
    """Matched rows; with ``dictionary`` distinct donors are classified first, for queries that read all rows' classes."""
    src, lookups = contributions_src(spark, sf_dir), (parents(spark), affiliated(spark))
    return matched_rows(src, *lookups, donor_dictionary(src, *lookups) if dictionary else None)


def kept(spark: SparkSession, sf_dir: str, dictionary: bool = False) -> DataFrame:
    return kept_of(matched(spark, sf_dir, dictionary))


def kept_of(rows: DataFrame) -> DataFrame:
    """Matched rows less the superseded ones. A form is one recipient's, so its rows are all matched or none is, and the
    registry can be made of the matched rows. Rows stay lazy: what a query does not read is never made."""
    days = calendar(rows, "own_ein")
    return drop_superseded(rows, registry(registry_src(days)), ein="own_ein", days=days)


def contributions(spark: SparkSession, sf_dir: str, dictionary: bool = False) -> DataFrame:
    """The clean table that the reference publishes."""
    return kept(spark, sf_dir, dictionary).select(*CONTRIBUTION_COLUMNS)
