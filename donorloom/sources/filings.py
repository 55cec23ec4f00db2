"""Readers of filings, registries, lookups and answer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from donorloom.functions.cleaning import insert_key, parse_dollar, strip
from donorloom.sources.gzip_csv import RANGE_BYTES, read_gzip_csv
from donorloom.sources.sinks import YEAR

RAW_COLUMNS = (
    "recipient_ein", "recipient_name", "contributor_name", "employer", "occupation", "amount", "date", "period_begin",
    "period_end", "address", "city", "state", "zipcode", "form_id",
)
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
REGISTRY_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("form_id", "insert_dt")])


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def read_raw_contributions(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Raw filings from gzip CSV, columns by name, all as text; missing ones null. A gzip file is one task, so the
    rows are dealt out again before any work is done on them."""
    rows = _csv(spark, path)
    known = set(rows.columns)
    rows = rows.select(*((F.col(c) if c in known else F.lit(None).cast("string")).alias(c) for c in RAW_COLUMNS))
    return rows.repartition(partitions or spark.sparkContext.defaultParallelism * 4)


def read_appended_contributions(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same from gzip files of several members, such as extracts appended to each other: a task for each range of bytes, in
    a file system that Arrow can open. Members that end within a record raise."""
    return read_gzip_csv(spark, path, RAW_COLUMNS, range_bytes)


def registry(rows: DataFrame) -> DataFrame:
    """``(form_id, insert_key)``, one row a form: the greatest key of a form that is listed twice."""
    return rows.filter("form_id is not null").groupBy("form_id").agg(F.max(insert_key(F.col("insert_dt"))).alias("insert_key"))


def read_form_registry(spark: SparkSession, path: str) -> DataFrame:
    return registry(_csv(spark, path).select("form_id", "insert_dt"))


def read_contributions(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Clean contributions; dates that are none become null, amounts that are none 0. With a first or last day only the
    folders of those years are read (of a table with that layout); rows of the years' other days are among them."""
    rows = spark.read.parquet(path)
    if YEAR in rows.columns:
        years = F.col(YEAR)
        rows = rows.filter(years >= F.year(F.lit(start).cast("date"))) if start else rows
        rows = rows.filter(years <= F.year(F.lit(end).cast("date"))) if end else rows
        rows = rows.drop(YEAR)
    date = F.col("date") if dict(rows.dtypes)["date"].startswith("timestamp") else F.try_to_timestamp(F.col("date").cast("string"))
    amount = F.coalesce(F.col("amount").try_cast("double"), F.lit(0.0))
    return rows.withColumns({"date": date, "amount": F.when(F.isnan(amount), 0.0).otherwise(amount)})


def read_donor_groups(spark: SparkSession, path: str) -> DataFrame:
    """``(donor_upper, donor_group)`` from JSON, one object of names or a list of ``{donor, donor_group}``; of a name that a
    list has twice the last group by name stays. A lookup of one JSON value is read whole by one task."""
    text = spark.read.text(path, wholetext=True)
    is_list = F.regexp_extract("value", r"^\s*(.)", 1) == "["
    flat = text.filter(~is_list).select(F.explode(F.from_json("value", "map<string,string>")).alias("donor_upper", "donor_group"))
    rows = text.filter(is_list).select(F.explode(F.from_json("value", "array<struct<donor:string,donor_group:string>>")).alias("r"))
    listed = rows.select(F.upper(strip(F.coalesce("r.donor", F.lit("")))).alias("donor_upper"), strip(F.coalesce("r.donor_group", F.lit(""))).alias("donor_group"))
    both = flat.union(listed).filter("donor_upper != '' and donor_group != ''")
    return both.groupBy("donor_upper").agg(F.max("donor_group").alias("donor_group"))


def read_alias_groups(spark: SparkSession, path: str) -> DataFrame:
    """``(group_id, name)`` of alias groups, as ``operators.aliases`` takes them: from CSV with a header (``group_id``, ``name``), or
    from JSON, one list of lists of names, numbered as they come. Blank names are left out; a later group has a name that two
    share."""
    if path.rstrip("/").endswith(".csv"):
        rows = _csv(spark, path).select(F.col("group_id").try_cast("int").alias("group_id"), strip(F.coalesce("name", F.lit(""))).alias("name"))
        return rows.filter("name != '' and group_id is not null")
    text = spark.read.text(path, wholetext=True)  # a lookup of one JSON value
    lists = text.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("group_id", "names"))
    rows = lists.select("group_id", F.explode("names").alias("name")).withColumn("name", strip(F.coalesce("name", F.lit(""))))
    return rows.filter("name != ''")


def answer_key(rows: DataFrame, company: str, a: str, b: str) -> DataFrame:
    """``(company, xl_a, xl_b)``: dollars parsed; rows without a name, or with both amounts 0, are left out."""
    name = strip(F.coalesce(F.col(company), F.lit("")))
    out = rows.select(name.alias("company"), parse_dollar(F.col(a)).alias("xl_a"), parse_dollar(F.col(b)).alias("xl_b"))
    return out.filter((F.col("company") != "") & (F.lower("company") != "nan") & ((F.col("xl_a") != 0) | (F.col("xl_b") != 0)))


def read_answer_key(spark: SparkSession, path: str, company: str, a: str, b: str) -> DataFrame:
    return answer_key(_csv(spark, path), company, a, b)
