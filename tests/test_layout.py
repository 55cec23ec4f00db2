import glob
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from donorloom.operators.filters import LISTED, Search, of_donors, search_contributions, search_table
from donorloom.sources import filings, sinks

COLUMNS = "donor string, donor_type string, employer string, occupation string, city string, state string, amount double, date timestamp_ntz, recipient string, recipient_party string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """40,000 rows of 12 years and 2,000 donors, one of which has a third, and undated ones."""
    path = str(tmp_path_factory.mktemp("laid") / "c")
    n = F.col("id")
    donor = F.when(n % 3 == 0, "HOT").otherwise(F.concat(F.lit("D"), F.lpad((n * 7919 % 2000).cast("string"), 4, "0")))
    date = F.when(n % 50 != 0, F.date_add(F.lit("2010-01-01").cast("date"), (n * 31 % 4380).cast("int")).cast("timestamp"))
    text = {"donor_type": "Individual", "employer": "", "occupation": "", "city": "X", "state": "NY", "recipient_party": "P"}
    rows = spark.range(40_000).select(donor.alias("donor"), *(F.lit(v).alias(c) for c, v in text.items()), (n % 997).cast("double").alias("amount"), date.alias("date"), F.concat(F.lit("R"), n % 20).alias("recipient"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    sinks.write_contributions(rows, path, file_rows=1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    return path, rows


def files_read(df):
    """Files that the scan of a query without a shuffle has opened, by Spark's own count."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_round_trip(spark, stored):
    path, rows = stored
    back = filings.read_contributions(spark, path)
    assert set(back.columns) == set(rows.columns)
    order = sorted(rows.columns)
    assert sorted(map(str, back.select(order).collect())) == sorted(map(str, rows.select(order).collect()))


def test_days_choose_folders(spark, stored):
    path, rows = stored
    s = Search(start="2013-03-01", end="2014-06-30", dedupe=False)
    found = search_table(spark, path, s)
    assert found.count() == search_contributions(rows, s).count() > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*{sinks.YEAR}", plan)
    own, every = glob.glob(f"{path}/filed_in=201[34]/*.parquet"), glob.glob(f"{path}/*/*.parquet")
    assert files_read(found) == len(own) < len(every) / 4
    assert search_table(spark, path, Search(dedupe=False)).count() == 40_000  # undated ones too


def test_donors_choose_files(spark, stored):
    """The scan is told the donors; in each year few files' ranges hold one; Bloom filters are there; a hot donor is spread."""
    path, rows = stored
    chosen = spark.createDataFrame([("D0100",), ("D1501",), (None,)], "donor string")
    s = Search(start="2012-01-01", end="2012-12-31", dedupe=False)
    found = search_table(spark, path, s, chosen)
    assert found.count() == search_contributions(rows, s, chosen).count() > 0
    assert "In(donor, [D0100,D1501])" in found._jdf.queryExecution().executedPlan().toString()
    own = glob.glob(f"{path}/filed_in=2012/*.parquet")
    span = {}
    for f in own:
        meta = pq.ParquetFile(f).metadata
        column = [meta.row_group(g).column(meta.schema.names.index("donor")).statistics for g in range(meta.num_row_groups)]
        span[f] = (min(x.min for x in column), max(x.max for x in column))
    assert len(own) >= 3 and sum(low <= "D0100" <= high for low, high in span.values()) == 1
    assert sum(low <= "HOT" <= high for low, high in span.values()) >= 2
    assert of_donors(rows, rows.select("donor")).count() == 40_000 and rows.select("donor").distinct().count() > LISTED
