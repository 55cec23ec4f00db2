"""Writers of tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorloom.operators.shared import materialize

EXPORT_CAP = 50_000
#: Folder of a row's year in the layout of contributions; a column of the files' path alone.
YEAR = "filed_in"
FILE_ROWS = 2_000_000


def write_contributions(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Contributions laid out for searches: a folder a year of the date, in it files of ranges of donors, sorted by donor, with
    Bloom filters on donor and recipient. A donor of very many rows is spread over ranges of dates and amounts. Undated rows are
    in a folder of their own."""
    laid = df.withColumn(YEAR, F.year("date"))
    laid = laid.repartitionByRange(YEAR, "donor", "date", "amount").sortWithinPartitions(YEAR, "donor", "date")
    out = laid.write.mode("overwrite").partitionBy(YEAR).option("compression", "snappy").option("maxRecordsPerFile", file_rows)
    for c in ("donor", "recipient"):
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(file_rows))
    out.parquet(path)


def write_recipient_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_donor_groups(df: DataFrame, path: str) -> None:
    df.select("donor_upper", "donor_group").write.mode("overwrite").parquet(path)


def export_line_items(items: DataFrame, path: str, cap: int = EXPORT_CAP) -> None:
    """Line items (``operators.reports.line_items``) as CSV, in order; refuses more than ``cap`` rows."""
    items = materialize(items.limit(cap + 1).coalesce(1), "export")  # at most cap + 1 rows, planned once
    if items.count() > cap:
        raise ValueError(f"more than {cap} line items; narrow the search")
    items.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # at most cap rows


def export_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").option("header", True).csv(path)


def write_qc_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").partitionBy("year").parquet(path)
