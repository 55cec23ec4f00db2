"""Totals, breakdowns, profiles and line items. Sums of money are rounded to cents, as their order is not fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorloom.operators.shared import materialize

# Columns of a list of contributions and their headings.
HEADINGS = {
    "donor_type": "Donor Type", "donor": "Donor", "employer": "Employer", "occupation": "Occupation", "street": "Street", "city": "City",
    "state": "State", "zip_code": "ZIP", "amount": "Amount", "date": "Date", "recipient": "Recipient", "recipient_party": "Party",
}
DISPLAY_CAP = 5000


def money(c: str | Column = "amount") -> Column:
    return F.round(F.sum(c), 2)


def recipient_summary(df: DataFrame) -> DataFrame:
    """Amount and number of contributions by recipient and year; undated ones under a null year."""
    return df.groupBy("recipient", "recipient_party", "recipient_ein", F.year("date").alias("year")).agg(money().alias("total_amount"), F.count("*").alias("transactions"))


def result_metrics(df: DataFrame, *by: str) -> DataFrame:
    """Amount, distinct donors and rows, over all or by columns such as ``donor_type``."""
    return df.groupBy(*by).agg(F.coalesce(money(), F.lit(0.0)).alias("total_amount"), F.countDistinct("donor").alias("donors"), F.count("*").alias("n_rows"))


def recipient_breakdown(df: DataFrame) -> DataFrame:
    """Total of each recipient in its party, and the number of the party's recipients; largest first."""
    totals = df.groupBy("recipient_party", "recipient").agg(money().alias("total_amount"), F.count("*").alias("transactions"))
    parties = totals.groupBy("recipient_party").agg(F.countDistinct("recipient").alias("party_recipients"))
    return totals.join(parties, "recipient_party").orderBy(F.desc("total_amount"), "recipient_party", "recipient")


def database_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct("recipient").alias("recipients"), F.to_date(F.min("date")).alias("first_date"), F.to_date(F.max("date")).alias("last_date"),
        F.count_if(F.col("donor_type") == "Individual").alias("individual_rows"), F.count_if(F.col("donor_type") == "Non-Individual").alias("organization_rows"),
    )


def distinct_donors(df: DataFrame) -> DataFrame:
    return df.select("donor").filter("donor is not null").distinct().orderBy("donor")


def build_report(raw: DataFrame, matched: DataFrame, kept: DataFrame) -> DataFrame:
    """``(section, item, n)``: rows scanned, matched, removed and kept; and of the matched rows the number by class, by
    affiliate, and by parent and year of filing ('?': no date)."""
    year = F.coalesce(F.substr("filing_day", F.lit(1), F.lit(4)), F.lit("?"))
    cells = matched.groupBy("donor_type", "own_ein", "recipient_ein", year.alias("year")).agg(F.count("*").alias("n"))
    cells = materialize(cells, "cells")  # each frame is read once
    left = materialize(kept.agg(F.count("*").alias("n")), "kept-count")

    def part(df: DataFrame, section: str, item: Column) -> DataFrame:
        return df.groupBy(item.alias("item")).agg(F.sum("n").alias("n")).select(F.lit(section).alias("section"), "item", "n")

    scanned = raw.agg(F.count("*").alias("n")).select(F.lit("rows").alias("section"), F.lit("scanned").alias("item"), "n")
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    gone = total.union(left.select(-F.col("n"))).agg(F.sum("n").alias("n"))
    out = scanned.union(total.select(F.lit("rows"), F.lit("matched"), "n")).union(left.select(F.lit("rows"), F.lit("kept"), "n")).union(gone.select(F.lit("rows"), F.lit("removed"), "n"))
    out = out.union(part(cells, "class", F.col("donor_type"))).union(part(cells.filter("own_ein != recipient_ein"), "affiliate", F.concat_ws(" -> ", "own_ein", "recipient_ein")))
    return out.union(part(cells, "parent year", F.concat_ws(" ", "recipient_ein", "year")))


def display(df: DataFrame) -> DataFrame:
    """Twelve columns under their headings, the date as MM/dd/yyyy."""
    return df.select(*((F.date_format(c, "MM/dd/yyyy") if c == "date" else F.col(c)).alias(h) for c, h in HEADINGS.items()))


def line_items(df: DataFrame, cap: int | None = DISPLAY_CAP) -> DataFrame:
    """Displayed rows by donor, then by the date as it is printed (month first), then by all other columns; the first
    ``cap`` of them (a top-k, not a sort of everything)."""
    shown = display(df)
    rest = [c for c in shown.columns if c not in ("Donor", "Date")]
    ordered = shown.orderBy(*(F.col(f"`{c}`").asc_nulls_last() for c in ("Donor", "Date", *rest)))
    return ordered if cap is None else ordered.limit(cap)
