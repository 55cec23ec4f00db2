"""Filters of contributions. Each is inactive when its values are empty, as in a search form left blank."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from donorloom.sources.filings import read_contributions


@dataclass
class Search:
    start: str | None = None
    end: str | None = None
    donor_types: list[str] = field(default_factory=list)
    states: list[str] = field(default_factory=list)
    recipients: list[str] = field(default_factory=list)
    parties: list[str] = field(default_factory=list)
    city: str = ""
    employer: str = ""
    occupation: str = ""
    least: float = 0
    most: float = 0
    regex: bool = False
    dedupe: bool = True


def within_dates(start: str | None, end: str | None) -> Column:
    """Days between both ends, inclusive; rows without a date never pass a bound."""
    test = F.lit(True)
    if start:
        test &= F.col("date") >= F.to_timestamp(F.lit(start))
    if end:
        test &= F.col("date") <= F.to_timestamp(F.lit(end))
    return F.coalesce(test, F.lit(False))


def one_of(column: str, values: list[str]) -> Column:
    return F.col(column).isin(*values) if values else F.lit(True)


def has_text(column: str, text: str, regex: bool = False) -> Column:
    """Any case; a literal unless ``regex``, which is matched in upper case."""
    if not text:
        return F.lit(True)
    upper = F.upper(F.coalesce(column, F.lit("")))
    return upper.rlike(text.upper()) if regex else upper.contains(text.upper())


def amount_bounds(least: float, most: float) -> Column:
    test = F.lit(True)
    if least > 0:
        test &= F.col("amount") >= least
    if most > 0:
        test &= F.col("amount") <= most
    return test


#: Chosen donors up to which their names are a filter that the files' statistics and Bloom filters see.
LISTED = 1000


def of_donors(df: DataFrame, donors: DataFrame) -> DataFrame:
    chosen = donors.select("donor").distinct()
    listed = [r["donor"] for r in chosen.limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:
        return df.filter(F.col("donor").isin([d for d in listed if d is not None]))
    return df.join(chosen, "donor", "left_semi")


def search_contributions(df: DataFrame, s: Search, donors: DataFrame | None = None) -> DataFrame:
    """Rows that pass every filter, equal rows once (``dedupe``): the filters reach the scan, the shuffle is last."""
    kept = df.filter(
        within_dates(s.start, s.end) & one_of("donor_type", s.donor_types) & one_of("state", s.states) & one_of("recipient", s.recipients) & one_of("recipient_party", s.parties)
        & has_text("city", s.city, s.regex) & has_text("employer", s.employer, s.regex) & has_text("occupation", s.occupation, s.regex) & amount_bounds(s.least, s.most)
    )
    if donors is not None:
        kept = of_donors(kept, donors)
    return kept.distinct() if s.dedupe else kept


def search_table(spark: SparkSession, path: str, s: Search, donors: DataFrame | None = None) -> DataFrame:
    """``search_contributions`` of a stored table (``sources.sinks.write_contributions``): days choose its folders, chosen donors
    and recipients its files and row groups."""
    return search_contributions(read_contributions(spark, path, s.start, s.end), s, donors)


def split_by_type(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("donor_type") == "Individual"), df.filter(F.col("donor_type") == "Non-Individual")
