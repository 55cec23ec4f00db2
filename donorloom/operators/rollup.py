"""Target organizations: affiliates rolled up to their parents, parents named. Both lookups are the caller's; Spark sends them to the
executors where their size allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorloom.functions import cleaning as C
from donorloom.operators.shared import materialize


def target_eins(parents: DataFrame, affiliated: DataFrame) -> DataFrame:
    return parents.select("ein").union(affiliated.select("ein")).distinct()


def filter_targets(df: DataFrame, parents: DataFrame, affiliated: DataFrame) -> DataFrame:
    """Rows of the targets, their EIN normalized."""
    return df.withColumn("recipient_ein", C.norm_ein(F.col("recipient_ein"))).join(target_eins(parents, affiliated).withColumnRenamed("ein", "recipient_ein"), "recipient_ein", "left_semi")


def rollup_affiliates(df: DataFrame, affiliated: DataFrame) -> DataFrame:
    """``parent_ein`` of each row, and in ``affiliated_from`` the name of an affiliate ('' for a parent)."""
    up = affiliated.select(F.col("ein").alias("recipient_ein"), F.col("parent_ein").alias("_up"))
    joined = df.join(up, "recipient_ein", "left")
    return joined.withColumns(
        {"parent_ein": F.coalesce("_up", "recipient_ein"), "affiliated_from": F.when(F.col("_up").isNotNull(), F.col("recipient_name")).otherwise("")}
    ).drop("_up")


def name_recipients(df: DataFrame, parents: DataFrame) -> DataFrame:
    named = parents.select(F.col("ein").alias("parent_ein"), "recipient", F.col("party").alias("recipient_party"))
    return df.join(named, "parent_ein")


_TRIPLE = ("contributor_name", "employer", "occupation")
#: Share of distinct names with employer and occupation among all rows, up to which they are classified once each.
DICTIONARY_SHARE = 0.25


def donor_dictionary(raw: DataFrame, parents: DataFrame, affiliated: DataFrame, share: float = DICTIONARY_SHARE) -> DataFrame | None:
    """Distinct names with employer and occupation of the targets' rows, classified, split and cleaned once each. None where they are
    more than ``share`` of the rows, as they are counted: then each row costs less by itself than in a join."""
    counted = materialize(filter_targets(raw, parents, affiliated).groupBy(*_TRIPLE).agg(F.count("*").alias("n")), "triples")
    distinct, rows = counted.agg(F.count("*"), F.sum("n")).first()
    if not rows or distinct > share * rows:
        return None
    own = counted.select(*_TRIPLE, *(F.col(c).alias(f"_{c}") for c in _TRIPLE))
    return materialize(C.with_donor_columns(own).select(*(f"_{c}" for c in _TRIPLE), "donor_type", "first", "last", "employer", "occupation"), "dictionary")


def _looked_up(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows with the donor columns of their name, employer and occupation. A triple of very many rows is split by adaptive
    execution, where the dictionary is too large to be sent."""
    same = [rows[c].eqNullSafe(dictionary[f"_{c}"]) for c in _TRIPLE]
    return rows.join(dictionary, same[0] & same[1] & same[2]).drop(rows["employer"]).drop(rows["occupation"])


def matched_rows(raw: DataFrame, parents: DataFrame, affiliated: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Raw rows of the targets with every clean column, before supersession; keeps form, period and own EIN. With a
    ``donor_dictionary`` donors are looked up instead of being classified row by row."""
    rows = name_recipients(rollup_affiliates(filter_targets(raw, parents, affiliated), affiliated), parents)
    rows = (C.with_donor_columns(rows) if dictionary is None else _looked_up(rows, dictionary)).withColumn("filing_day", C.filing_day(F.col("date"), F.col("period_end")))
    return rows.select(
        F.col("contributor_name").alias("donor"), "last", "first", (F.col("donor_type") == C.ORGANIZATION).alias("is_company"), "donor_type", "employer", "occupation",
        C.clean_text(F.col("address")).alias("street"), C.clean_text(F.col("city")).alias("city"), C.clean_text(F.col("state")).alias("state"),
        C.clean_text(F.col("zipcode")).alias("zip_code"), C.parse_amount(F.col("amount")).alias("amount"), C.day_timestamp(F.col("filing_day")).alias("date"),
        "filing_day", "recipient", "recipient_party", F.col("parent_ein").alias("recipient_ein"), "affiliated_from",
        F.col("recipient_ein").alias("own_ein"), "form_id", "period_begin", "period_end",
    )


CONTRIBUTION_COLUMNS = (
    "donor", "last", "first", "is_company", "donor_type", "employer", "occupation", "street", "city", "state", "zip_code",
    "amount", "date", "recipient", "recipient_party", "recipient_ein", "affiliated_from",
)
