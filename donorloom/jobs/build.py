"""Build the contributions table from raw filings: ``python -m donorloom.jobs.build RAW REGISTRY PARENTS AFFILIATED OUT``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from donorloom.operators.reports import build_report, recipient_summary
from donorloom.operators.rollup import CONTRIBUTION_COLUMNS, donor_dictionary, matched_rows
from donorloom.operators.shared import materialize
from donorloom.operators.supersession import drop_superseded
from donorloom.sources.filings import read_form_registry, read_raw_contributions
from donorloom.sources.sinks import write_contributions, write_recipient_summary


def build(raw: DataFrame, registry: DataFrame, parents: DataFrame, affiliated: DataFrame) -> dict[str, DataFrame]:
    """The clean table, its summary by recipient and year, and the report of the build."""
    matched = materialize(matched_rows(raw, parents, affiliated, donor_dictionary(raw, parents, affiliated)), "matched")
    kept = drop_superseded(matched, registry, ein="own_ein")
    return {"contributions": kept.select(*CONTRIBUTION_COLUMNS), "summary": recipient_summary(kept), "report": build_report(raw, matched, kept)}


def main(raw: str, registry: str, parents: str, affiliated: str, out: str) -> None:
    spark = SparkSession.builder.appName("donorloom-build").getOrCreate()
    rows = read_raw_contributions(spark, raw)
    lookups = [spark.read.option("header", True).csv(p) for p in (parents, affiliated)]
    made = build(rows, read_form_registry(spark, registry), *lookups)
    write_contributions(made["contributions"], f"{out}/contributions")
    write_recipient_summary(made["summary"], f"{out}/recipient_summary")
    made["report"].write.mode("overwrite").parquet(f"{out}/report")


if __name__ == "__main__":
    main(*sys.argv[1:])
