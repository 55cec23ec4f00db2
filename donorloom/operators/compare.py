"""What clusters of donors gave to two groups of recipients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from donorloom.operators.shared import materialize


def attach_clusters(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """``df`` with ``canonical_donor``; rows without a donor have none."""
    return df.join(clusters.select("donor", "canonical_donor"), "donor", "left")


def donor_recipient_sums(df: DataFrame) -> DataFrame:
    """Sums and rows ``n`` of each cluster, donor, type and recipient: everything that a comparison needs, in one shuffle of the
    rows. The functions below take such sums as well as rows."""
    return df.filter("canonical_donor is not null").groupBy("canonical_donor", "donor", "donor_type", "recipient").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))


def group_totals(df: DataFrame, recipients: list[str], least: float | None = None, above: float | None = None) -> DataFrame:
    """``(canonical_donor, total)`` over a set of recipients, of those whose rounded total is at least or above a limit."""
    out = df.filter(F.col("recipient").isin(*recipients) & F.col("canonical_donor").isNotNull()).groupBy("canonical_donor").agg(F.round(F.sum("amount"), 2).alias("total"))
    if least is not None:
        out = out.filter(F.col("total") >= least)
    return out if above is None else out.filter(F.col("total") > above)


def qualifying(df: DataFrame, a: list[str], b: list[str], least_a: float = 1000, most_b: float = 0) -> DataFrame:
    """Clusters that gave ``least_a`` or more to group A, less those that gave over ``most_b`` to group B."""
    gave = group_totals(df, a, least=least_a).select("canonical_donor")
    return gave.join(group_totals(df, b, above=most_b), "canonical_donor", "left_anti") if b else gave


def display_names(df: DataFrame) -> DataFrame:
    """``(canonical_donor, display_name, n)``: each cluster's most frequent donor, the first by name among equals."""
    rows = F.sum("n") if "n" in df.columns else F.count("*")
    counts = df.filter("canonical_donor is not null").groupBy("canonical_donor", "donor").agg(rows.alias("n"))
    order = W.partitionBy("canonical_donor").orderBy(F.desc("n"), "donor")
    return counts.withColumn("place", F.row_number().over(order)).filter("place = 1").select("canonical_donor", F.col("donor").alias("display_name"), "n")


def donor_recipient_matrix(df: DataFrame, recipients: list[str]) -> DataFrame:
    """A row a cluster, a column a recipient (all listed ones, gaps 0), and the row's ``total``; largest first."""
    wide = df.filter(F.col("recipient").isin(*recipients) & F.col("canonical_donor").isNotNull()).groupBy("canonical_donor").pivot("recipient", recipients).agg(F.round(F.sum("amount"), 2))
    wide = wide.na.fill(0.0, recipients)
    total = sum((F.col(f"`{r}`") for r in recipients), F.lit(0.0))
    return wide.withColumn("total", F.round(total, 2)).orderBy(F.desc("total"), "canonical_donor")


def compare(df: DataFrame, a: list[str], b: list[str], least_a: float = 1000, most_b: float = 0) -> dict[str, DataFrame]:
    """The comparison: qualifying clusters, their matrix by donor type with display names, and their line items. The rows are
    summed once; they themselves are read again for the line items only."""
    sums = materialize(donor_recipient_sums(df), "sums")
    chosen = materialize(qualifying(sums, a, b, least_a, most_b), "qualifying")
    both = list(dict.fromkeys([*a, *b]))
    rows, own = (x.join(chosen, "canonical_donor", "left_semi") for x in (df, sums))
    names = display_names(own)
    out = {"qualifying": chosen, "names": names, "line_items": rows.filter(F.col("recipient").isin(*both))}
    for kind in ("Individual", "Non-Individual"):
        matrix = donor_recipient_matrix(own.filter(F.col("donor_type") == kind), both)
        out[kind] = matrix.join(names.select("canonical_donor", "display_name"), "canonical_donor")
    return out
