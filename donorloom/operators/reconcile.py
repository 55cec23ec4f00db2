"""Totals held against an outside answer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorloom.operators.aliases import with_aliases
from donorloom.functions.names import canonical_name, name_variants
from donorloom.operators.clusters import n_words
from donorloom.operators.prefixes import prefix_pairs

RANK = ("No", "Close match", "Yes")


def match_status(db: Column, xl: Column) -> Column:
    d = F.abs(db - xl)
    return F.when(d < 1, "Yes").when(d <= 2000, "Close match").otherwise("No")


def combined_status(a: Column, b: Column) -> Column:
    """The worse of two."""
    rank = [F.array_position(F.lit(list(RANK)), x).cast("int") for x in (a, b)]
    return F.element_at(F.lit(list(RANK)), F.least(*rank))


def neither_status(a: Column, b: Column) -> Column:
    return F.when((a == "No") & (b == "No"), "Yes").otherwise("No")


def _variants(df: DataFrame, key: str, groups: DataFrame | None) -> DataFrame:
    own = df.select(key, F.explode(name_variants(F.col(key))).alias("variant"))
    return own if groups is None else with_aliases(own, groups, key)


def owned_variants(donors: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``(variant, donor)``: of donors that share a variant, the first by canonical name, then by name, has it."""
    rows = _variants(donors, "donor", groups).withColumn("canonical", canonical_name(F.col("donor")))
    return rows.groupBy("variant").agg(F.min(F.struct("canonical", "donor"))["donor"].alias("donor"))


def match_exact(companies: DataFrame, owned: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``(company, donor)``: the donor, first by canonical name, that has one of a company's variants."""
    met = _variants(companies, "company", groups).join(owned, "variant")
    return met.groupBy("company").agg(F.min(F.struct(canonical_name(F.col("donor")).alias("canonical"), "donor"))["donor"].alias("donor"))


def match_prefix(companies: DataFrame, owned: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The same for companies of which a variant begins, or is begun by, a donor's: the longest beginning decides."""

    def fit(df: DataFrame) -> DataFrame:
        v = F.col("variant")
        return df.filter(F.when(n_words(v) >= 2, F.length(v) >= 10).otherwise(F.length(v) >= 7))

    def pairs(shorter: DataFrame, longer: DataFrame) -> DataFrame:
        texts = lambda df: df.select(F.col("variant").alias("text")).distinct()
        met = prefix_pairs(texts(shorter).withColumn("free", n_words(F.col("text")) >= 2), texts(longer))
        met = met.join(shorter.withColumnRenamed("variant", "shorter"), "shorter").join(longer.withColumnRenamed("variant", "longer"), "longer")
        return met.select("company", "donor", "shorter")

    left, right = fit(_variants(companies, "company", groups)), fit(owned)
    met = pairs(right, left).union(pairs(left, right))
    best = F.min(F.struct((-F.length("shorter")).alias("n"), canonical_name(F.col("donor")).alias("canonical"), "donor"))
    return met.groupBy("company").agg(best["donor"].alias("donor"))


def qc_sheet(key: DataFrame, donors: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``key`` (company, xl_a, xl_b) against ``donors`` (donor, db_a, db_b): the donor of each company, its amounts and how
    they compare. A company without a donor has amounts 0 and the donor ``(none)``."""
    owned = owned_variants(donors.select("donor").distinct(), groups)
    companies = key.select("company").distinct()
    exact = match_exact(companies, owned, groups)
    rest = match_prefix(companies.join(exact, "company", "left_anti"), owned, groups)
    sums = donors.groupBy("donor").agg(F.sum("db_a").alias("db_a"), F.sum("db_b").alias("db_b"))
    rows = key.join(exact.union(rest), "company", "left").join(sums, "donor", "left")
    rows = rows.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 2) for c in ("db_a", "db_b")})
    rows = rows.withColumns({"a_match": match_status(F.col("db_a"), F.col("xl_a")), "b_match": match_status(F.col("db_b"), F.col("xl_b"))})
    a, b = F.col("a_match"), F.col("b_match")
    return rows.select(
        "company", "xl_a", "db_a", "xl_b", "db_b", "a_match", "b_match", combined_status(a, b).alias("both_match"), neither_status(a, b).alias("neither_match"),
        F.coalesce("donor", F.lit("(none)")).alias("matched_donor"),
    )


def summarize_qc(sheet: DataFrame, *by: str) -> DataFrame:
    def share(n: Column) -> Column:
        return F.when(F.count("*") > 0, F.round(100.0 * n / F.count("*"), 1))

    counts = {
        "both_yes": F.count_if(F.col("both_match") == "Yes"), "both_close": F.count_if(F.col("both_match") == "Close match"),
        "a_yes": F.count_if(F.col("a_match") == "Yes"), "b_yes": F.count_if(F.col("b_match") == "Yes"), "neither": F.count_if(F.col("neither_match") == "Yes"),
    }
    return sheet.groupBy(*by).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in counts.items()), *(share(c).alias(f"{k}_pct") for k, c in counts.items()))


def qc_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """``(year, metric, old_pct, new_pct, delta)`` from two summaries by year; of unrounded shares, rounded at the end."""
    metrics = ("both_yes", "a_yes", "b_yes", "neither")

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.when(F.col("n") > 0, 100.0 * F.col(m) / F.col("n")).alias("v")) for m in metrics))
        return df.select("year", F.explode(pairs).alias("p")).select("year", "p.metric", F.col("p.v").alias(name))

    both = long(new, "new").join(long(old, "old"), ["year", "metric"], "left")
    return both.select("year", "metric", F.round("old", 1).alias("old_pct"), F.round("new", 1).alias("new_pct"), F.round(F.col("new") - F.col("old"), 1).alias("delta"))
