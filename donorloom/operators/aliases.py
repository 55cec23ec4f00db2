"""Alias groups: lists of names of one organization, as a table that the caller passes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorloom.functions.names import name_variants

# A small sample of alias groups.
SAMPLE = (("Chubb", "ACE American Insurance Company"), ("Altria", "Altria Client Services", "Philip Morris USA"), ("CVS", "CVS Health", "CVS Caremark"))


def sample_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, group in enumerate(SAMPLE) for n in group], "group_id int, name string")


def alias_forms(groups: DataFrame) -> DataFrame:
    """``(form, group_id)``: every form of every name of a group; a form that two groups share belongs to the later one."""
    forms = groups.select("group_id", F.explode(name_variants(F.col("name"))).alias("form"))
    return forms.groupBy("form").agg(F.max("group_id").alias("group_id"))


def group_forms(groups: DataFrame) -> DataFrame:
    """``(group_id, form)``: all forms of a group, shared ones too."""
    return groups.select("group_id", F.explode(name_variants(F.col("name"))).alias("form")).distinct()


def with_aliases(variants: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``(key, variant)`` with the forms of each group that one of a key's variants belongs to (one hop)."""
    hit = variants.join(alias_forms(groups), F.col("variant") == F.col("form")).select(key, "group_id").distinct()
    more = hit.join(group_forms(groups), "group_id").select(key, F.col("form").alias("variant"))
    return variants.select(key, "variant").union(more).distinct()
