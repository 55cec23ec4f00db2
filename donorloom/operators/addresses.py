"""Address keys of company donors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorloom.functions.address import address_key


def address_index(df: DataFrame) -> DataFrame:
    """``(donor, street, state, zip5)``: distinct address keys of company rows."""
    rows = df.filter("is_company and donor is not null").select("donor", "street", "state", "zip_code").distinct()
    keyed = rows.withColumn("key", address_key(F.col("street"), F.col("state"), F.col("zip_code"))).filter("key is not null")
    return keyed.select("donor", "key.street", "key.state", "key.zip5").distinct()


def crowded_keys(index: DataFrame) -> DataFrame:
    """``(street, state, zip5, donors)``: how many donors each key has."""
    return index.groupBy("street", "state", "zip5").agg(F.countDistinct("donor").alias("donors"))


def shared_keys(index: DataFrame, most: int = 5) -> DataFrame:
    """The index without keys of more than ``most`` donors: those say nothing, and would be hot in a join."""
    few = crowded_keys(index).filter(F.col("donors") <= most).select("street", "state", "zip5")
    return index.join(few, ["street", "state", "zip5"], "left_semi")


def addresses_of(index: DataFrame) -> DataFrame:
    """``(donor, addresses)``: the keys of each donor as a sorted array."""
    return index.groupBy("donor").agg(F.sort_array(F.collect_set(F.struct("street", "state", "zip5"))).alias("addresses"))
