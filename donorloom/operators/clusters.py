"""Donors resolved to entities: links between canonical names, and their connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorloom.functions.address import CITY_RATIO, STREET_RATIO, address_form, forms_compatible
from donorloom.functions.names import alias_candidates, canonical_name
from donorloom.functions.similarity import indel_ratio
from donorloom.operators import similar
from donorloom.operators.aliases import alias_forms
from donorloom.operators.components import connected_components
from donorloom.operators.prefixes import prefix_pairs
from donorloom.operators.shared import materialize

#: Names of one block up to which all are compared with all.
BLOCK_NAMES = 2000


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda w: w != ""))


def canonicals(donors: DataFrame) -> DataFrame:
    return donors.select("donor").filter("donor is not null").distinct().withColumn("canonical", canonical_name(F.col("donor")))


def _stars(members: DataFrame, group: str) -> DataFrame:
    """Links from each group's least canonical to the others."""
    head = members.groupBy(group).agg(F.min("canonical").alias("a"))
    return members.join(head, group).filter(F.col("a") != F.col("canonical")).select("a", F.col("canonical").alias("b")).distinct()


def alias_members(named: DataFrame, groups: DataFrame) -> DataFrame:
    """``(donor, canonical, group_id)``: the group of the first of a donor's forms that the alias table has."""
    forms = named.select("donor", "canonical", F.posexplode(alias_candidates(F.col("donor"))).alias("pos", "form"))
    return forms.join(alias_forms(groups), "form").groupBy("donor", "canonical").agg(F.min_by("group_id", "pos").alias("group_id"))


def alias_edges(named: DataFrame, groups: DataFrame) -> DataFrame:
    return _stars(alias_members(named, groups), "group_id")


def group_members(named: DataFrame, donor_groups: DataFrame) -> DataFrame:
    """``(donor, canonical, donor_group)``: the validated group of a donor's name in upper case."""
    return named.withColumn("donor_upper", F.upper("donor")).join(donor_groups, "donor_upper").filter("donor_group != ''").select("donor", "canonical", "donor_group")


def group_edges(named: DataFrame, donor_groups: DataFrame) -> DataFrame:
    return _stars(group_members(named, donor_groups), "donor_group")


def prefix_edges(names: DataFrame) -> DataFrame:
    """``(a, b)``: names of 7 or more characters where ``a`` begins ``b``: two words or more of 10 characters, or one whole
    word."""
    own = names.select(F.col("canonical").alias("text")).distinct().filter(F.length("text") >= 7)
    words = n_words(F.col("text"))
    begins = own.withColumn("free", (words >= 2) & (F.length("text") >= 10)).filter(F.col("free") | (words == 1))
    return prefix_pairs(begins, own).filter("shorter != longer").select(F.col("shorter").alias("a"), F.col("longer").alias("b"))


def fuzzy_pairs(names: DataFrame, block_names: int = BLOCK_NAMES) -> DataFrame:
    """``(a, b, ratio, threshold)``: pairs of names of 15 or more characters and two words or more that share their first
    five characters and are similar to within 5 of their threshold. Names of large blocks meet by an index of segments; pairs
    whose lengths or characters rule the threshold out are never compared."""
    enough = (F.length("canonical") >= similar.LEAST) & (n_words(F.col("canonical")) >= 2)
    own = names.select("canonical").distinct().filter(enough).withColumn("block", F.substr("canonical", F.lit(1), F.lit(similar.BLOCK)))
    pairs = similar.similar_candidates(own, block_names)
    return pairs.select("a", "b", "threshold", indel_ratio(F.col("a"), F.col("b")).alias("ratio")).filter(F.col("ratio") >= F.col("threshold") - similar.BELOW)


def fuzzy_edges(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("ratio") >= F.col("threshold")).select("a", "b")


def raw_addresses(df: DataFrame) -> DataFrame:
    """``(donor_upper, street, city, state)``: distinct addresses of a donor, whatever its type."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("street", "city", "state")}
    return df.filter("donor is not null").select(F.upper("donor").alias("donor_upper"), *(v.alias(c) for c, v in text.items())).distinct()


def address_edges(pairs: DataFrame, named: DataFrame, addresses: DataFrame) -> DataFrame:
    """Borderline pairs of which any two addresses agree. Pairs and the distinct address forms of their names are written once; forms
    that are equal meet by equality and decide first. Only forms of pairs that are left meet by state, and only those that their
    characters do not rule out go through ratios."""
    close = materialize(pairs.filter(F.col("ratio") < F.col("threshold")).select("a", "b").distinct(), "close-pairs")
    ends = close.select(F.explode(F.array("a", "b")).alias("canonical")).distinct()
    at = named.join(ends, "canonical", "left_semi").withColumn("donor_upper", F.upper("donor")).join(addresses, "donor_upper").filter("trim(street) != ''")
    at = at.select("canonical", address_form(F.struct("street", "city", "state")).alias("form")).filter("form.street != ''").distinct()
    at = materialize(at, "address-forms")
    equal = materialize(_equal_places(close, at.select("canonical", "form.*")), "equal-addresses")
    counted = at.withColumns({c: similar.letter_counts(F.col(f"form.{c}")) for c in ("street", "city")})
    side = lambda name, form: counted.select(F.col("canonical").alias(name), F.col("form.state").alias("state"), F.col("form").alias(form), *(F.col(c).alias(f"{form}_{c}") for c in ("street", "city")))
    met = close.join(equal, ["a", "b"], "left_anti").join(side("a", "x"), "a").join(side("b", "y"), ["b", "state"])
    return equal.union(address_candidates(met).filter(forms_compatible(F.col("x"), F.col("y"))).select("a", "b").distinct())


def _equal_places(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """Pairs of which two address forms have the same street, city and state, and no different parts of a building."""
    place = ["street", "city", "state"]
    exact = at.filter("part is not null")
    whole = at.filter("part is null").select("canonical", *place)
    any_part = at.select("canonical", *place).distinct()
    meet = lambda x, y, on: pairs.join(x.withColumnRenamed("canonical", "a"), "a").join(y.withColumnRenamed("canonical", "b"), ["b", *on]).select("a", "b")
    return meet(exact, exact, [*place, "part"]).union(meet(whole, any_part, place)).union(meet(any_part, whole, place)).distinct()


def address_candidates(met: DataFrame) -> DataFrame:
    """Pairs of address forms that the counts of their characters do not rule out; only these are compared."""
    street, city = (similar.ratio_bound(F.col(f"x_{c}"), F.col(f"y_{c}")) for c in ("street", "city"))
    apart = (F.col("x.part") != F.col("y.part")) & F.col("x.part").isNotNull() & F.col("y.part").isNotNull()
    no_city = (F.col("x.city") == "") | (F.col("y.city") == "")
    return met.filter((street >= STREET_RATIO) & (no_city | (city >= CITY_RATIO)) & ~apart)


def donor_links(named: DataFrame, addresses: DataFrame | None = None, donor_groups: DataFrame | None = None, groups: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """``(a, b)``: all links between canonical names: prefixes, alias and validated groups, similarity and, for borderline pairs,
    addresses."""
    names = named.select("canonical").distinct()
    both = prefix_edges(names)
    if groups is not None:
        both = both.union(alias_edges(named, groups))
    if donor_groups is not None:
        both = both.union(group_edges(named, donor_groups))
    if fuzzy:
        pairs = materialize(fuzzy_pairs(names), "similar")
        both = both.union(fuzzy_edges(pairs))
        if addresses is not None:
            both = both.union(address_edges(pairs, named, addresses))
    return both


def label_donors(named: DataFrame, component: DataFrame) -> DataFrame:
    """``(donor, canonical_donor)``: a cluster is named by its shortest canonical name, the first by code point among equals."""
    names = named.select("canonical").distinct()
    member = names.join(component, names["canonical"] == component["node"], "left").select("canonical", F.coalesce("component", "canonical").alias("component"))
    label = member.groupBy("component").agg(F.min(F.struct(F.length("canonical").alias("n"), "canonical"))["canonical"].alias("canonical_donor"))
    return named.join(member.join(label, "component"), "canonical").select("donor", "canonical_donor")


def cluster_donors(donors: DataFrame, addresses: DataFrame | None = None, donor_groups: DataFrame | None = None, groups: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """``(donor, canonical_donor)`` for every distinct donor: components of all links between canonical names."""
    named = materialize(canonicals(donors), "canonicals")
    return label_donors(named, connected_components(donor_links(named, addresses, donor_groups, groups, fuzzy)))
