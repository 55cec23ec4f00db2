"""Donors that match search terms, by tiers: alias, exact, prefix, acronym, similarity; then place names and addresses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from donorloom.functions import names as N
from donorloom.functions.cleaning import strip
from donorloom.functions.similarity import partial_ratios, ratios
from donorloom.operators.addresses import shared_keys
from donorloom.operators.aliases import alias_forms, group_forms, with_aliases
from donorloom.operators.clusters import n_words
from donorloom.operators.prefixes import prefix_pairs
from donorloom.operators.shared import materialize
from donorloom.operators.term_index import TermIndex

KEEP, STRONG, BORDERLINE, SPARSE, COLOCATED = 72, 86, (72, 85), 5, 5
#: Terms of a batch up to which they are sent to every executor for the tiers that compare all with all.
TERMS = 10_000


def simple(c: Column) -> Column:
    """Upper case without dots, dashes, commas and apostrophes."""
    return strip(F.regexp_replace(F.regexp_replace(strip(F.upper(c)), r"[.\-,']", ""), r"(?U)\s+", " "))


def donor_dimension(donors: DataFrame) -> DataFrame:
    """Distinct donors with what matching needs of each: computed on names, never on rows."""
    own = donors.select("donor").filter("donor is not null").distinct()
    return own.select("donor", N.name_variants(F.col("donor")).alias("variants"), N.stripped_forms(F.col("donor")).alias("forms"), N.acronym(F.col("donor")).alias("acronym"), simple(F.col("donor")).alias("simple"))


def term_dimension(terms: DataFrame) -> DataFrame:
    """``(query, pos, term, ...)``: the search names of each query, in order."""
    rows = terms.filter("trim(query) != ''").select("query", F.posexplode(N.search_names(F.col("query"))).alias("pos", "term"))
    t = F.col("term")
    return rows.withColumns({"forms": N.stripped_forms(t), "acronym": N.acronym(t), "simple": simple(t)})


def _exact(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return left.join(right, "variant").select(*key, "donor").distinct()


def _prefix(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of which one variant begins the other: any prefix of 6 characters or more, a whole first word of 2 to 5."""
    v = F.col("text")

    def begins(df: DataFrame) -> DataFrame:
        own = df.select(F.col("variant").alias("text")).distinct().filter(F.length("text") >= 2)
        return own.withColumn("free", F.length(v) >= 6).filter(F.col("free") | (n_words(v) == 1))

    def texts(df: DataFrame) -> DataFrame:
        return df.select(F.col("variant").alias("text")).filter(F.length("text") >= 2).distinct()

    def named(pairs: DataFrame, shorter: DataFrame, longer: DataFrame) -> DataFrame:
        met = pairs.join(shorter.withColumnRenamed("variant", "shorter"), "shorter").join(longer.withColumnRenamed("variant", "longer"), "longer")
        return met.select(*key, "donor")

    a = named(prefix_pairs(begins(left), texts(right)), left, right)
    b = named(prefix_pairs(begins(right), texts(left)), right, left)
    return a.union(b).distinct()


def search_donors(terms: DataFrame, donors: DataFrame, groups: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``(query, donor, score, match_type)`` of the donors that match each query, before addresses are looked at.

    A donor's score is that of the first search name of the query that reaches 72, by the first tier that it
    reaches there: alias 99, exact 100, prefix 96, acronym 95, 93 or 90, similarity. Queries with fewer than five
    matches also match without the place in their name. Tiers of equality, acronyms too, are joins; for similarity the
    terms (at most TERMS, more raise) are sent to every executor.
    """
    if terms.limit(TERMS + 1).count() > TERMS:
        raise ValueError(f"more than {TERMS} search terms; search them in batches")
    dim = materialize(donor_dimension(donors), "donors")
    names = materialize(term_dimension(terms.select("query").distinct()), "terms")
    key = ["query", "pos"]
    donor_forms = with_aliases(dim.select("donor", F.explode("variants").alias("variant")), groups, "donor")
    own = names.select("query", "pos", F.explode(N.name_variants(F.col("term"))).alias("variant")).withColumn("key", F.struct("query", "pos"))
    term_forms = with_aliases(own.select("key", "variant"), groups, "key").select("key.query", "key.pos", "variant")
    hit = term_forms.join(alias_forms(groups), F.col("variant") == F.col("form")).select(*key, "group_id").distinct()
    alias = hit.join(group_forms(groups).withColumnRenamed("form", "variant"), "group_id").join(donor_forms, "variant").select(*key, "donor").distinct()
    tiers = [
        alias.select(*key, "donor", F.lit(0).alias("tier"), F.lit(99.0).alias("score"), F.lit("alias match").alias("match_type")),
        _exact(term_forms, donor_forms, key).select(*key, "donor", F.lit(1), F.lit(100.0), F.lit("exact match")),
        _prefix(term_forms, donor_forms, key).select(*key, "donor", F.lit(2), F.lit(96.0), F.lit("prefix match")),
    ]
    term = names.select(*key, F.col("acronym").alias("t_acronym"), F.col("simple").alias("t_simple"))
    acronyms = [
        (term.filter("length(t_simple) >= 2"), dim.filter("acronym != ''"), F.col("t_simple") == F.col("acronym"), 95.0),
        (term.filter("length(t_acronym) >= 2"), dim, F.col("simple") == F.col("t_acronym"), 93.0),
        (term.filter("length(t_acronym) >= 3"), dim, F.col("acronym") == F.col("t_acronym"), 90.0),
    ]
    for some, donors_, equal, score in acronyms:
        tiers.append(some.join(donors_, equal).select(*key, "donor", F.lit(3), F.lit(score), F.lit("acronym match")))
    found = tiers[0]
    for t in tiers[1:]:
        found = found.union(t)
    found = materialize(found, "equal-matches")
    if fuzzy:
        found = found.union(_similar(dim, names, found).select(*key, "donor", F.lit(4), "score", F.lit("fuzzy match")))
    first = first_match(found)
    return materialize(first.union(_without_place(names, first, donor_forms, groups)), "matches")


def _similar(dim: DataFrame, names: DataFrame, found: DataFrame) -> DataFrame:
    """``(query, pos, donor, score)`` of the terms that no earlier tier has found a donor for and that are similar to it: the
    best ratio of their forms.

    An index of the forms of all terms is at each task; a donor's form is compared with those alone that the index finds for it
    (an exact bound). Terms found already are an array at the donor.
    """
    rows = names.select("query", "pos", "forms").orderBy("query", "pos").collect()  # at most TERMS queries
    forms = sorted({(i, f) for i, r in enumerate(rows) for f in r["forms"] if len(f) >= 2})
    sent = dim.sparkSession.sparkContext.broadcast(([i for i, _ in forms], TermIndex([f for _, f in forms], KEEP)))
    places = names.sparkSession.createDataFrame([(i, r["query"], r["pos"]) for i, r in enumerate(rows)], "term int, query string, pos int")
    done = found.select("query", "pos", "donor").distinct().join(F.broadcast(places), ["query", "pos"]).groupBy("donor").agg(F.collect_set("term").alias("done"))

    def run(batches):
        owner, index = sent.value
        for b in batches:
            out: dict[tuple[str, int], float] = {}
            left, right, where = [], [], []

            def compare():
                if left:
                    for k, x in zip(where, np.maximum(ratios(left, right), partial_ratios(left, right)).tolist(), strict=True):
                        if x >= KEEP:
                            out[k] = max(x, out.get(k, 0.0))
                for x in (left, right, where):
                    x.clear()

            for donor, own, seen in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                skip = set(seen or ())
                for f in sorted({f for f in own if len(f) >= 2}):
                    for i in index.candidates(f).tolist():
                        if owner[i] not in skip:
                            left.append(index.terms[i])
                            right.append(f)
                            where.append((donor, owner[i]))
                if len(left) > 20_000:
                    compare()
            compare()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out]), pa.array([k[1] for k in out], pa.int32()), pa.array(list(out.values()), pa.float64())], ["donor", "term", "score"])

    rest = dim.select("donor", "forms").join(done, "donor", "left")
    return rest.mapInArrow(run, "donor string, term int, score double").join(F.broadcast(places), "term").select("query", "pos", "donor", "score")


def first_match(found: DataFrame) -> DataFrame:
    """Of each query and donor, the match of the first search name, by its first tier, then its best score."""
    order = W.partitionBy("query", "donor").orderBy("pos", "tier", F.desc("score"), "match_type")
    return found.withColumn("place", F.row_number().over(order)).filter("place = 1").select("query", "donor", "score", "match_type")


def _without_place(names: DataFrame, first: DataFrame, donor_forms: DataFrame, groups: DataFrame) -> DataFrame:
    """Further matches of queries with few, by their names without " OF <place>"."""
    counted = names.select("query").distinct().join(first.groupBy("query").count(), "query", "left").filter(F.coalesce("count", F.lit(0)) < SPARSE)
    plain = N.normalize_donor(F.col("term"))
    bare = names.join(counted.select("query"), "query", "left_semi").select("query", "pos", plain.alias("plain"), N.strip_geo(plain).alias("bare")).filter("bare != plain and bare != ''")
    own = bare.select(F.struct("query", "pos").alias("key"), F.explode(N.name_variants(F.col("bare"))).alias("variant"))
    forms = with_aliases(own, groups, "key").select("key.query", "key.pos", "variant")
    key = ["query", "pos"]
    more = _exact(forms, donor_forms, key).select(*key, "donor", F.lit(0).alias("tier"), F.lit(94.0).alias("score"), F.lit("geo-variant match").alias("match_type"))
    more = more.union(_prefix(forms, donor_forms, key).select(*key, "donor", F.lit(1), F.lit(94.0), F.lit("geo-prefix match")))
    return first_match(more.join(first.select("query", "donor"), ["query", "donor"], "left_anti"))


def address_confidence(matches: DataFrame, index: DataFrame) -> DataFrame:
    """``matches`` with borderline ones (72 to 85) that share an address key of few donors with a strong one (86) lifted to 88."""
    keys = ["street", "state", "zip5"]
    few = shared_keys(index, COLOCATED)
    strong = matches.filter(F.col("score") >= STRONG).select("query", "donor").join(few, "donor").select("query", *keys).distinct()
    close = matches.filter(F.col("score").between(*BORDERLINE)).select("query", "donor").join(few, "donor")
    lifted = close.join(strong, ["query", *keys], "left_semi").select("query", "donor", F.lit(True).alias("lifted")).distinct()
    out = matches.join(lifted, ["query", "donor"], "left")
    return out.select(
        "query", "donor", F.when(F.col("lifted"), 88.0).otherwise(F.col("score")).alias("score"),
        F.when(F.col("lifted"), F.concat(F.lit("address-confirmed "), "match_type")).otherwise(F.col("match_type")).alias("match_type"),
    )


def colocated_donors(matches: DataFrame, index: DataFrame) -> DataFrame:
    """Donors not matched that share an address key of few donors with a strong match: 85, "address match"."""
    keys = ["street", "state", "zip5"]
    few = shared_keys(index, COLOCATED)
    strong = matches.filter(F.col("score") >= STRONG).select("query", "donor").join(few, "donor").select("query", *keys).distinct()
    found = strong.join(few, keys).select("query", "donor").distinct().join(matches.select("query", "donor"), ["query", "donor"], "left_anti")
    return found.select("query", "donor", F.lit(85.0).alias("score"), F.lit("address match").alias("match_type"))


def find_donors(terms: DataFrame, donors: DataFrame, groups: DataFrame, index: DataFrame, fuzzy: bool = True) -> DataFrame:
    """All matches, with what addresses add, best first."""
    matches = search_donors(terms, donors, groups, fuzzy)
    out = address_confidence(matches, index).union(colocated_donors(matches, index))
    return out.orderBy("query", F.desc("score"), "donor")
