"""Addresses: two different normal forms of streets, parts of buildings, and whether two addresses agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from donorloom.functions.cleaning import strip, words
from donorloom.functions.similarity import indel_ratio

# Street words that comparison spells out.
STREET_WORDS = {
    "ST": "STREET", "STR": "STREET", "RD": "ROAD", "DR": "DRIVE", "AVE": "AVENUE", "AV": "AVENUE", "BLVD": "BOULEVARD", "LN": "LANE",
    "CT": "COURT", "PL": "PLACE", "PKWY": "PARKWAY", "PKY": "PARKWAY", "CIR": "CIRCLE", "TER": "TERRACE", "HWY": "HIGHWAY", "WAY": "WAY",
    "N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST", "NE": "NORTHEAST", "NW": "NORTHWEST", "SE": "SOUTHEAST", "SW": "SOUTHWEST",
}
# Words that the address key cuts short.
KEY_WORDS = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN", "ROAD": "RD", "SUITE": "STE", "FLOOR": "FL", "APARTMENT": "APT",
}
# What stands before the number of a part of a building.
SECONDARY = r"(?iU)\b(SUITE|STE|OFFICE|OFC|APT|APARTMENT|FLOOR|FL|BLDG|BUILDING|UNIT|RM|ROOM|#)\s*\.?\s*(\w+)"

# Ratios that cities and streets of one place reach.
CITY_RATIO, STREET_RATIO = 80, 75


def normalize_street(street: Column) -> Column:
    """Street without parts of buildings, its words spelled out; '' for null, blank, nan and None."""
    s = strip(F.coalesce(street, F.lit("")))
    base = F.regexp_replace(F.regexp_replace(F.upper(s), SECONDARY, ""), r"[.,#\-/]", " ")
    known = F.create_map(*(F.lit(x) for pair in STREET_WORDS.items() for x in pair))
    full = F.array_join(F.transform(words(base), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")
    return F.when(s.isin("", "nan", "None"), F.lit("")).otherwise(full)


def extract_secondary(street: Column) -> Column:
    """Number of the first part of a building that a street names; null if it names none."""
    found = F.regexp_extract(F.upper(F.coalesce(street, F.lit(""))), SECONDARY, 2)
    return F.when(found != "", found)


def _plain(c: Column) -> Column:
    return strip(F.upper(F.coalesce(c, F.lit(""))))


def address_form(a: Column) -> Column:
    """What a struct (street, city, state) is compared by: its street spelled out, part of a building, city and state."""
    city = F.replace(_plain(a["city"]), F.lit("-"), F.lit(" "))
    return F.struct(normalize_street(a["street"]).alias("street"), extract_secondary(a["street"]).alias("part"), city.alias("city"), _plain(a["state"]).alias("state"))


def forms_compatible(x: Column, y: Column) -> Column:
    """Whether two address forms can be one place; null where a street is missing."""
    return (
        F.when((x["street"] == "") | (y["street"] == ""), F.lit(None).cast("boolean")).when(x["state"] != y["state"], False)
        .when((x["city"] != "") & (y["city"] != "") & (indel_ratio(x["city"], y["city"]) < CITY_RATIO), False).when(indel_ratio(x["street"], y["street"]) < STREET_RATIO, False)
        .when(x["part"].isNotNull() & y["part"].isNotNull() & (x["part"] != y["part"]), False).otherwise(True)
    )


def addresses_compatible(a: Column, b: Column) -> Column:
    """Whether two structs (street, city, state) can be one place; null where a street is missing."""
    return forms_compatible(address_form(a), address_form(b))


def key_street(street: Column) -> Column:
    """Street as the address key has it: punctuation as spaces, long words cut short."""
    # fixed values: the punctuation that the key leaves out
    s = F.regexp_replace(strip(F.upper(F.coalesce(street, F.lit("")))), r"[.\-,;:#'\"]", " ")
    for long, short in KEY_WORDS.items():
        s = F.regexp_replace(s, rf"(?U)\b{long}\b", short)
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def address_key(street: Column, state: Column, zip_code: Column) -> Column:
    """``struct(street, state, zip5)``; null without a state or with a street of 5 characters or fewer."""
    s, st = key_street(street), _plain(state)
    zip5 = F.substr(strip(F.coalesce(zip_code, F.lit(""))), F.lit(1), F.lit(5))
    return F.when((st != "") & (F.length(s) > 5), F.struct(s.alias("street"), st.alias("state"), zip5.alias("zip5")))
