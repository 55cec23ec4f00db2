"""Names of donors in comparable forms. All are column expressions; word maps are literals inside the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from donorloom.functions.cleaning import strip, words

# Business abbreviations and what they stand for; a long form goes back to its first abbreviation.
ABBREVIATIONS = {
    "ASSOC": "ASSOCIATION", "ASSN": "ASSOCIATION", "INS": "INSURANCE", "CORP": "CORPORATION", "CO": "COMPANY", "GRP": "GROUP",
    "INTL": "INTERNATIONAL", "NATL": "NATIONAL", "MGMT": "MANAGEMENT", "SVCS": "SERVICES", "SVC": "SERVICE", "GOVT": "GOVERNMENT",
    "ADMIN": "ADMINISTRATION", "TECH": "TECHNOLOGY", "TECHS": "TECHNOLOGIES", "PHARMA": "PHARMACEUTICAL", "MFG": "MANUFACTURING",
    "CTR": "CENTER", "DEV": "DEVELOPMENT",
}
# Legal suffixes, in upper case, after white space.
LEGAL = "INC|LLC|LTD|LP|LLP|PA|PC|PLLC|CORP|CORPORATION|COMPANY|CO|INCORPORATED|LIMITED|PAC"
# States and regions that a name can be "of".
REGIONS = (
    "IOWA|OHIO|MICHIGAN|TEXAS|FLORIDA|CALIFORNIA|ILLINOIS|INDIANA|KENTUCKY|TENNESSEE|GEORGIA|VIRGINIA|NORTH CAROLINA|SOUTH CAROLINA|"
    "PENNSYLVANIA|NEW YORK|NEW JERSEY|MARYLAND|COLORADO|ARIZONA|NEVADA|WISCONSIN|MINNESOTA|MISSOURI|KANSAS|OKLAHOMA|ARKANSAS|"
    "MISSISSIPPI|ALABAMA|LOUISIANA|OREGON|WASHINGTON|UTAH|MONTANA|NEBRASKA|IDAHO|WYOMING|MAINE|VERMONT|NEW HAMPSHIRE|CONNECTICUT|"
    "MASSACHUSETTS|RHODE ISLAND|DELAWARE|HAWAII|ALASKA|WEST VIRGINIA|NORTH DAKOTA|SOUTH DAKOTA|NEW MEXICO|AMERICA|THE UNITED STATES"
)
# Suffixes that an acronym leaves out at the end, and words that it leaves out anywhere.
ACRONYM_SUFFIXES = "INC LLC LTD CO CORP CORPORATION LP LLP PA PC PLLC".split()
ACRONYM_FILLERS = "THE OF AND FOR A AN".split()


def _mapped(name: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.array_join(F.transform(words(name), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def _normalized(name: Column, ampersand: str, initials: bool) -> Column:
    # fixed values: what is taken off a name, in this order
    s = strip(F.upper(name))
    s = F.regexp_replace(s, r"(?U)\s*\([^)]*\)", "")
    s = F.regexp_replace(s, r"(?U)\s*[-–]?\s*IN[\s-]*KIND\b", "")
    s = F.regexp_replace(s, r"N/A$", "")
    s = F.regexp_replace(s, "'", "")
    s = F.regexp_replace(s, "&", ampersand)
    s = F.regexp_replace(s, "/", " ")
    if initials:
        s = F.regexp_replace(s, r"(?U)\b([A-Z])\.([A-Z])\.?", "$1$2")
    s = F.regexp_replace(s, r'[.\-,;:"]', " ")
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def normalize_donor(name: Column) -> Column:
    """Upper case without parentheses, in-kind marks and punctuation; & as AND, initials closed up."""
    return _normalized(name, " AND ", True)


def normalize_donor_no_amp(name: Column) -> Column:
    """The same with & as a space and initials apart."""
    return _normalized(name, " ", False)


def expand_abbrevs(name: Column) -> Column:
    return _mapped(name, ABBREVIATIONS)


def contract_abbrevs(name: Column) -> Column:
    back: dict[str, str] = {}
    for short, long in ABBREVIATIONS.items():
        back.setdefault(long, short)
    return _mapped(name, back)


def strip_legal(name: Column) -> Column:
    """All legal suffixes off the end; a name that is one alone stays."""
    return strip(F.regexp_replace(name, rf"(?U)(\s+({LEGAL}))+\s*$", ""))


def strip_geo(name: Column) -> Column:
    return strip(F.regexp_replace(name, rf"(?iU)\s+OF\s+({REGIONS})\b", ""))


def no_the(name: Column) -> Column:
    return F.regexp_replace(name, "^THE ", "")


def canonical_name(name: Column) -> Column:
    """The form that names of one donor share: expanded, without suffixes and THE; the plain form if that is empty."""
    plain = normalize_donor(name)
    full = no_the(strip_legal(expand_abbrevs(plain)))
    return F.when(full == "", plain).otherwise(full)


def name_variants(name: Column) -> Column:
    """Up to 24 forms of a name for exact matching, none empty; without the forms of alias groups, see ``operators.aliases``."""
    forms: list[Column] = []
    for base in (normalize_donor(name), normalize_donor_no_amp(name)):
        long, short = expand_abbrevs(base), contract_abbrevs(base)
        forms += [base, strip_legal(base), long, short, strip_legal(long), strip_legal(short)]
    found = F.array(*forms)
    return F.array_remove(F.array_distinct(F.concat(found, F.transform(found, no_the))), "")


def stripped_forms(name: Column) -> Column:
    """The three forms that fuzzy matching compares."""
    plain = normalize_donor(name)
    return F.array(strip_legal(plain), strip_legal(expand_abbrevs(plain)), strip_legal(normalize_donor_no_amp(name)))


def alias_candidates(name: Column) -> Column:
    """Forms looked up in the alias table, in order of preference."""
    plain = normalize_donor(name)
    return F.array(canonical_name(name), no_the(strip_legal(plain)), no_the(strip_legal(contract_abbrevs(plain))), plain, strip_legal(plain))


def search_names(term: Column) -> Column:
    """A search term, its parts in parentheses, itself without them, and its parts around " / ", in that order, each once."""
    # fixed values: how the parts of a term are told, and their least length
    whole = strip(term)
    inner = F.transform(F.regexp_extract_all(term, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda p: strip(p))

    def bare(x: Column) -> Column:
        return strip(F.regexp_replace(x, r"(?U)\s*\([^)]*\)", ""))

    base = F.filter(F.array(bare(term)), lambda b: (b != "") & (b != whole))
    split = F.when(term.contains(" / "), F.transform(F.split(term, " / "), bare)).otherwise(F.array().cast("array<string>"))
    longer = [F.filter(x, lambda p: F.length(p) > 2) for x in (inner, split)]
    return F.array_distinct(F.concat(F.array(whole), longer[0], base, longer[1]))


def acronym(name: Column) -> Column:
    """First letters of a name's words of substance, two words at least; otherwise empty."""
    letters = F.regexp_replace(F.upper(name), r"(?U)[^A-Z0-9\s]", "")
    bare = F.regexp_replace(F.concat(F.lit(" "), letters), rf"(?U)(\s+({'|'.join(ACRONYM_SUFFIXES)}))+\s*$", "")
    kept = F.filter(words(bare), lambda w: ~w.isin(*ACRONYM_FILLERS))
    return F.when(F.size(kept) >= 2, F.array_join(F.transform(kept, lambda w: F.substr(w, F.lit(1), F.lit(1))), "")).otherwise("")


def split_terms(batch: Column) -> Column:
    """Search terms of a batch, parted by semicolons, none empty."""
    return F.filter(F.transform(F.split(batch, ";"), lambda t: strip(t)), lambda t: t != "")
