"""Columns of raw filings as clean values: numbers, dates, classes of donors, first and last names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDIVIDUAL, ORGANIZATION = "Individual", "Non-Individual"

# Words that stand for a missing employer or occupation.
NULLISH = (
    "", "NA", "N/A", "N A", "N.A.", "N.A", "NONE", "NULL", "NAN", "N/A.", "NOT APPLICABLE", "NOT EMPLOYED", "UNEMPLOYED",
    "INFORMATION REQUESTED", "REQUESTED", "NA NA", "NONE NONE", "N/A N/A",
)
# Legal suffixes that end an organization's name.
LEGAL_SUFFIX = r"(?i)\b(INC|INCORPORATED|LLC|L\.?L\.?C|LLP|LP|LTD|LIMITED|CORP|CORPORATION|COMPANY|CO|PLLC|PA|PC|PAC|GMBH|NA)\.?\s*$"
# Words that mark an organization anywhere in a name.
ORG_WORDS = (
    "INCORPORATED CORPORATION CORP COMPANY COMPANIES ASSOCIATION ASSOC ASSN COMMITTEE CMTE UNION COUNCIL COALITION FEDERATION "
    "ALLIANCE LEAGUE SOCIETY FOUNDATION INSTITUTE PARTNERS PARTNERSHIP PARTNERSHIPS HOLDINGS HOLDING ENTERPRISES ENTERPRISE "
    "INDUSTRIES INDUSTRY SERVICES SYSTEMS SOLUTIONS TECHNOLOGIES TECHNOLOGY BANCORP BANK BANKERS INSURANCE FINANCIAL FINANCE "
    "PHARMACEUTICALS PHARMACEUTICAL PHARMA HEALTHCARE HOSPITAL MEDICAL AIRLINES COMMUNICATIONS FUND FUNDS ACCOUNT GROUP CAPITAL "
    "REALTY PROPERTIES MOTORS FOODS ENERGY BREWING TOBACCO MANAGEMENT CONSULTING STRATEGIES COUNCILS ASSOCIATES MUTUAL PETROLEUM "
    "RESOURCES AIRWAYS RAILROAD RAILWAY BEVERAGE BEVERAGES AUTOMOTIVE PAC POLITICAL DEMOCRATIC DEMOCRATS REPUBLICAN REPUBLICANS "
    "CITIZENS AMERICANS FRIENDS PROGRESS ACTION COMMITTEES TRIBE NATION GAMING CASINO RESORTS AGENCY AUTHORITY DISTRICT MUNICIPAL "
    "COOPERATIVE CO-OP GROWERS FARMERS PRODUCERS MANUFACTURING MANUFACTURERS DISTRIBUTORS DISTRIBUTING TRUST TRUSTS VENTURES GLOBAL "
    "WORLDWIDE NATIONAL INTERNATIONAL AMERICA USA LABORERS TEAMSTERS WORKERS EMPLOYEES GUILD BUREAU CHAMBER DEALERS DEALER"
).split()
# Titles and suffixes of persons (dots at their ends do not count), and legal tokens after a comma.
PERSON_TOKENS = "JR SR II III IV V MD M.D DDS DMD PHD PH.D ESQ CPA RN DO JD MR MRS MS DR MISS".split()
TITLES = "MR MRS MS DR MISS".split()
SUFFIXES = "JR SR II III IV V MD M.D DDS PHD ESQ CPA RN DO JD".split()
COMMA_LEGAL = "LLC INC LP LLP PAC CO CORP PA PC LTD".split()


#: White space, in all of Unicode.
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column, chars: str = _SPACE) -> Column:
    """White space (or other ``chars``) off both ends."""
    return F.btrim(c, F.lit(chars))


def words(c: Column) -> Column:
    """Pieces between white space, none of them empty."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def norm_ein(c: Column) -> Column:
    """Digits of an employer number, padded with zeros to 9; longer ones stay whole, null has nine zeros."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.when(F.length(digits) < 9, F.lpad(digits, 9, "0")).otherwise(digits)


_DIGITS = "[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^\s*[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?\s*$"


def parse_amount(c: Column) -> Column:
    """A plain decimal number as double, single underscores between digits left out; anything else, null and blank is 0."""
    return F.when(c.rlike(_NUMBER), F.coalesce(F.replace(strip(c), F.lit("_"), F.lit("")).try_cast("double"), F.lit(0.0))).otherwise(0.0)


def parse_dollar(c: Column) -> Column:
    """Dollars such as ``$1,200`` or ``(50)`` as an absolute amount; anything else is 0."""
    bare = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[$,]", ""))
    return F.abs(parse_amount(F.regexp_replace(bare, r"^\((.*)\)$", "-$1")))


def filing_day(date: Column, period_end: Column) -> Column:
    """The first of the two that is eight digits, as text; null if neither is."""
    own, end = strip(F.coalesce(date, F.lit(""))), strip(F.coalesce(period_end, F.lit("")))
    return F.when(own.rlike("^[0-9]{8}$"), own).when(end.rlike("^[0-9]{8}$"), end)


def parse_filing_date(date: Column, period_end: Column) -> Column:
    """Timestamp of ``filing_day``; null for a day that the calendar lacks, whatever the period's end."""
    return day_timestamp(filing_day(date, period_end))


def day_timestamp(day: Column) -> Column:
    """Timestamp of an eight-digit day; null for one that the calendar lacks."""
    return F.try_to_timestamp(day, F.lit("yyyyMMdd"))


def insert_key(c: Column) -> Column:
    """Digits of a time of insertion, the first 14, padded with zeros on the right, as a number; none: 0."""
    digits = F.substr(F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", ""), F.lit(1), F.lit(14))
    return F.rpad(digits, 14, "0").cast("bigint")


def day_number(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("bigint")


def clean_text(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def _nullish(clean: Column) -> Column:
    s = F.regexp_replace(strip(F.upper(clean), " ."), r"(?U)\s+", " ")
    return s.isin(*NULLISH) | (F.length(s) < 2)


def is_nullish(c: Column) -> Column:
    """Whether a text says that there is no employer or occupation, or is shorter than 2."""
    return _nullish(clean_text(c))


def blank_nullish(c: Column) -> Column:
    return F.when(is_nullish(c), F.lit("")).otherwise(clean_text(c))


def _org_word(upper: Column) -> Column:
    # fixed values: what parts the tokens of a name
    tokens = F.split(upper, r"[^A-Z0-9&\-]+")
    return upper.rlike(LEGAL_SUFFIX) | F.arrays_overlap(tokens, F.array(*map(F.lit, ORG_WORDS)))


def has_org_word(name: Column) -> Column:
    """Whether a name ends with a legal suffix or has a word that only organizations have."""
    return _org_word(F.upper(clean_text(name)))


def _personal(clean: Column, upper: Column) -> Column:
    # fixed values: what parts the tokens of a name, and what a plain word is made of
    tokens = words(F.regexp_replace(upper, r"[^A-Z0-9.& ]", " "))
    last, first = strip(F.try_element_at(tokens, F.lit(-1)), "."), strip(F.try_element_at(tokens, F.lit(1)), ".")
    after = words(F.when(clean.contains(","), F.substr(clean, F.instr(clean, ",") + 1)))
    plain = F.forall(after, lambda w: w.rlike(r"^[A-Za-z.\-']+$"))
    legal = F.exists(after, lambda w: strip(F.upper(w), ".").isin(*COMMA_LEGAL))
    comma = F.size(after).between(1, 3) & plain & ~legal
    return F.coalesce(last.isin(*PERSON_TOKENS), F.lit(False)) | F.coalesce(first.isin(*TITLES), F.lit(False)) | F.coalesce(comma, F.lit(False))


def looks_personal(name: Column) -> Column:
    """LAST, FIRST with one to three plain words after the first comma, or a title or suffix of persons."""
    return _personal(clean_text(name), F.upper(clean_text(name)))


def classify_donor(name: Column, employer: Column, occupation: Column) -> Column:
    """Individual or Non-Individual: the first signal of name, occupation, employer and form of name decides."""
    return _class(has_org_word(name), is_nullish(employer), is_nullish(occupation), looks_personal(name))


def _class(org_word: Column, no_employer: Column, no_occupation: Column, personal: Column) -> Column:
    return F.when(org_word, ORGANIZATION).when(~no_occupation, INDIVIDUAL).when(~no_employer, INDIVIDUAL).when(personal, INDIVIDUAL).otherwise(ORGANIZATION)


def with_donor_columns(df: DataFrame, name: str = "contributor_name", employer: str = "employer", occupation: str = "occupation") -> DataFrame:
    """``df`` with ``donor_type``, ``first`` and ``last``, and employer and occupation cleaned in place. Each cleaned text is made
    once, in a projection of its own, as the rules look at it many times."""
    df = df.withColumns({"_n": clean_text(F.col(name)), "_e": clean_text(F.col(employer)), "_o": clean_text(F.col(occupation))})
    df = df.withColumns({"_u": F.upper("_n"), "_no_e": _nullish(F.col("_e")), "_no_o": _nullish(F.col("_o"))})
    df = df.withColumn("donor_type", _class(_org_word(F.col("_u")), F.col("_no_e"), F.col("_no_o"), _personal(F.col("_n"), F.col("_u"))))
    df = df.withColumn("_person", F.when(F.col("donor_type") == INDIVIDUAL, _split_clean(F.col("_n"))))
    blank = {employer: F.when(F.col("_no_e"), F.lit("")).otherwise(F.col("_e")), occupation: F.when(F.col("_no_o"), F.lit("")).otherwise(F.col("_o"))}
    names = {part: F.coalesce(F.col("_person")[part], F.lit("")) for part in ("first", "last")}
    return df.withColumns(blank | names).drop("_n", "_e", "_o", "_u", "_no_e", "_no_o", "_person")


def _split_clean(n: Column) -> Column:
    rest = strip(F.substr(n, F.instr(n, ",") + 1))
    comma_first = strip(F.substring_index(rest, " ", 1), " .")
    comma_last = strip(F.substring_index(n, ",", 1), " .")
    parts = F.filter(words(n), lambda w: ~strip(F.upper(w), ".").isin(*SUFFIXES))

    def of(parts: Column) -> Column:
        head, tail = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
        one, more = F.size(parts) == 1, F.size(parts) > 1
        first = F.when(one, head).when(more, strip(head, " ."))
        return F.struct(F.coalesce(first, F.lit("")).alias("first"), F.coalesce(F.when(more, strip(tail, " .")), F.lit("")).alias("last"))

    return F.when(n.contains(","), F.struct(comma_first.alias("first"), comma_last.alias("last"))).otherwise(F.element_at(F.transform(F.array(parts), of), 1))


def split_person_name(name: Column, donor_type: Column) -> Column:
    """``struct(first, last)`` of a person's name; both empty for an organization."""
    found = _split_clean(clean_text(name))
    return F.when(donor_type == INDIVIDUAL, found).otherwise(F.struct(F.lit("").alias("first"), F.lit("").alias("last")))
