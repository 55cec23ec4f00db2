"""Queries of the library over the test tables, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorloom.functions import address as A
from donorloom.functions import cleaning as C
from donorloom.functions import names as N
from donorloom.functions.similarity import indel_ratio, partial_ratio
from donorloom.jobs import oracles as O
from donorloom.jobs import views as V
from donorloom.operators import addresses, aliases, clusters, compare, components, filters, reconcile, reports, rollup, search, supersession
from donorloom.operators.shared import materialize, shared_dir
from donorloom.sources import filings, sinks
from donorloom.sources.filings import registry

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

#: The comparison: two recipients, one year, clusters by canonical name alone.
A_SIDE, B_SIDE, YEAR = ["Org 0"], ["Org 1"], 1998
_GROUPS = ((0, "small ring"), (0, "small bolt Holdings"), (1, "The red gear Corp"), (1, "hot rod"))
_TERMS = ("small ring Inc.", "The old anvil Corp (hot plate)", "red gear / blue gear", "LWA", "cold widgit", "new rod of Ohio")


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _cents(column: str = "amount") -> str:
    return f"round(sum({column}), 2)"


# Reading and cleaning


@_query(O.query("SELECT recipient_ein, CAST(count(*) AS BIGINT) AS n FROM contributions_src WHERE recipient_ein IN (SELECT ein FROM parents UNION SELECT ein FROM affiliated) GROUP BY recipient_ein"))
def p1_p2_u5_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each target by normalized EIN."""
    src = V.contributions_src(spark, sf_dir).withColumn("recipient_ein", F.concat(F.substr("recipient_ein", F.lit(1), F.lit(2)), F.lit("-"), F.substr("recipient_ein", F.lit(3))))
    return rollup.filter_targets(src, V.parents(spark), V.affiliated(spark)).groupBy("recipient_ein").agg(F.count("*").alias("n"))


@_query(O.query("""SELECT filing_day, strftime("date", '%Y-%m-%d') AS day, """ + _cents() + """ AS total, count(*) AS n FROM matched GROUP BY ALL"""))
def p3_p4_amounts_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed amounts by parsed date."""
    return V.matched(spark, sf_dir).groupBy("filing_day", F.date_format("date", "yyyy-MM-dd").alias("day")).agg(reports.money().alias("total"), F.count("*").alias("n"))


@_query(O.query(f"""SELECT DISTINCT contributor_name, employer, occupation, donor_type, {O.org_word('contributor_name')} AS org_word, {O.nullish('employer')} AS no_employer,
    {O.nullish('occupation')} AS no_occupation, {O.personal('contributor_name')} AS personal, clean_employer, clean_occupation FROM kinds"""))
def p5_p6_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every distinct donor, employer and occupation, with the signals that decide it."""
    rows = V.contributions_src(spark, sf_dir).select("contributor_name", "employer", "occupation").distinct()
    n, e, o = F.col("contributor_name"), F.col("employer"), F.col("occupation")
    return rows.withColumns({
        "donor_type": C.classify_donor(n, e, o), "org_word": C.has_org_word(n), "no_employer": C.is_nullish(e), "no_occupation": C.is_nullish(o),
        "personal": C.looks_personal(n), "clean_employer": C.blank_nullish(e), "clean_occupation": C.blank_nullish(o),
    })


@_query(O.query('SELECT DISTINCT donor, donor_type, "first", "last", is_company FROM matched'))
def p7_p8_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last names of persons, and the company flag."""
    return V.matched(spark, sf_dir).select("donor", "donor_type", "first", "last", "is_company").distinct()


# The build


@_query(O.query("SELECT recipient, recipient_party, recipient_ein, own_ein, affiliated_from, count(*) AS n FROM matched GROUP BY ALL"))
def j1_j2_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each parent and affiliate after the roll-up."""
    return V.matched(spark, sf_dir).groupBy("recipient", "recipient_party", "recipient_ein", "own_ein", "affiliated_from").agg(F.count("*").alias("n"))


@_query(O.query("SELECT form_id, insert_key, count(*) AS n FROM matched JOIN form_registry USING (form_id) GROUP BY ALL"))
def s2_j3_f10_insert_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each form with the form's insert key."""
    src = V.contributions_src(spark, sf_dir)
    keyed = supersession.attach_insert_keys(V.matched(spark, sf_dir), registry(V.registry_src(src)))
    return keyed.groupBy("form_id", "insert_key").agg(F.count("*").alias("n"))


@_query(O.query("""SELECT own_ein, form_id, filing_day, CAST(winner AS BIGINT) AS winner, winner IS NOT NULL AND winner <> CAST(form_id AS BIGINT) AS superseded, count(*) AS n
    FROM matched m LEFT JOIN winners w ON w.ein = m.own_ein AND w.day = CAST(filing_day AS BIGINT) GROUP BY ALL"""))
def j4_f11_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each filing and day, the winning filing of the day, and whether they are superseded."""
    rows = V.matched(spark, sf_dir)
    days = supersession.calendar(rows, "own_ein")
    marked = supersession.mark_superseded(rows, registry(V.registry_src(days)), ein="own_ein", days=days)
    return marked.groupBy("own_ein", "form_id", "filing_day", "winner", "superseded").agg(F.count("*").alias("n"))


@_query(O.query("""SELECT donor, "last", "first", is_company, donor_type, employer, occupation, street, city, state, zip_code, amount, strftime("date", '%Y-%m-%d') AS day, recipient, recipient_party, recipient_ein, affiliated_from FROM kept"""))
def s6_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean table, every row."""
    rows = V.contributions(spark, sf_dir, dictionary=True)
    return rows.withColumn("day", F.date_format("date", "yyyy-MM-dd")).drop("date")


@_query(O.query('SELECT recipient, recipient_party, recipient_ein, CAST(year("date") AS INTEGER) AS "year", ' + _cents() + " AS total_amount, count(*) AS transactions FROM kept GROUP BY ALL"))
def a1_recipient_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by recipient and year, without superseded filings."""
    return reports.recipient_summary(V.contributions(spark, sf_dir))


@_query(O.query("""SELECT 'rows' AS section, 'scanned' AS item, count(*) AS n FROM contributions_src UNION ALL SELECT 'rows', 'matched', count(*) FROM matched
    UNION ALL SELECT 'rows', 'kept', count(*) FROM kept UNION ALL SELECT 'rows', 'removed', (SELECT count(*) FROM matched) - (SELECT count(*) FROM kept)
    UNION ALL SELECT 'class', donor_type, count(*) FROM matched GROUP BY donor_type
    UNION ALL SELECT 'affiliate', own_ein || ' -> ' || recipient_ein, count(*) FROM matched WHERE own_ein <> recipient_ein GROUP BY ALL
    UNION ALL SELECT 'parent year', recipient_ein || ' ' || coalesce(substr(filing_day, 1, 4), '?'), count(*) FROM matched GROUP BY ALL"""))
def a12_build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the build."""
    narrow = ("donor_type", "own_ein", "recipient_ein", "filing_day", "form_id", "period_begin", "period_end", "date")
    matched = materialize(V.matched(spark, sf_dir, dictionary=True).select(*narrow), "matched")
    return reports.build_report(V.contributions_src(spark, sf_dir), matched, V.kept_of(matched))


# Search and reports

_SEARCH = filters.Search(start="1996-03-01", end="1998-11-30", donor_types=["Non-Individual"], states=["S1", "S3", "S7"], parties=["Democrats"], city="ity", least=1000, most=50000)
_SEARCHED = """kept WHERE "date" BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-11-30' AND donor_type = 'Non-Individual' AND state IN ('S1', 'S3', 'S7') AND recipient_party = 'Democrats'
    AND contains(upper(city), 'ITY') AND amount >= 1000 AND amount <= 50000"""
_COLUMNS = 'donor, "last", "first", is_company, donor_type, employer, occupation, street, city, state, zip_code, amount, recipient, recipient_party, recipient_ein, affiliated_from'


@_query(O.query(f"""SELECT DISTINCT {_COLUMNS}, strftime("date", '%Y-%m-%d') AS day FROM {_SEARCHED}"""))
def p9_p14_a10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by dates, types, states, party, city and amount, equal rows once."""
    rows = filters.search_contributions(V.contributions(spark, sf_dir), _SEARCH)
    return rows.withColumn("day", F.date_format("date", "yyyy-MM-dd")).drop("date")


@_query(O.query(f"""SELECT DISTINCT {_COLUMNS}, strftime("date", '%Y-%m-%d') AS day FROM {_SEARCHED} AND donor IN (SELECT donor FROM matched WHERE length(donor) % 2 = 0)"""))
def s6_p9_stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search of chosen donors, of the clean table as it is stored: by folders of years and files of donors."""
    path = _path(spark, "laid-out")
    rows = V.contributions(spark, sf_dir, dictionary=True)
    sinks.write_contributions(rows, path)
    chosen = V.matched(spark, sf_dir).filter(F.length("donor") % 2 == 0).select("donor")
    found = filters.search_table(spark, path, _SEARCH, chosen)
    return found.withColumn("day", F.date_format("date", "yyyy-MM-dd")).drop("date")


@_query(O.query(f"""SELECT DISTINCT {_COLUMNS}, strftime("date", '%Y-%m-%d') AS day FROM kept WHERE employer = 'Acme' AND regexp_matches(upper(occupation), 'RET.*D') AND donor IN (SELECT donor FROM matched WHERE contains(donor, 'Ann'))"""))
def p11_p12_donor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by chosen donors, employer and occupation."""
    rows = V.contributions(spark, sf_dir)
    chosen = V.matched(spark, sf_dir).filter(F.col("donor").contains("Ann")).select("donor")
    found = filters.search_contributions(rows, filters.Search(employer="ACME", occupation="ret.*d", regex=True), chosen)
    return found.withColumn("day", F.date_format("date", "yyyy-MM-dd")).drop("date")


_ITEM = ", ".join(f'{"strftime(" + chr(34) + "date" + chr(34) + ", " + chr(39) + "%m/%d/%Y" + chr(39) + ")" if c == "date" else c} AS "{h}"' for c, h in reports.HEADINGS.items())
_ORDER = ", ".join(f'"{h}" NULLS LAST' for h in ("Donor", "Date", *(h for h in reports.HEADINGS.values() if h not in ("Donor", "Date"))))


@_query(O.query(f"SELECT {_ITEM} FROM kept WHERE donor_type = 'Non-Individual' ORDER BY {_ORDER} LIMIT 5000"))
def p15_p16_t1_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5000 line items of organizations, as they are shown."""
    return reports.line_items(filters.split_by_type(V.contributions(spark, sf_dir))[1])


@_query(O.query("SELECT coalesce(" + _cents() + ", 0) AS total_amount, count(DISTINCT donor) AS donors, count(*) AS n_rows FROM kept"))
def a5_result_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount, donors and rows."""
    return reports.result_metrics(V.contributions(spark, sf_dir))


@_query(O.query("SELECT donor_type, coalesce(" + _cents() + ", 0) AS total_amount, count(DISTINCT donor) AS donors, count(*) AS n_rows FROM kept GROUP BY donor_type"))
def a6_metrics_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by type of donor."""
    return reports.result_metrics(V.contributions(spark, sf_dir), "donor_type")


@_query(O.query("SELECT recipient_party, recipient, " + _cents() + " AS total_amount, count(*) AS transactions, count(*) OVER (PARTITION BY recipient_party) AS party_recipients FROM kept GROUP BY recipient_party, recipient"))
def a7_t3_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of recipients within their party."""
    return reports.recipient_breakdown(V.contributions(spark, sf_dir))


@_query(O.query("SELECT DISTINCT donor FROM kept"))
def a9_t5_distinct_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors by name."""
    return reports.distinct_donors(V.contributions(spark, sf_dir))


@_query(O.query("""SELECT count(*) AS n_rows, count(DISTINCT recipient) AS recipients, strftime(min("date"), '%Y-%m-%d') AS first_date, strftime(max("date"), '%Y-%m-%d') AS last_date,
    count(*) FILTER (WHERE donor_type = 'Individual') AS individual_rows, count(*) FILTER (WHERE donor_type = 'Non-Individual') AS organization_rows FROM kept"""))
def a11_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and span of the table."""
    out = reports.database_profile(V.contributions(spark, sf_dir))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_date", "last_date")})


# Names and addresses


@_query(O.query(f"""SELECT donor, {O.normalized('donor')} AS plain, {O.normalized('donor', ' ', False)} AS no_amp, {O.expanded(O.normalized('donor'))} AS expanded, {O.contracted(O.normalized('donor'))} AS contracted,
    {O.no_legal(O.normalized('donor'))} AS no_legal, {O.canonical('donor')} AS canonical FROM (SELECT DISTINCT donor FROM matched)"""))
def f1_f3_f9_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of donors' names."""
    d = F.col("donor")
    plain = N.normalize_donor(d)
    return V.matched(spark, sf_dir).select("donor").distinct().withColumns({
        "plain": plain, "no_amp": N.normalize_donor_no_amp(d), "expanded": N.expand_abbrevs(plain), "contracted": N.contract_abbrevs(plain), "no_legal": N.strip_legal(plain), "canonical": N.canonical_name(d),
    })


@_query(O.query(f"SELECT donor, unnest({O.variants('donor')}) AS variant FROM (SELECT DISTINCT donor FROM matched)"))
def f4_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of donors' names."""
    return V.matched(spark, sf_dir).select("donor").distinct().select("donor", F.explode(N.name_variants(F.col("donor"))).alias("variant"))


def _groups(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{n}')" for i, n in _GROUPS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(group_id, name)")


_ALIAS = f"""alias_groups AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in _GROUPS)}) t(group_id, name)),
forms AS (SELECT group_id, unnest({O.variants('name')}) AS form FROM alias_groups),
lookup AS (SELECT form, max(group_id) AS group_id FROM forms GROUP BY form),
donor_forms AS (SELECT donor, unnest({O.variants('donor')}) AS variant FROM (SELECT DISTINCT donor FROM matched)),
widened AS (SELECT * FROM donor_forms UNION SELECT donor, f.form FROM donor_forms d JOIN lookup l ON d.variant = l.form JOIN forms f ON f.group_id = l.group_id)"""


@_query(O.query("SELECT donor, variant FROM widened", _ALIAS))
def f4_alias_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with the forms of alias groups."""
    own = V.matched(spark, sf_dir).select("donor").distinct().select("donor", F.explode(N.name_variants(F.col("donor"))).alias("variant"))
    return aliases.with_aliases(own, _groups(spark), "donor")


@_query(O.query(f"SELECT street, {O.street('street')} AS base, {O.secondary('street')} AS part, {O.key_street('street')} AS key_street FROM (SELECT DISTINCT street FROM matched)"))
def f5_f6_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both normal forms of streets."""
    s = F.col("street")
    return V.matched(spark, sf_dir).select("street").distinct().withColumns({"base": A.normalize_street(s), "part": A.extract_secondary(s), "key_street": A.key_street(s)})


_INDEX = f"""idx AS (SELECT DISTINCT donor, {O.key_street('street')} AS street, upper(state) AS state, substr(zip_code, 1, 5) AS zip5 FROM matched WHERE is_company AND state <> '' AND length({O.key_street('street')}) > 5)"""


@_query(O.query("SELECT street, state, zip5, count(DISTINCT donor) AS donors FROM idx GROUP BY ALL", _INDEX))
def a14_address_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company donors at each address key."""
    return addresses.crowded_keys(addresses.address_index(V.matched(spark, sf_dir)))


@_query(O.query("SELECT DISTINCT upper(donor) AS donor_upper, street, city, state FROM matched"))
def a15_raw_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of donors as they were filed."""
    return clusters.raw_addresses(V.matched(spark, sf_dir))


@_query(O.query(f"SELECT id AS donor, round(ratio, 4) AS ratio FROM ratios", f"""pairs AS (SELECT donor AS id, {O.normalized('donor')} AS x, {O.canonical('donor')} AS y FROM (SELECT DISTINCT donor FROM matched)),{O.LCS}"""))
def h1_indel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each name's plain and canonical form."""
    d = F.col("donor")
    return V.matched(spark, sf_dir).select("donor").distinct().select("donor", F.round(indel_ratio(N.normalize_donor(d), N.canonical_name(d)), 4).alias("ratio"))


@_query(O.query("SELECT donor, round(ratio, 4) AS ratio FROM hpairs JOIN best USING (x, y)", f"""hpairs AS (SELECT donor, {O.normalized('donor')} AS x, {O.no_legal(O.normalized('donor'))} AS y FROM (SELECT DISTINCT donor FROM matched)),
hdistinct AS (SELECT DISTINCT x, y FROM hpairs),{O.best_windows('hdistinct', 'best')}"""))
def h2_partial_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each name's plain form to the best window of its legal one."""
    d = F.col("donor")
    return V.matched(spark, sf_dir).select("donor").distinct().select("donor", F.round(partial_ratio(N.normalize_donor(d), N.strip_legal(N.normalize_donor(d))), 4).alias("ratio"))


# Clusters

_CANON = f"""named AS (SELECT donor, {O.canonical('donor')} AS canonical FROM (SELECT DISTINCT donor FROM matched)), names AS (SELECT DISTINCT canonical FROM named)"""
_NW = "len(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
_PREFIX = f"""prefixed AS (SELECT s.canonical AS a, l.canonical AS b FROM names s JOIN names l ON starts_with(l.canonical, s.canonical) AND length(l.canonical) > length(s.canonical) AND length(s.canonical) >= 7
  WHERE ({_NW.format('s.canonical')} >= 2 AND length(s.canonical) >= 10) OR ({_NW.format('s.canonical')} = 1 AND starts_with(l.canonical, s.canonical || ' ')))"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.canonicals(V.matched(spark, sf_dir))


@_query(O.query("SELECT a, b FROM prefixed", f"{_CANON},{_PREFIX}"))
def j8_prefix_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin another."""
    return clusters.prefix_edges(_named(spark, sf_dir).select("canonical"))


_FUZZY = f"""close AS (SELECT x.canonical AS a, y.canonical AS b, CASE WHEN least(length(x.canonical), length(y.canonical)) < 20 THEN 92.0 ELSE 90.0 END AS threshold
  FROM names x JOIN names y ON substr(x.canonical, 1, 5) = substr(y.canonical, 1, 5) AND x.canonical < y.canonical
  WHERE least(length(x.canonical), length(y.canonical)) >= 15 AND {_NW.format('x.canonical')} >= 2 AND {_NW.format('y.canonical')} >= 2),
pairs AS (SELECT a || '|' || b AS id, a AS x, b AS y FROM close WHERE 200.0 * least(length(a), length(b)) / (length(a) + length(b)) >= threshold - 5),{O.LCS}"""


@_query(O.query("SELECT a, b, round(ratio, 4) AS ratio, CAST(threshold AS DOUBLE) AS threshold FROM close JOIN ratios ON id = a || '|' || b WHERE ratio >= threshold - 5", f"{_CANON},{_FUZZY}"))
def j9_fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar names that share their first five characters."""
    return clusters.fuzzy_pairs(_named(spark, sf_dir).select("canonical")).withColumn("ratio", F.round("ratio", 4))


@_query(O.query("SELECT DISTINCT donor, canonical, substr(donor, 1, 3) AS donor_group FROM named WHERE upper(donor) IN (SELECT upper(donor) FROM matched WHERE donor LIKE '%Inc.')", _CANON))
def j6_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors that a table of validated groups has; the table is derived from the names here."""
    named = _named(spark, sf_dir)
    return clusters.group_members(named, _validated(named))


_MEMBERS = f"""candidates AS (SELECT donor, canonical, unnest([canonical, {O.no_the(O.no_legal(O.normalized('donor')))}, {O.no_the(O.no_legal(O.contracted(O.normalized('donor'))))}, {O.normalized('donor')}, {O.no_legal(O.normalized('donor'))}]) AS form,
  unnest(range(5)) AS pos FROM named),
members AS (SELECT donor, canonical, arg_min(group_id, pos) AS group_id FROM candidates JOIN lookup USING (form) GROUP BY ALL)"""


@_query(O.query("SELECT donor, canonical, group_id FROM members", f"{_CANON},{_ALIAS},{_MEMBERS}"))
def j7_alias_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors of alias groups."""
    return clusters.alias_members(_named(spark, sf_dir), _groups(spark))


_EDGES = """edges AS (SELECT a, b FROM prefixed UNION SELECT a, b FROM close JOIN ratios ON id = a || '|' || b WHERE ratio >= threshold
  UNION SELECT x.canonical, y.canonical FROM members x JOIN members y ON x.group_id = y.group_id AND x.canonical <> y.canonical),
reach AS (SELECT canonical AS n, canonical AS m FROM names UNION SELECT n, CASE WHEN m = a THEN b ELSE a END FROM reach JOIN edges ON m = a OR m = b),
label AS (SELECT n, arg_min(m, (length(m), m)) AS canonical_donor FROM reach GROUP BY n)"""


@_query(O.query("SELECT donor, canonical_donor FROM named JOIN label ON canonical = n", f"{_CANON},{_PREFIX},{_FUZZY},{_ALIAS},{_MEMBERS},{_EDGES}"))
def j18_a13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors and their clusters by canonical names, alias groups, prefixes and similarity."""
    return clusters.cluster_donors(V.matched(spark, sf_dir).select("donor"), groups=_groups(spark))


@_query(O.query("SELECT donor, canonical_donor FROM named JOIN label ON canonical = n", f"{_CANON},{_PREFIX},{_FUZZY},{_ALIAS},{_MEMBERS},{_EDGES}"))
def j18_grown_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters, grown from three batches of links that arrive one after the other."""
    named = materialize(_named(spark, sf_dir), "canonicals")
    links = materialize(clusters.donor_links(named, groups=_groups(spark)), "links")
    batch = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), F.lit(3))
    grown = components.connected_components(links.filter(batch == 0))
    for i in (1, 2):
        grown = materialize(components.grow_components(grown, links.filter(batch == i)), "grown")
    return clusters.label_donors(named, grown)


_PLACES = f"""places AS (SELECT DISTINCT canonical, upper(state) AS st, upper(city) AS town, {O.street('street')} AS base, {O.secondary('street')} AS part
  FROM named JOIN (SELECT DISTINCT upper(donor) AS u, street, city, state FROM matched WHERE trim(street) <> '') ON upper(donor) = u),
bases AS (SELECT DISTINCT p.base AS x, q.base AS y FROM (SELECT DISTINCT base FROM places) p CROSS JOIN (SELECT DISTINCT base FROM places) q),{O.subsequences('bases', 'street_ratios')},
towns AS (SELECT DISTINCT p.town AS x, q.town AS y FROM (SELECT DISTINCT town FROM places) p CROSS JOIN (SELECT DISTINCT town FROM places) q),{O.subsequences('towns', 'town_ratios')},
same_place AS (SELECT p.canonical AS a, q.canonical AS b FROM places p JOIN places q ON p.st = q.st JOIN street_ratios s ON s.x = p.base AND s.y = q.base JOIN town_ratios t ON t.x = p.town AND t.y = q.town
  WHERE p.base <> '' AND q.base <> '' AND s.ratio >= 75 AND t.ratio >= 80 AND coalesce(p.part = q.part, true)
    AND (p.canonical, q.canonical) IN (SELECT (a, b) FROM close))"""


@_query(O.query("SELECT DISTINCT a, b FROM close JOIN ratios ON id = a || '|' || b JOIN same_place USING (a, b) WHERE ratio >= threshold - 5", f"{_CANON},{_FUZZY},{_PLACES}"))
def j10_address_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar names joined because addresses agree; every similar pair is taken for borderline here."""
    at = materialize(V.matched(spark, sf_dir).select("donor", "street", "city", "state").distinct(), "addresses")  # all rows are read once
    named = materialize(clusters.canonicals(at), "canonicals")
    pairs = clusters.fuzzy_pairs(named.select("canonical")).withColumn("threshold", F.lit(101.0))
    return clusters.address_edges(pairs, named, clusters.raw_addresses(at))


# Comparison


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.contributions(spark, sf_dir).filter(filters.within_dates(f"{YEAR}-01-01", f"{YEAR}-12-31"))
    rows = materialize(rows, "year")
    named = materialize(clusters.canonicals(rows).select("donor", F.col("canonical").alias("canonical_donor")), "named")
    return compare.attach_clusters(rows, named)


_COMPARED = f"""{_CANON}, compared AS (SELECT k.*, canonical AS canonical_donor FROM kept k JOIN named USING (donor) WHERE "date" BETWEEN TIMESTAMP '{YEAR}-01-01' AND TIMESTAMP '{YEAR}-12-31'),
gave AS (SELECT canonical_donor, {_cents()} AS total FROM compared WHERE recipient = 'Org 0' GROUP BY 1 HAVING {_cents()} >= 100000),
excluded AS (SELECT canonical_donor FROM compared WHERE recipient = 'Org 1' GROUP BY 1 HAVING {_cents()} > 250000)"""


@_query(O.query("SELECT canonical_donor, total FROM gave", _COMPARED))
def j5_a2_group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that gave 100,000 or more to side A."""
    return compare.group_totals(_compared(spark, sf_dir), A_SIDE, least=100000)


@_query(O.query("SELECT canonical_donor FROM gave WHERE canonical_donor NOT IN (SELECT canonical_donor FROM excluded)", _COMPARED))
def j13_u1_qualifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without those that gave over 250,000 to side B."""
    return compare.qualifying(_compared(spark, sf_dir), A_SIDE, B_SIDE, 100000, 250000)


@_query(O.query("""SELECT canonical_donor, donor AS display_name, n FROM (SELECT canonical_donor, donor, count(*) AS n, row_number() OVER (PARTITION BY canonical_donor ORDER BY count(*) DESC, donor) AS place FROM compared GROUP BY 1, 2) WHERE place = 1""", _COMPARED))
def a3_w1_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent name of each cluster."""
    return compare.display_names(_compared(spark, sf_dir))


@_query(O.query("""SELECT canonical_donor, coalesce(round(sum(amount) FILTER (WHERE recipient = 'Org 0'), 2), 0) AS "Org 0", coalesce(round(sum(amount) FILTER (WHERE recipient = 'Org 1'), 2), 0) AS "Org 1",
    round(coalesce(round(sum(amount) FILTER (WHERE recipient = 'Org 0'), 2), 0) + coalesce(round(sum(amount) FILTER (WHERE recipient = 'Org 1'), 2), 0), 2) AS total FROM compared WHERE recipient IN ('Org 0', 'Org 1') GROUP BY canonical_donor""", _COMPARED))
def a4_t2_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cluster gave to both sides."""
    return compare.donor_recipient_matrix(_compared(spark, sf_dir), A_SIDE + B_SIDE)


@_query(O.query(f"""SELECT {_COLUMNS}, strftime("date", '%Y-%m-%d') AS day FROM compared WHERE recipient IN ('Org 0', 'Org 1') AND canonical_donor IN (SELECT canonical_donor FROM gave) AND canonical_donor NOT IN (SELECT canonical_donor FROM excluded)""", _COMPARED))
def j14_u2_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of the qualifying clusters."""
    items = compare.compare(_compared(spark, sf_dir), A_SIDE, B_SIDE, 100000, 250000)["line_items"]
    return items.withColumn("day", F.date_format("date", "yyyy-MM-dd")).drop("date", "canonical_donor")


# Reconciliation


def _qc_parts(spark: SparkSession, sf_dir: str, compared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Donors with both amounts, and a key made of every part's name with shifted amounts."""
    rows = (_compared(spark, sf_dir) if compared is None else compared).filter("donor_type = 'Non-Individual'")
    side = [F.round(F.coalesce(F.sum(F.when(F.col("recipient") == r, F.col("amount"))), F.lit(0.0)), 2) for r in (A_SIDE[0], B_SIDE[0])]
    sums = rows.groupBy("canonical_donor").agg(side[0].alias("db_a"), side[1].alias("db_b"))
    donors = sums.join(compare.display_names(rows), "canonical_donor").select(F.col("display_name").alias("donor"), "db_a", "db_b")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct()
    named = parts.select(F.concat("p_name", F.when(F.length("p_name") % 2 == 0, F.lit(" Company")).otherwise(F.lit(" Assoc West"))).alias("company"), F.col("p_name"))
    shift = F.element_at(F.lit([0.0, 0.5, 1.0, 1500.0, 2000.0, 5000.0]), (F.length("p_name") % 6 + 1).cast("int"))
    base = donors.select(F.col("db_a"), F.lower(N.canonical_name(F.col("donor"))).alias("p_name"))
    key = named.join(base, "p_name", "left").select("company", F.round(F.coalesce("db_a", F.lit(100.0)) + shift, 2).alias("xl_a"), F.lit(0.0).alias("xl_b"))
    return donors, key


_SHEET = f"""{_COMPARED}, qrows AS (SELECT * FROM compared WHERE donor_type = 'Non-Individual'),
qsums AS (SELECT canonical_donor, round(coalesce(sum(amount) FILTER (WHERE recipient = 'Org 0'), 0), 2) AS db_a, round(coalesce(sum(amount) FILTER (WHERE recipient = 'Org 1'), 0), 2) AS db_b FROM qrows GROUP BY 1),
qnames AS (SELECT canonical_donor, donor, row_number() OVER (PARTITION BY canonical_donor ORDER BY count(*) DESC, donor) AS place FROM qrows GROUP BY 1, 2),
qdonors AS (SELECT donor, {O.canonical('donor')} AS canonical, db_a, db_b FROM qsums JOIN qnames USING (canonical_donor) WHERE place = 1),
parts AS (SELECT DISTINCT p_name FROM part),
akey AS (SELECT p_name || CASE WHEN length(p_name) % 2 = 0 THEN ' Company' ELSE ' Assoc West' END AS company,
  round(coalesce(db_a, 100.0) + [0.0, 0.5, 1.0, 1500.0, 2000.0, 5000.0][length(p_name) % 6 + 1], 2) AS xl_a, CAST(0.0 AS DOUBLE) AS xl_b FROM parts LEFT JOIN qdonors ON lower(canonical) = p_name),
owned AS (SELECT variant, arg_min(donor, (canonical, donor)) AS donor FROM (SELECT donor, canonical, unnest({O.variants('donor')}) AS variant FROM qdonors) GROUP BY variant),
cvar AS (SELECT company, unnest({O.variants('company')}) AS variant FROM akey),
exact AS (SELECT company, arg_min(donor, (canonical, donor)) AS donor FROM cvar JOIN owned USING (variant) JOIN qdonors USING (donor) GROUP BY company),
met AS (SELECT c.company, o.donor, CASE WHEN length(c.variant) <= length(o.variant) THEN c.variant ELSE o.variant END AS s, CASE WHEN length(c.variant) <= length(o.variant) THEN o.variant ELSE c.variant END AS l
  FROM cvar c CROSS JOIN owned o WHERE c.company NOT IN (SELECT company FROM exact)
  AND CASE WHEN {_NW.format('c.variant')} >= 2 THEN length(c.variant) >= 10 ELSE length(c.variant) >= 7 END AND CASE WHEN {_NW.format('o.variant')} >= 2 THEN length(o.variant) >= 10 ELSE length(o.variant) >= 7 END),
prefixes AS (SELECT company, arg_min(donor, (-length(s), canonical, donor)) AS donor FROM met JOIN qdonors USING (donor) WHERE starts_with(l, s) AND ({_NW.format('s')} >= 2 OR l = s OR starts_with(l, s || ' ')) GROUP BY company),
chosen AS (SELECT * FROM exact UNION ALL SELECT * FROM prefixes),
amounts AS (SELECT k.company, xl_a, coalesce(db_a, 0.0) AS db_a, xl_b, coalesce(db_b, 0.0) AS db_b, coalesce(c.donor, '(none)') AS matched_donor FROM akey k LEFT JOIN chosen c USING (company) LEFT JOIN qdonors q ON q.donor = c.donor),
ranked AS (SELECT *, CASE WHEN abs(db_a - xl_a) < 1 THEN 3 WHEN abs(db_a - xl_a) <= 2000 THEN 2 ELSE 1 END AS ra, CASE WHEN abs(db_b - xl_b) < 1 THEN 3 WHEN abs(db_b - xl_b) <= 2000 THEN 2 ELSE 1 END AS rb FROM amounts),
sheet AS (SELECT company, xl_a, db_a, xl_b, db_b, ['No', 'Close match', 'Yes'][ra] AS a_match, ['No', 'Close match', 'Yes'][rb] AS b_match, ['No', 'Close match', 'Yes'][least(ra, rb)] AS both_match,
  CASE WHEN ra = 1 AND rb = 1 THEN 'Yes' ELSE 'No' END AS neither_match, matched_donor FROM ranked)"""


# The same over resolved clusters: links by canonical names, alias groups, prefixes and similarity.


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.contributions(spark, sf_dir).filter(filters.within_dates(f"{YEAR}-01-01", f"{YEAR}-12-31"))
    found = materialize(clusters.cluster_donors(V.matched(spark, sf_dir).select("donor"), groups=_groups(spark)), "clusters")
    return compare.attach_clusters(materialize(rows, "year"), found)


_RESOLVED = f"""{_CANON},{_PREFIX},{_FUZZY},{_ALIAS},{_MEMBERS},{_EDGES},
compared AS (SELECT k.*, label.canonical_donor FROM kept k JOIN named USING (donor) JOIN label ON canonical = label.n WHERE "date" BETWEEN TIMESTAMP '{YEAR}-01-01' AND TIMESTAMP '{YEAR}-12-31'),
gave AS (SELECT canonical_donor, {_cents()} AS total FROM compared WHERE recipient = 'Org 0' GROUP BY 1 HAVING {_cents()} >= 100000),
excluded AS (SELECT canonical_donor FROM compared WHERE recipient = 'Org 1' GROUP BY 1 HAVING {_cents()} > 250000)"""


@_query(O.query("""SELECT canonical_donor, display_name, coalesce(round(sum(amount) FILTER (WHERE recipient = 'Org 0'), 2), 0) AS "Org 0", coalesce(round(sum(amount) FILTER (WHERE recipient = 'Org 1'), 2), 0) AS "Org 1",
    round(coalesce(round(sum(amount) FILTER (WHERE recipient = 'Org 0'), 2), 0) + coalesce(round(sum(amount) FILTER (WHERE recipient = 'Org 1'), 2), 0), 2) AS total
    FROM compared JOIN (SELECT canonical_donor, arg_max(donor, (n, -place)) AS display_name FROM (SELECT canonical_donor, donor, count(*) AS n, row_number() OVER (PARTITION BY canonical_donor ORDER BY donor) AS place FROM compared GROUP BY 1, 2) GROUP BY 1) USING (canonical_donor)
    WHERE recipient IN ('Org 0', 'Org 1') AND donor_type = 'Non-Individual' AND canonical_donor IN (SELECT canonical_donor FROM gave) AND canonical_donor NOT IN (SELECT canonical_donor FROM excluded) GROUP BY 1, 2""", _RESOLVED))
def a4_j18_resolved_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resolved clusters of organizations that qualify gave to both sides."""
    return compare.compare(_resolved(spark, sf_dir), A_SIDE, B_SIDE, 100000, 250000)["Non-Individual"]


@_query(O.query("SELECT * FROM sheet", _SHEET.replace(_COMPARED, _RESOLVED)))
def w3_j18_resolved_qc_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer key against resolved clusters."""
    donors, key = _qc_parts(spark, sf_dir, _resolved(spark, sf_dir))
    return reconcile.qc_sheet(key, donors)


@_query(O.query("SELECT * FROM sheet", _SHEET))
def j11_j12_p18_p19_w3_qc_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals held against a key."""
    donors, key = _qc_parts(spark, sf_dir)
    return reconcile.qc_sheet(key, donors)


_COUNTS = ("both_yes", "both_match = 'Yes'"), ("both_close", "both_match = 'Close match'"), ("a_yes", "a_match = 'Yes'"), ("b_yes", "b_match = 'Yes'"), ("neither", "neither_match = 'Yes'")


@_query(O.query("SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {t}) AS {k}, round(100.0 * count(*) FILTER (WHERE {t}) / count(*), 1) AS {k}_pct" for k, t in _COUNTS) + " FROM sheet", _SHEET))
def a8_qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of companies whose totals agree."""
    donors, key = _qc_parts(spark, sf_dir)
    return reconcile.summarize_qc(reconcile.qc_sheet(key, donors))


@_query(O.query("""SELECT year, metric, round(100.0 * o / n_old, 1) AS old_pct, round(100.0 * w / n_new, 1) AS new_pct, round(100.0 * w / n_new - 100.0 * o / n_old, 1) AS delta FROM (
  SELECT 1998 AS year, unnest(['both_yes', 'a_yes', 'b_yes', 'neither']) AS metric, unnest([count(*) FILTER (WHERE both_match = 'Yes'), count(*) FILTER (WHERE a_match = 'Yes'), count(*) FILTER (WHERE b_match = 'Yes'), count(*) FILTER (WHERE neither_match = 'Yes')]) AS w,
    unnest([count(*) FILTER (WHERE both_match = 'Yes' AND xl_a > 100000), count(*) FILTER (WHERE a_match = 'Yes' AND xl_a > 100000), count(*) FILTER (WHERE b_match = 'Yes' AND xl_a > 100000), count(*) FILTER (WHERE neither_match = 'Yes' AND xl_a > 100000)]) AS o,
    count(*) AS n_new, count(*) FILTER (WHERE xl_a > 100000) AS n_old FROM sheet)""", _SHEET))
def a16_qc_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the shares against those of an older sheet (here: the companies above 100,000)."""
    donors, key = _qc_parts(spark, sf_dir)
    sheet = reconcile.qc_sheet(key, donors).withColumn("year", F.lit(YEAR))
    return reconcile.qc_delta(reconcile.summarize_qc(sheet, "year"), reconcile.summarize_qc(sheet.filter("xl_a > 100000"), "year"))


@_query(O.query(f"""SELECT DISTINCT zip_code, state, abs(amount) AS dollars FROM matched WHERE is_company"""))
def p17_dollars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts printed as dollars, every second in parentheses, and parsed back."""
    rows = V.matched(spark, sf_dir).filter("is_company").select("zip_code", "state", "amount")
    shown = F.concat(F.lit("$"), F.format_string("%,.2f", F.col("amount")))
    text = F.when(F.col("zip_code") % 2 == 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    return rows.select("zip_code", "state", C.parse_dollar(text).alias("dollars")).distinct()


# Search for donors


def _terms(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{t}')" for t in _TERMS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(query)")


@_query(O.query(f"""SELECT donor, {O.normalized('donor')} AS bare, len(string_split(donor, ' ')) AS n FROM (SELECT DISTINCT donor FROM matched WHERE donor NOT LIKE '%(%')
  UNION ALL SELECT donor, {O.normalized("regexp_replace(donor, '\\s*\\([^)]*\\)', '', 'g')")}, 3 FROM (SELECT DISTINCT donor FROM matched WHERE donor LIKE '%(%')"""))
def f7_f12_search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search names of every donor: the last one has no parentheses."""
    rows = V.matched(spark, sf_dir).select("donor").distinct().withColumn("names", F.flatten(F.transform(N.split_terms(F.col("donor")), N.search_names)))
    n = F.when(F.col("donor").contains("("), F.size("names").cast("long")).otherwise(F.size(F.split("donor", " ")).cast("long"))
    return rows.select("donor", N.normalize_donor(F.element_at("names", -1)).alias("bare"), n.alias("n"))


_SUFFIX = "|".join(N.ACRONYM_SUFFIXES)


@_query(O.query(rf"""SELECT donor, CASE WHEN len(kept_words) >= 2 THEN array_to_string(list_transform(kept_words, lambda w: w[1]), '') ELSE '' END AS acronym FROM (
  SELECT donor, list_filter({O.words(rf"regexp_replace(' ' || regexp_replace(upper(donor), '[^A-Z0-9\s]', '', 'g'), '(\s+({_SUFFIX}))+\s*$', '')")}, lambda w: w NOT IN ({O.quoted(N.ACRONYM_FILLERS)})) AS kept_words FROM (SELECT DISTINCT donor FROM matched))"""))
def f8_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms of donors."""
    return V.matched(spark, sf_dir).select("donor").distinct().select("donor", N.acronym(F.col("donor")).alias("acronym"))


_FORMS = f"""terms AS (SELECT * FROM (VALUES {", ".join(f"('{t}')" for t in _TERMS)}) t(query)),
listed AS (SELECT query, {O.search_names('query')} AS all_names FROM terms),
snames AS (SELECT query, unnest(all_names) AS term, unnest(range(len(all_names))) AS pos FROM listed),
tvar AS (SELECT query, pos, unnest({O.variants('term')}) AS variant FROM snames),
twide AS (SELECT * FROM tvar UNION SELECT query, pos, f.form FROM tvar v JOIN lookup l ON v.variant = l.form JOIN forms f ON f.group_id = l.group_id),
dnames AS (SELECT DISTINCT donor FROM matched)"""


def _prefix_sql(terms: str) -> str:
    cut = f"CASE WHEN length(t.variant) <= length(d.variant) THEN t.variant ELSE d.variant END AS s, CASE WHEN length(t.variant) <= length(d.variant) THEN d.variant ELSE t.variant END AS l"
    return f"""SELECT DISTINCT query, pos, donor FROM (SELECT query, pos, donor, {cut} FROM {terms} t CROSS JOIN widened d)
  WHERE length(s) >= 2 AND starts_with(l, s) AND (length(s) >= 6 OR ({_NW.format('s')} = 1 AND (l = s OR starts_with(l, s || ' '))))"""


_TIERS = f"""hit AS (SELECT DISTINCT query, pos, group_id FROM twide JOIN lookup ON variant = form),
tiers AS (SELECT query, pos, donor, 0 AS tier, CAST(99.0 AS DOUBLE) AS score, 'alias match' AS match_type FROM hit JOIN forms f USING (group_id) JOIN widened w ON w.variant = f.form
  UNION SELECT query, pos, donor, 1, 100.0, 'exact match' FROM twide JOIN widened USING (variant)
  UNION SELECT query, pos, donor, 2, 96.0, 'prefix match' FROM ({_prefix_sql('twide')})
  UNION SELECT query, pos, donor, 3, score, 'acronym match' FROM (SELECT query, pos, donor, CASE WHEN length(ts) >= 2 AND da <> '' AND ts = da THEN 95.0 WHEN length(ta) >= 2 AND ds = ta THEN 93.0 WHEN length(ta) >= 3 AND da = ta THEN 90.0 END AS score
    FROM (SELECT query, pos, {O.simple('term')} AS ts, {O.acronym('term')} AS ta FROM snames) CROSS JOIN (SELECT donor, {O.simple('donor')} AS ds, {O.acronym('donor')} AS da FROM dnames)) WHERE score IS NOT NULL)"""
_SIMILAR = f"""tform AS (SELECT DISTINCT query, pos, unnest({O.stripped('term')}) AS f FROM snames), dform AS (SELECT DISTINCT donor, unnest({O.stripped('donor')}) AS f FROM dnames),
fpairs AS (SELECT DISTINCT t.f AS x, d.f AS y FROM tform t CROSS JOIN dform d WHERE length(t.f) >= 2 AND length(d.f) >= 2),{O.subsequences('fpairs', 'whole')},{O.best_windows('fpairs', 'part')},
alike AS (SELECT query, pos, donor, max(greatest(w.ratio, p.ratio)) AS score FROM tform t CROSS JOIN dform d JOIN whole w ON w.x = t.f AND w.y = d.f JOIN part p ON p.x = t.f AND p.y = d.f
  WHERE (query, pos, donor) NOT IN (SELECT (query, pos, donor) FROM tiers) GROUP BY 1, 2, 3),
met_all AS (SELECT * FROM tiers UNION ALL SELECT query, pos, donor, 4, score, 'fuzzy match' FROM alike WHERE score >= 72)"""
_EQUAL = "met_all AS (SELECT * FROM tiers)"
_MATCHES = f"""first_met AS (SELECT query, donor, score, match_type FROM (SELECT *, row_number() OVER (PARTITION BY query, donor ORDER BY pos, tier, score DESC, match_type) AS place FROM met_all) WHERE place = 1),
bare AS (SELECT query, pos, {O.normalized('term')} AS plain FROM snames WHERE query NOT IN (SELECT query FROM first_met GROUP BY query HAVING count(*) >= 5)),
bvar AS (SELECT query, pos, unnest({O.variants(O.geo('plain'))}) AS variant FROM bare WHERE {O.geo('plain')} NOT IN ('', plain)),
bwide AS (SELECT * FROM bvar UNION SELECT query, pos, f.form FROM bvar v JOIN lookup l ON v.variant = l.form JOIN forms f ON f.group_id = l.group_id),
geo_met AS (SELECT query, pos, donor, 0 AS tier, 'geo-variant match' AS match_type FROM bwide JOIN widened USING (variant) UNION SELECT query, pos, donor, 1, 'geo-prefix match' FROM ({_prefix_sql('bwide')})),
matches AS (SELECT * FROM first_met UNION ALL SELECT query, donor, CAST(94.0 AS DOUBLE), match_type FROM (SELECT *, row_number() OVER (PARTITION BY query, donor ORDER BY pos, tier) AS place FROM geo_met
  WHERE (query, donor) NOT IN (SELECT (query, donor) FROM first_met)) WHERE place = 1)"""
_FOUND = "few AS (SELECT donor, street, state, zip5 FROM idx WHERE (street, state, zip5) IN (SELECT (street, state, zip5) FROM idx GROUP BY street, state, zip5 HAVING count(DISTINCT donor) <= 5)), " + """
strong AS (SELECT DISTINCT query, street, state, zip5 FROM matches JOIN few USING (donor) WHERE score >= 86),
lifted AS (SELECT DISTINCT query, donor FROM matches JOIN few USING (donor) JOIN strong USING (query, street, state, zip5) WHERE score BETWEEN 72 AND 85),
confirmed AS (SELECT m.query, m.donor, CASE WHEN l.donor IS NULL THEN score ELSE 88.0 END AS score, CASE WHEN l.donor IS NULL THEN match_type ELSE 'address-confirmed ' || match_type END AS match_type
  FROM matches m LEFT JOIN lifted l ON l.query = m.query AND l.donor = m.donor),
near_by AS (SELECT DISTINCT query, donor, 85.0 AS score, 'address match' AS match_type FROM strong JOIN few USING (street, state, zip5) WHERE (query, donor) NOT IN (SELECT (query, donor) FROM matches))"""
_MATCH = "query, donor, CAST(round(score, 4) AS DOUBLE) AS score, match_type"


def _matches_shown(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 4))


@_query(O.query(f"SELECT {_MATCH} FROM matches", f"{_ALIAS},{_FORMS},{_TIERS},{_SIMILAR},{_MATCHES}"))
def j15_u3_w2_search_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors that match a batch of terms, before addresses."""
    return _matches_shown(search.search_donors(_terms(spark), V.matched(spark, sf_dir).select("donor"), _groups(spark)))


@_query(O.query(f"SELECT {_MATCH} FROM matches", f"{_ALIAS},{_FORMS},{_TIERS},{_EQUAL},{_MATCHES}"))
def j15_equal_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by equality alone: alias, exact, prefix and acronym tiers, and names without their place."""
    return _matches_shown(search.search_donors(_terms(spark), V.matched(spark, sf_dir).select("donor"), _groups(spark), fuzzy=False))


@_query(O.query(f"SELECT {_MATCH} FROM (SELECT * FROM confirmed UNION ALL SELECT * FROM near_by)", f"{_ALIAS},{_FORMS},{_TIERS},{_SIMILAR},{_MATCHES},{_INDEX},{_FOUND}"))
def j16_j17_t4_u4_find_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with what addresses add, best first."""
    rows = materialize(V.matched(spark, sf_dir), "matched")
    return _matches_shown(search.find_donors(_terms(spark), rows.select("donor"), _groups(spark), addresses.address_index(rows)))


_SCORED = "matches AS (SELECT 'q' || (length(donor) % 3) AS query, donor, CAST(60 + (length(donor) * 7 + strpos(donor, 'a')) % 41 AS DOUBLE) AS score, 'some match' AS match_type FROM (SELECT DISTINCT donor FROM matched WHERE is_company))"


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Matches of all scores, made of the donors' names, and the address index."""
    rows = materialize(V.matched(spark, sf_dir).filter("is_company"), "companies")
    d = F.col("donor")
    made = rows.select("donor").distinct().select(
        F.concat(F.lit("q"), (F.length(d) % 3).cast("string")).alias("query"), "donor", (60 + (F.length(d) * 7 + F.instr(d, "a")) % 41).cast("double").alias("score"), F.lit("some match").alias("match_type")
    )
    return made, addresses.address_index(rows)


@_query(O.query(f"SELECT {_MATCH} FROM confirmed", f"{_INDEX},{_SCORED},{_FOUND}"))
def j16_address_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all scores, the borderline ones lifted by addresses."""
    return search.address_confidence(*_scored(spark, sf_dir))


@_query(O.query(f"SELECT {_MATCH} FROM near_by", f"{_INDEX},{_SCORED},{_FOUND}"))
def j17_u4_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors that share an address with a strong match."""
    return search.colocated_donors(*_scored(spark, sf_dir))


# All links of clusters at once

_ALL_EDGES = """group_of AS (SELECT DISTINCT canonical, substr(donor, 1, 3) AS donor_group FROM named WHERE donor LIKE '%Inc.'),
edges AS (SELECT a, b FROM prefixed UNION SELECT a, b FROM close JOIN ratios ON id = a || '|' || b WHERE ratio >= threshold
  UNION SELECT a, b FROM close JOIN ratios ON id = a || '|' || b JOIN same_place USING (a, b) WHERE ratio >= threshold - 5 AND ratio < threshold
  UNION SELECT x.canonical, y.canonical FROM members x JOIN members y ON x.group_id = y.group_id AND x.canonical <> y.canonical
  UNION SELECT x.canonical, y.canonical FROM group_of x JOIN group_of y ON x.donor_group = y.donor_group AND x.canonical <> y.canonical),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT canonical AS n, canonical AS m FROM names UNION SELECT n, b FROM reach JOIN both_ways ON m = a),
label AS (SELECT n, arg_min(m, (length(m), m)) AS canonical_donor FROM reach GROUP BY n)"""


def _validated(named: DataFrame) -> DataFrame:
    """A table of validated groups derived from the names: those on Inc., by their first three letters."""
    return named.filter(F.col("donor").endswith("Inc.")).select(F.upper("donor").alias("donor_upper"), F.substr("donor", F.lit(1), F.lit(3)).alias("donor_group"))


@_query(O.query("SELECT donor, canonical_donor FROM named JOIN label ON canonical = n", f"{_CANON},{_PREFIX},{_FUZZY},{_PLACES},{_ALIAS},{_MEMBERS},{_ALL_EDGES}"))
def j18_all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors and their clusters by every kind of link: canonical names, alias and validated groups, prefixes, similarity and,
    for borderline pairs, addresses."""
    rows = materialize(V.matched(spark, sf_dir), "matched")
    return clusters.cluster_donors(rows.select("donor"), clusters.raw_addresses(rows), _validated(clusters.canonicals(rows)), _groups(spark))


# Round trips through files: written under the shared folder, read by the library's readers


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_query(O.query("SELECT contributor_name, employer, occupation, address, city, state, zipcode, amount, date, period_begin, period_end, recipient_ein, recipient_name, form_id FROM contributions_src"))
def s1_raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw filings through gzip CSV, where blank and missing are one."""
    path = _path(spark, "raw")
    V.contributions_src(spark, sf_dir).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
    return filings.read_raw_contributions(spark, path).na.fill("")


@_query(O.query("SELECT contributor_name, employer, occupation, address, city, state, zipcode, amount, date, period_begin, period_end, recipient_ein, recipient_name, form_id FROM contributions_src"))
def s1_ranges_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the reader of ranges of gzip files."""
    path = _path(spark, "raw-ranges")
    V.contributions_src(spark, sf_dir).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)
    return filings.read_appended_contributions(spark, path, 1 << 20).na.fill("")


@_query(O.query("SELECT form_id, insert_key FROM form_registry"))
def s2_registry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of forms through CSV."""
    path = _path(spark, "registry")
    V.registry_src(V.contributions_src(spark, sf_dir)).write.option("header", True).csv(path)
    return filings.read_form_registry(spark, path)


@_query(O.query(f"""SELECT {_COLUMNS}, strftime("date", '%Y-%m-%d') AS day FROM kept"""))
def s3_s6_contributions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean table through Parquet."""
    path = _path(spark, "contributions")
    sinks.write_contributions(V.contributions(spark, sf_dir), path)
    return filings.read_contributions(spark, path).withColumn("day", F.date_format("date", "yyyy-MM-dd")).drop("date")


@_query(O.query("SELECT upper(donor) AS donor_upper, max(substr(donor, 1, 3)) AS donor_group FROM matched WHERE donor LIKE '%Inc.' OR donor LIKE '%LLC' GROUP BY 1"))
def s4_s8_donor_groups_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated groups from both forms of JSON, through Parquet."""
    donors = V.matched(spark, sf_dir).select("donor").distinct()
    pair = F.struct("donor", F.substr("donor", F.lit(1), F.lit(3)).alias("donor_group"))
    paths = [_path(spark, name) for name in ("object", "list", "groups")]
    donors.filter(F.col("donor").endswith("Inc.")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.upper("donor"), pair["donor_group"])))).alias("value")).write.text(paths[0])
    donors.filter(F.col("donor").endswith("LLC")).agg(F.to_json(F.collect_list(pair)).alias("value")).write.text(paths[1])
    read = [filings.read_donor_groups(spark, p) for p in paths[:2]]
    sinks.write_donor_groups(read[0].union(read[1]), paths[2])
    return spark.read.parquet(paths[2])


@_query("SELECT DISTINCT p_name AS company, CAST(1000 + length(p_name) AS DOUBLE) AS xl_a, CAST(strpos(p_name, 'a') AS DOUBLE) AS xl_b FROM part")
def s5_answer_key_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer key with printed dollars through CSV; rows without a name or amounts are left out."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct()
    n = F.col("p_name")
    rows = parts.select(F.concat(F.lit(" "), n).alias("Company Name"), F.concat(F.lit("$1,0"), F.lpad(F.length(n).cast("string"), 2, "0")).alias("A"), F.concat(F.lit("("), F.instr(n, "a").cast("string"), F.lit(")")).alias("B"))
    path = _path(spark, "key")
    rows.union(rows.select(F.lit(" "), "A", "B")).union(rows.select("`Company Name`", F.lit("0"), F.lit("x"))).write.option("header", True).csv(path)
    return filings.read_answer_key(spark, path, "Company Name", "A", "B")


@_query(_SQL["a1_recipient_summary"])
def s7_summary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by recipient and year through Parquet."""
    path = _path(spark, "summary")
    sinks.write_recipient_summary(reports.recipient_summary(V.contributions(spark, sf_dir)), path)
    return spark.read.parquet(path)


@_query(_SQL["p15_p16_t1_line_items"])
def s9_line_items_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5000 line items of organizations through CSV, where blank and missing are one (no date of these is missing)."""
    path = _path(spark, "items")
    items = reports.line_items(filters.split_by_type(V.contributions(spark, sf_dir))[1])
    sinks.export_line_items(items, path)
    return spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path).select(*(F.col(f"`{c}`").cast(t) for c, t in items.dtypes)).na.fill("", ["Employer", "Occupation"])


@_query(_SQL["a7_t3_breakdown"])
def s10_breakdown_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of recipients within their party through CSV."""
    path = _path(spark, "breakdown")
    rows = reports.recipient_breakdown(V.contributions(spark, sf_dir))
    sinks.export_summary(rows, path)
    return spark.read.option("header", True).csv(path).select(*(F.col(c).cast(t) for c, t in rows.dtypes))


@_query(O.query(f"SELECT *, CAST({YEAR} AS INTEGER) AS year FROM sheet", _SHEET))
def s11_qc_sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of a year through Parquet."""
    path = _path(spark, "sheet")
    donors, key = _qc_parts(spark, sf_dir)
    sinks.write_qc_sheet(reconcile.qc_sheet(key, donors).withColumn("year", F.lit(YEAR)), path)
    return spark.read.parquet(path)


@_query(O.query("SELECT donor, CAST(count(*) AS BIGINT) AS places FROM idx GROUP BY donor", _INDEX))
def a14_addresses_of_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many address keys each company donor has."""
    index = addresses.address_index(V.matched(spark, sf_dir))
    return addresses.addresses_of(index).select("donor", F.size("addresses").cast("long").alias("places"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
