"""DuckDB SQL for the queries of the registry: every statement starts from the raw tables."""

from __future__ import annotations

from donorloom.functions import address as A
from donorloom.functions import cleaning as C
from donorloom.functions import names as N

SRC = """
contributions_src AS (
  WITH b AS (
    SELECT l.*, p_name, s_nationkey AS nk, c_custkey, c_mktsegment, c_nationkey, year(l_shipdate) AS y, quarter(l_shipdate) AS q,
           CASE WHEN quarter(l_shipdate) <= 2 THEN 1 ELSE 2 END AS h, (l_linenumber % 3 = 2 AND s_nationkey % 2 = 0) AS amended
    FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
  SELECT CASE WHEN l_orderkey % 4 = 0 THEN c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ', Ann' WHEN 1 THEN ', Bob J.' ELSE ', Cy Jr' END
              ELSE CASE l_linenumber WHEN 1 THEN p_name || ' Inc.' WHEN 2 THEN p_name || ', LLC' WHEN 3 THEN 'The ' || p_name || ' Corp'
                WHEN 4 THEN p_name || ' (In-Kind)' WHEN 5 THEN p_name || ' & Co' WHEN 6 THEN p_name || ' Assoc' ELSE p_name || ' PAC' END END AS contributor_name,
    CASE WHEN l_orderkey % 4 = 0 AND l_quantity > 10 THEN 'Acme' ELSE 'N/A' END AS employer,
    CASE WHEN l_orderkey % 4 = 0 AND l_quantity > 25 THEN 'Retired' ELSE 'NA' END AS occupation,
    CAST(c_custkey % 40 AS VARCHAR) || ' Main St Suite ' || CAST(c_custkey % 3 AS VARCHAR) AS address,
    'City ' || CAST(c_nationkey AS VARCHAR) AS city, 'S' || CAST(c_nationkey AS VARCHAR) AS state,
    lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zipcode, CAST(l_extendedprice AS VARCHAR) AS amount,
    CASE WHEN l_quantity = 1 THEN '' WHEN l_quantity = 2 THEN strftime(l_shipdate + INTERVAL 200 DAY, '%Y%m%d') ELSE strftime(l_shipdate, '%Y%m%d') END AS date,
    strftime(make_date(y, CASE WHEN amended THEN h*6-5 ELSE q*3-2 END, 1), '%Y%m%d') AS period_begin,
    strftime(last_day(make_date(y, CASE WHEN amended THEN h*6 ELSE q*3 END, 1)), '%Y%m%d') AS period_end,
    lpad(CAST(100000000 + nk AS VARCHAR), 9, '0') AS recipient_ein, 'Org ' || CAST(nk AS VARCHAR) AS recipient_name,
    CAST(nk*1000000 + y*10 + CASE WHEN amended THEN 4+h ELSE q END AS VARCHAR) AS form_id
  FROM b),
form_registry AS (
  SELECT form_id, CAST(max(period_end) || CASE WHEN CAST(form_id AS BIGINT) % 10 > 4 THEN '235959' ELSE '000000' END AS BIGINT) AS insert_key
  FROM contributions_src GROUP BY form_id)"""


def strip(x: str, chars: str = r"\s") -> str:
    return f"regexp_replace({x}, '^[{chars}]+|[{chars}]+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def mapped(x: str, table: dict[str, str]) -> str:
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"
    return f"array_to_string(list_transform({words(x)}, lambda w: coalesce({known}[w], w)), ' ')"


def nullish(x: str) -> str:
    s = rf"regexp_replace({strip('upper(' + strip(x) + ')', ' .')}, '\s+', ' ', 'g')"
    return f"({s} IN ({quoted(C.NULLISH)}) OR length({s}) < 2)"


def org_word(x: str) -> str:
    upper = f"upper({strip(x)})"
    tokens = words(rf"regexp_replace({upper}, '[^A-Z0-9&\- ]', ' ', 'g')")
    return f"(regexp_matches({upper}, '{C.LEGAL_SUFFIX}') OR list_has_any({tokens}, [{quoted(C.ORG_WORDS)}]))"


def personal(x: str) -> str:
    n = strip(x)
    tokens = words(f"regexp_replace(upper({n}), '[^A-Z0-9.& ]', ' ', 'g')")
    after = words(f"CASE WHEN contains({n}, ',') THEN substr({n}, strpos({n}, ',') + 1) END")
    bare = "trim(upper(w), '.')"
    return (
        f"(coalesce(trim({tokens}[-1], '.') IN ({quoted(C.PERSON_TOKENS)}), false) OR coalesce(trim({tokens}[1], '.') IN ({quoted(C.TITLES)}), false) OR "
        rf"coalesce(len({after}) BETWEEN 1 AND 3 AND len(list_filter({after}, lambda w: NOT regexp_full_match(w, '[A-Za-z.\-'']+') OR {bare} IN ({quoted(C.COMMA_LEGAL)}))) = 0, false))"
    )


def donor_type(name: str, employer: str, occupation: str) -> str:
    return (
        f"CASE WHEN {org_word(name)} THEN 'Non-Individual' WHEN NOT {nullish(occupation)} THEN 'Individual' WHEN NOT {nullish(employer)} THEN 'Individual' "
        f"WHEN {personal(name)} THEN 'Individual' ELSE 'Non-Individual' END"
    )


def normalized(x: str, ampersand: str = " AND ", initials: bool = True) -> str:
    s = f"upper({strip(x)})"
    steps = [(r"\s*\([^)]*\)", ""), (r"\s*[-–]?\s*IN[\s-]*KIND\b", ""), ("N/A$", ""), ("''", ""), ("&", ampersand), ("/", " ")]
    steps += [(r"\b([A-Z])\.([A-Z])\.?", r"\1\2")] if initials else []
    for pattern, to in [*steps, (r'[.\-,;:"]', " "), (r"\s+", " ")]:
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    return strip(s)


def expanded(x: str) -> str:
    return mapped(x, N.ABBREVIATIONS)


def contracted(x: str) -> str:
    back: dict[str, str] = {}
    for short, long in N.ABBREVIATIONS.items():
        back.setdefault(long, short)
    return mapped(x, back)


def no_legal(x: str) -> str:
    return strip(rf"regexp_replace({x}, '(\s+({N.LEGAL}))+\s*$', '')")


def no_the(x: str) -> str:
    return f"regexp_replace({x}, '^THE ', '')"


def canonical(x: str) -> str:
    return f"coalesce(nullif({no_the(no_legal(expanded(normalized(x))))}, ''), {normalized(x)})"


def variants(x: str) -> str:
    forms = []
    for base in (normalized(x), normalized(x, " ", False)):
        forms += [base, no_legal(base), expanded(base), contracted(base), no_legal(expanded(base)), no_legal(contracted(base))]
    return f"list_filter(list_distinct(list_concat([{', '.join(forms)}], [{', '.join(map(no_the, forms))}])), lambda v: v <> '')"


def street(x: str) -> str:
    base = rf"regexp_replace(regexp_replace(upper({strip(x)}), '(?i)\b(SUITE|STE|OFFICE|OFC|APT|APARTMENT|FLOOR|FL|BLDG|BUILDING|UNIT|RM|ROOM|#)\s*\.?\s*(\w+)', '', 'g'), '[.,#\-/]', ' ', 'g')"
    return f"CASE WHEN {strip(x)} IN ('', 'nan', 'None') THEN '' ELSE {mapped(base, A.STREET_WORDS)} END"


def secondary(x: str) -> str:
    return rf"nullif(regexp_extract(upper({x}), '(?i)\b(SUITE|STE|OFFICE|OFC|APT|APARTMENT|FLOOR|FL|BLDG|BUILDING|UNIT|RM|ROOM|#)\s*\.?\s*(\w+)', 2), '')"


def key_street(x: str) -> str:
    s = rf"regexp_replace(upper({strip(x)}), '[.\-,;:#''""]', ' ', 'g')"
    for long, short in A.KEY_WORDS.items():
        s = rf"regexp_replace({s}, '\b{long}\b', '{short}', 'g')"
    return strip(rf"regexp_replace({s}, '\s+', ' ', 'g')")


_N = "regexp_replace(contributor_name, '^\\s+|\\s+$', '', 'g')"
_PARTS = f"list_filter({words(_N)}, lambda w: trim(upper(w), '.') NOT IN ({quoted(C.SUFFIXES)}))"

MATCHED = f"""{SRC},
parents AS (SELECT CAST(100000000 + k AS VARCHAR) AS ein, 'Org ' || k AS recipient, CASE WHEN k % 2 = 0 THEN 'Democrats' ELSE 'Republicans' END AS party FROM range(12) t(k)),
affiliated AS (SELECT CAST(100000000 + k AS VARCHAR) AS ein, CAST(100000000 + k - 12 AS VARCHAR) AS parent_ein FROM range(12, 22) t(k)),
kinds AS (SELECT contributor_name, employer, occupation, {donor_type('contributor_name', 'employer', 'occupation')} AS donor_type,
    CASE WHEN {nullish('employer')} THEN '' ELSE employer END AS clean_employer, CASE WHEN {nullish('occupation')} THEN '' ELSE occupation END AS clean_occupation,
    CASE WHEN contains({_N}, ',') THEN trim(split_part(trim(substr({_N}, strpos({_N}, ',') + 1)), ' ', 1), ' .') WHEN len({_PARTS}) = 1 THEN {_PARTS}[1]
         WHEN len({_PARTS}) > 1 THEN trim({_PARTS}[1], ' .') ELSE '' END AS person_first,
    CASE WHEN contains({_N}, ',') THEN trim(split_part({_N}, ',', 1), ' .') WHEN len({_PARTS}) > 1 THEN trim({_PARTS}[-1], ' .') ELSE '' END AS person_last
  FROM (SELECT DISTINCT contributor_name, employer, occupation FROM contributions_src)),
matched AS (
  SELECT s.contributor_name AS donor, CASE WHEN donor_type = 'Individual' THEN person_last ELSE '' END AS "last", CASE WHEN donor_type = 'Individual' THEN person_first ELSE '' END AS "first",
    donor_type = 'Non-Individual' AS is_company, donor_type, clean_employer AS employer, clean_occupation AS occupation, trim(address) AS street, trim(city) AS city, trim(state) AS state,
    trim(zipcode) AS zip_code, CAST(amount AS DOUBLE) AS amount, CASE WHEN length(date) = 8 THEN date WHEN length(period_end) = 8 THEN period_end END AS filing_day,
    strptime(CASE WHEN length(date) = 8 THEN date WHEN length(period_end) = 8 THEN period_end END, '%Y%m%d') AS "date",
    p.recipient, p.party AS recipient_party, p.ein AS recipient_ein, CASE WHEN a.ein IS NOT NULL THEN recipient_name ELSE '' END AS affiliated_from, s.recipient_ein AS own_ein, form_id, period_begin, period_end
  FROM contributions_src s LEFT JOIN affiliated a ON s.recipient_ein = a.ein JOIN parents p ON p.ein = coalesce(a.parent_ein, s.recipient_ein)
  JOIN kinds k ON k.contributor_name = s.contributor_name AND k.employer = s.employer AND k.occupation = s.occupation),
filings AS (
  SELECT DISTINCT own_ein AS ein, CAST(form_id AS BIGINT) AS form, CAST(period_begin AS BIGINT) AS pb, CAST(period_end AS BIGINT) AS pe, coalesce(insert_key, 0) AS insert_key FROM matched LEFT JOIN form_registry USING (form_id)),
winners AS (
  SELECT ein, day, arg_max(form, (insert_key, form)) AS winner FROM (SELECT DISTINCT own_ein AS ein, CAST(filing_day AS BIGINT) AS day FROM matched WHERE "date" IS NOT NULL)
  JOIN filings USING (ein) WHERE day BETWEEN pb AND pe AND ein IN (SELECT ein FROM filings GROUP BY ein HAVING count(DISTINCT form) > 1) GROUP BY ein, day),
kept AS (SELECT m.* FROM matched m LEFT JOIN winners w ON w.ein = m.own_ein AND w.day = CAST(filing_day AS BIGINT) WHERE winner IS NULL OR winner = CAST(form_id AS BIGINT))"""

LCS = """
lcs(id, x, y, i, row) AS (
  SELECT id, x, y, 0, list_transform(range(length(y) + 1), lambda k: 0) FROM pairs
  UNION ALL
  SELECT id, x, y, i + 1,
    list_concat([0], list_transform(range(1, length(y) + 1), lambda j: list_max(list_transform(range(1, j + 1),
      lambda k: greatest(row[k + 1], row[k] + CASE WHEN substr(y, k, 1) = substr(x, i + 1, 1) THEN 1 ELSE 0 END)))))
  FROM lcs WHERE i < length(x)),
ratios AS (SELECT id, 200.0 * row[length(y) + 1] / (length(x) + length(y)) AS ratio FROM lcs WHERE i = length(x))"""


def geo(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+OF\s+({N.REGIONS})\b', '', 'gi')")


def stripped(x: str) -> str:
    return f"[{no_legal(normalized(x))}, {no_legal(expanded(normalized(x)))}, {no_legal(normalized(x, ' ', False))}]"


def acronym(x: str) -> str:
    bare = rf"regexp_replace(' ' || regexp_replace(upper({x}), '[^A-Z0-9\s]', '', 'g'), '(\s+({'|'.join(N.ACRONYM_SUFFIXES)}))+\s*$', '')"
    kept = f"list_filter({words(bare)}, lambda w: w NOT IN ({quoted(N.ACRONYM_FILLERS)}))"
    return f"CASE WHEN len({kept}) >= 2 THEN array_to_string(list_transform({kept}, lambda w: w[1]), '') ELSE '' END"


def simple(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({strip(f'upper({x})')}, '[.\-,'']', '', 'g'), '\s+', ' ', 'g')")


def search_names(x: str) -> str:
    bare = "regexp_replace({0}, '\\s*\\([^)]*\\)', '', 'g')".replace("\\\\", "\\")
    whole, base = strip(x), strip(bare.format(x))
    inner = rf"list_filter(list_transform(regexp_extract_all({x}, '\(([^)]+)\)', 1), lambda p: {strip('p')}), lambda p: length(p) > 2)"
    split = f"CASE WHEN contains({x}, ' / ') THEN list_filter(list_transform(string_split({x}, ' / '), lambda p: {strip(bare.format('p'))}), lambda p: length(p) > 2) ELSE [] END"
    every = f"list_concat([{whole}], {inner}, CASE WHEN {base} NOT IN ('', {whole}) THEN [{base}] ELSE [] END, {split})"
    return f"list_filter({every}, lambda v, i: list_position({every}, v) = i)"


def subsequences(source: str, name: str) -> str:
    """``name`` (x, y, ratio) for the pairs of ``source``, x of 60 characters at most: the subsequence in bits, a character of y
    a step."""
    full = "((1::BIGINT << length(x)) - 1)"
    mask = "CAST(coalesce(list_sum(list_transform(range(length(x)), lambda k: CASE WHEN substr(x, k + 1, 1) = substr(y, i + 1, 1) THEN 1::BIGINT << k ELSE 0 END)), 0) AS BIGINT)"
    return f"""
{name}_steps AS (
  SELECT x, y, 0 AS i, {full} AS v FROM {source}
  UNION ALL SELECT x, y, i + 1, ((v + (v & m)) | (v - (v & m))) & {full} FROM (SELECT *, {mask} AS m FROM {name}_steps WHERE i < length(y))),
{name} AS (SELECT x, y, 200.0 * (length(x) - bit_count(v)) / (length(x) + length(y)) AS ratio FROM {name}_steps WHERE i = length(y))"""


def best_windows(source: str, name: str) -> str:
    """``name`` (x, y, ratio) for the pairs of ``source``: the best ratio of the shorter with a window of the longer."""
    return f"""
{name}_sides AS (SELECT x AS p, y AS q, x AS s, y AS l FROM {source} WHERE length(x) <= length(y) UNION SELECT x, y, y, x FROM {source} WHERE length(y) <= length(x)),
{name}_cuts AS (SELECT DISTINCT s AS x, unnest(list_concat(list_transform(range(length(l) - length(s) + 1), lambda k: substr(l, k + 1, length(s))),
    list_transform(range(1, length(s)), lambda k: substr(l, 1, k)), list_transform(range(1, length(s)), lambda k: substr(l, length(l) - k + 1, k)))) AS y, l FROM {name}_sides),
{name}_pairs AS (SELECT DISTINCT x, y FROM {name}_cuts),{subsequences(f'{name}_pairs', f'{name}_ratios')},
{name} AS (SELECT p AS x, q AS y, max(ratio) AS ratio FROM {name}_sides JOIN {name}_cuts c ON c.x = s AND c.l = {name}_sides.l JOIN {name}_ratios r ON r.x = s AND r.y = c.y GROUP BY p, q)"""


def query(body: str, extra: str = "") -> str:
    return f"WITH RECURSIVE {MATCHED}{',' + extra if extra else ''}\n{body}"
