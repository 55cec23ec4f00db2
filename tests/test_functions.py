import random

import pytest
from pyspark.sql import functions as F

from donorloom.functions import address as A
from donorloom.functions import cleaning as C
from donorloom.functions import names as N
from donorloom.functions import similarity as S


def apply(spark, values, *columns):
    rows = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, a string, b string, c string" if isinstance(values[0], tuple) and len(values[0]) == 3 else "i int, a string, b string" if isinstance(values[0], tuple) else "i int, a string")
    got = rows.select("i", *(c.alias(f"r{k}") for k, c in enumerate(columns))).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in got]


@pytest.fixture(autouse=True, scope="module")
def columns(spark):
    globals().update({n: F.col(n) for n in "abc"})


def test_eins_amounts_dollars(spark):
    assert apply(spark, ["52-1304889", "30457299", None, "1234567890"], C.norm_ein(a)) == ["521304889", "030457299", "000000000", "1234567890"]
    assert apply(spark, ["1200", " 3.5 ", "-2", "12d", "x", "", None, "nan", "1e3", ".5", "1_000", "1__0", "_1"], C.parse_amount(a)) == [1200.0, 3.5, -2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1000.0, 0.5, 1000.0, 0.0, 0.0]
    assert apply(spark, ["$1,200", "(50)", "x", "", None, "($1,000.50)"], C.parse_dollar(a)) == [1200.0, 50.0, 0.0, 0.0, 0.0, 1000.5]


def test_dates(spark):
    rows = [("20230809", ""), ("", "20230930"), ("20230231", "20230930"), ("2023-08-09", "20230930"), ("", ""), (None, None)]
    got = apply(spark, rows, F.date_format(C.parse_filing_date(a, b), "yyyyMMdd"), C.filing_day(a, b))
    assert got == [("20230809", "20230809"), ("20230930", "20230930"), (None, "20230231"), ("20230930", "20230930"), (None, None), (None, None)]
    assert apply(spark, ["2023-01-02 03:04:05", "20230102", "", None], C.insert_key(a)) == [20230102030405, 20230102000000, 0, 0]


def test_classes(spark):
    rows = [
        ("CVS Health", "", "NA"), ("Aaron E. Jabbour", "", "Retired"), ("Aetna", "NA", "NA"), ("Smith, John A.", "NA", "NA"), ("Bayer US, LLC", "NA", "NA"), ("Pat Doe", "SELF", ""),
        ("Jane Roe MD", None, None), ("Dr. Jane Roe", "", ""), ("Farm CO-OP", "x y", "Owner"), ("Acme, Inc", "N/A", "none"), ("Lee, 9 Lives", "", ""), (None, None, None),
    ]
    i, o = C.INDIVIDUAL, C.ORGANIZATION
    assert apply(spark, rows, C.classify_donor(a, b, c)) == [o, i, o, i, o, i, i, i, o, o, o, o]


def test_person_names(spark):
    rows = [("Smith, John A.", "Individual"), ("John Q. Public Jr.", "Individual"), ("Cher", "Individual"), ("Acme Inc", "Non-Individual"), ("Doe,", "Individual"), ("", "Individual"), ("A. B.", "Individual")]
    s = C.split_person_name(a, b)
    assert apply(spark, rows, s["first"], s["last"]) == [("John", "Smith"), ("John", "Public"), ("Cher", ""), ("", ""), ("", "Doe"), ("", ""), ("A", "B")]


def test_normal_names(spark):
    assert apply(spark, ["U.S. Gas & Oil (In-Kind)", "O'Neil/Ray N/A", "A.B.C.D. Co", "X - In Kind"], N.normalize_donor(a), N.normalize_donor_no_amp(a)) == [
        ("US GAS AND OIL", "U S GAS OIL"), ("ONEIL RAY", "ONEIL RAY"), ("ABCD CO", "A B C D CO"), ("X", "X"),
    ]
    assert apply(spark, ["ACME CO INC", "CORP", "THE BANK", "FARMERS OF IOWA"], N.strip_legal(a), N.no_the(a), N.strip_geo(a)) == [
        ("ACME", "ACME CO INC", "ACME CO INC"), ("CORP", "CORP", "CORP"), ("THE BANK", "BANK", "THE BANK"), ("FARMERS OF IOWA", "FARMERS OF IOWA", "FARMERS"),
    ]
    assert apply(spark, ["X ASSN INS", "X ASSOCIATION"], N.expand_abbrevs(a), N.contract_abbrevs(a)) == [("X ASSOCIATION INSURANCE", "X ASSN INS"), ("X ASSOCIATION", "X ASSOC")]
    assert apply(spark, ["International Business Machines", "American Broadcasting Company", "The Bank of Ohio Inc", "Inc"], N.acronym(a)) == ["IBM", "ABC", "BO", ""]
    assert apply(spark, ["Sevita (The Mentor Network)", "A / Bcd / Efgh (x)"], N.search_names(a)) == [["Sevita (The Mentor Network)", "The Mentor Network", "Sevita"], ["A / Bcd / Efgh (x)", "A / Bcd / Efgh", "Bcd", "Efgh"]]
    assert apply(spark, ["a; b;;"], N.split_terms(a)) == [["a", "b"]]
    got = apply(spark, ["The ACME & Sons Inc"], N.name_variants(a))[0]
    assert {"THE ACME AND SONS INC", "ACME AND SONS", "ACME SONS"} <= set(got) and "" not in got and len(got) == len(set(got))


def plain_ratio(x, y):
    row = [0] * (len(y) + 1)
    for p in x:
        new = [0]
        for j, q in enumerate(y):
            new.append(row[j] + 1 if p == q else max(row[j + 1], new[-1]))
        row = new
    return 200 * row[-1] / (len(x) + len(y))


def test_ratios(spark):
    assert apply(spark, [("ACME WIDGETS", "ACME WIDGET"), ("KITTEN", "SITTING")], F.round(S.indel_ratio(a, b), 4)) == [95.6522, 61.5385]
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choices("abcdé", k=rng.randint(1, 90))) for _ in range(2)) for _ in range(300)]
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    want = [plain_ratio(x, y) for x, y in pairs]
    assert S.ratios(left, right) == pytest.approx(want) and S.ratios(right, left) == pytest.approx(want)
    assert S.partial_ratios(["ACME"], ["THE ACME CORP"]) == [100.0]
    assert apply(spark, [("a", None), (None, None)], S.indel_ratio(a, b)) == [None, None]


def test_addresses(spark):
    assert apply(spark, ["12 Main St, Suite 4", "5 STEWART RD", None, "nan", "N. 1st Ave #7"], A.normalize_street(a), A.extract_secondary(a)) == [
        ("12 MAIN STREET", "4"), ("5 ROAD", "WART"), ("", None), ("", None), ("NORTH 1ST AVENUE 7", None),
    ]
    rows = spark.createDataFrame([("1 Main St Ste 4", "X", "NY", "1 Main Street Suite 5", "X", "NY"), ("1 Main St", "", "NY", "1 Main Street", "Y", "NY"), ("", "X", "NY", "1 Main St", "X", "NY"), ("1 Main St", "X", "", "1 Main St", "X", "NY")], "s string, c string, t string, s2 string, c2 string, t2 string")
    x = F.struct(F.col("s").alias("street"), F.col("c").alias("city"), F.col("t").alias("state"))
    y = F.struct(F.col("s2").alias("street"), F.col("c2").alias("city"), F.col("t2").alias("state"))
    assert [r[0] for r in rows.select(A.addresses_compatible(x, y)).collect()] == [False, True, None, False]
    key = A.address_key(a, b, c)
    assert apply(spark, [("12 Main Street, Suite 4", "ny", "12345-678"), ("1 A", "NY", "1"), ("12 Main St", "", "1")], key) == [("12 MAIN ST STE 4", "NY", "12345"), None, None]
