import random

from pyspark.sql import functions as F

from donorloom.operators import aliases, compare, reports, search
from donorloom.sources import filings


def contributions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["B", "A", "a", "Zé", None]), rng.choice(["Individual", "Non-Individual"]), None if rng.random() < 0.1 else f"20{rng.randint(20, 24)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", rng.randint(1, 50) / 4, rng.choice(["R1", "R2", "R3"]), "P") for _ in range(300)]
    df = spark.createDataFrame(rows, "donor string, donor_type string, day string, amount double, recipient string, recipient_party string").withColumn("date", F.to_timestamp("day"))
    return df.withColumns({c: F.lit("") for c in ("employer", "occupation", "street", "city", "state", "zip_code")}).repartition(7)


def test_results_come_in_order(spark):
    """Reports are collected as they are sorted: donors by name, breakdowns and matrices largest first, line items as printed."""
    df = contributions(spark)
    assert [r["donor"] for r in reports.distinct_donors(df).collect()] == sorted({"B", "A", "a", "Zé"})
    rows = [(-r["total_amount"], r["recipient_party"], r["recipient"]) for r in reports.recipient_breakdown(df).collect()]
    assert rows == sorted(rows) and len(rows) == 3
    matrix = [(-r["total"], r["canonical_donor"]) for r in compare.donor_recipient_matrix(df.withColumn("canonical_donor", F.col("donor")), ["R1", "R2"]).collect()]
    assert matrix == sorted(matrix) and len(matrix) == 4
    items = reports.line_items(df, cap=250).collect()
    key = lambda r: (r["Donor"] is None, r["Donor"] or "", r["Date"] is None, r["Date"] or "")
    assert len(items) == 250 and [key(r) for r in items] == sorted(key(r) for r in items)
    assert [key(r) for r in items] == sorted(key(r) for r in reports.display(df).collect())[:250]


def test_search_results_come_in_order(spark):
    donors = spark.createDataFrame([(d,) for d in ("Acme Widget", "Acme Widget Inc", "Acme Widgets", "Acme Wijget", "Other")], "donor string")
    terms = spark.createDataFrame([("Acme Widget",), ("Other",)], "query string")
    index = spark.createDataFrame([], "donor string, street string, state string, zip5 string")
    got = [(r["query"], -r["score"], r["donor"]) for r in search.find_donors(terms, donors, aliases.sample_groups(spark), index).collect()]
    assert got == sorted(got) and len(got) >= 4


def test_alias_groups_from_files(spark, tmp_path):
    (tmp_path / "groups.json").write_text('[["Chubb", " ACE American "], [], ["Altria", "", null]]')
    (tmp_path / "groups.csv").write_text('group_id,name\n0,"Chubb"\n0," ACE American "\n2,Altria\nx,bad\n3,\n')
    want = [(0, "ACE American"), (0, "Chubb"), (2, "Altria")]
    for name in ("groups.json", "groups.csv"):
        got = filings.read_alias_groups(spark, str(tmp_path / name))
        assert sorted((r["group_id"], r["name"]) for r in got.collect()) == want
        assert aliases.alias_forms(got).filter("form = 'CHUBB'").count() == 1
