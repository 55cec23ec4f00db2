import random
import time

from pyspark.sql import functions as F

from donorloom.functions.cleaning import day_number
from donorloom.operators import rollup, supersession


def found(spark, rows):
    return spark.createDataFrame(rows, "ein string, form long, pb long, pe long, insert_key long")


def test_segments_equal_each_day(spark):
    """Disjoint, in order, and on each day the newest of the periods that cover it; empty periods and equal ones."""
    rng = random.Random(1)
    rows = []
    for e in range(30):
        for form in range(rng.randint(1, 25)):
            begin = rng.randint(0, 60)
            rows.append((f"e{e}", form, begin, begin + rng.randint(-3, 20), rng.randint(0, 4)))
    rows += [("e0", 100, 5, 5, 9), ("e0", 101, 5, 5, 9), (None, 1, 0, 9, 1), ("solo", 1, 7, 3, 1)]
    for parts in (1, 7):
        got = [tuple(r) for r in supersession.segments(found(spark, rows).repartition(parts)).collect()]
        by = {}
        for ein, start, end, winner in sorted(got):
            assert start <= end and start > by.get((ein, "end"), -1)
            assert by.get((ein, start - 1)) != winner  # segments of one winner are one
            by[ein, "end"] = end
            by |= {(ein, d): winner for d in range(start, end + 1)}
        days = {k: v for k, v in by.items() if k[1] != "end"}
        want = {}
        for ein, form, pb, pe, key in rows:
            for d in range(pb, pe + 1) if ein else ():
                want[ein, d] = max(want.get((ein, d), (-1, -1)), (key, form))
        assert days == {k: form for k, (_, form) in want.items()}


def test_winners_of_a_filer_with_many_filings(spark):
    """10,000 filings of one filer meet 10,000 days in less than it takes to compare all with all (10^8 pairs)."""
    rng = random.Random(2)
    start = 20000101
    rows = []
    for form in range(10_000):
        begin = rng.randint(0, 9_000)
        rows.append((form, begin, begin + rng.randint(0, 90) if form % 50 else 10_000))
    days = spark.range(10_000).select(F.lit("A").alias("recipient_ein"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp").alias("date"))
    number = {r["id"]: r["n"] for r in days.select(F.monotonically_increasing_id().alias("i"), day_number(F.col("date")).alias("n")).withColumn("id", F.row_number().over(supersession.W.orderBy("n")) - 1).collect()}
    number[10_000] = 99991231
    filed = spark.createDataFrame([("A", str(f), str(number[b]), str(number.get(e, 99991231))) for f, b, e in rows], "recipient_ein string, form_id string, period_begin string, period_end string")
    table = days.withColumns({c: F.lit(None).cast("string") for c in ("form_id", "period_begin", "period_end")}).unionByName(filed.withColumn("date", F.lit(None).cast("timestamp")))
    registry = spark.createDataFrame([(str(f), f % 97) for f, _, _ in rows], "form_id string, insert_key long")
    began = time.time()
    got = {r["day"]: r["winner"] for r in supersession.winners(table, registry).collect()}
    assert time.time() - began < 60 and start in number.values()
    for d in rng.sample(range(10_000), 60):
        covering = [(f % 97, f) for f, b, e in rows if b <= d <= e]
        assert got.get(number[d]) == (max(covering)[1] if covering else None)


def test_dictionary_gives_the_same_rows(spark):
    """Donors looked up are as those classified row by row; many distinct ones are not looked up; nulls are a value."""
    parents = spark.createDataFrame([("000000001", "P", "X")], "ein string, recipient string, party string")
    affiliated = spark.createDataFrame([("000000002", "000000001")], "ein string, parent_ein string")
    names = ["Smith, Ann", "Acme Inc.", "John Q Public", None, "", "DOE, JANE MD", "Fund (In-Kind)"]
    raw = [(e, "N", names[i % 7], [None, "N/A", "Acme"][i % 3], ["Retired", None, "na"][i % 5 % 3], "1.5", "20230105", "20230101", "20230331", "a", "c", "s", "z", str(i)) for i, e in enumerate(["000000001", "000000002", "000000003"] * 200)]
    cols = ["recipient_ein", "recipient_name", "contributor_name", "employer", "occupation", "amount", "date", "period_begin", "period_end", "address", "city", "state", "zipcode", "form_id"]
    table = spark.createDataFrame(raw, ", ".join(f"{c} string" for c in cols))
    plain = rollup.matched_rows(table, parents, affiliated)
    known = rollup.donor_dictionary(table, parents, affiliated)
    looked_up = rollup.matched_rows(table, parents, affiliated, known)
    assert plain.columns == looked_up.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, looked_up.collect())) and plain.count() == 400 and known.count() < 110
    assert rollup.donor_dictionary(table, parents, affiliated, share=0.01) is None
    assert rollup.donor_dictionary(table.limit(0), parents, affiliated) is None
