import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from donorloom.operators import addresses, aliases, clusters, compare, filters, reconcile, reports, rollup, search, supersession
from donorloom.operators.components import connected_components
from donorloom.sources import filings, sinks


def filing_rows(spark, rows):
    cols = "recipient_ein string, form_id string, period_begin string, period_end string, day string, tag string"
    return spark.createDataFrame(rows, cols).withColumn("date", F.try_to_timestamp("day", F.lit("yyyyMMdd")))


def test_supersession_exceptions(spark):
    q3, h2 = ("20230701", "20230930"), ("20230701", "20231231")
    rows = [
        ("A", "1", *q3, "20230815", "original"), ("A", "2", *h2, "20230815", "amended"), ("A", "2", *h2, "20230815", "amended"), ("A", "1", *q3, None, "undated"),
        ("A", "1", *q3, "20220101", "uncovered"), ("A", "x9", *q3, "20230815", "bad form"), ("A", "2", *h2, "20231105", "own"), ("A", "1", *q3, "20231105", "outside own"),
        ("B", "5", *q3, "20230815", "lone"), ("B", "zz", *q3, "20230815", "lone bad"), ("C", "7", *q3, "20230701", "tie low"), ("C", "8", *q3, "20230701", "tie high"),
        ("D", "11", "x", "", "20230815", "no period"), ("D", "12", *q3, "20230815", "covers"),
    ]
    registry = filings.registry(spark.createDataFrame([("1", "2023-10-01 00:00:00"), ("2", "20240101"), ("2", "2022"), (None, "1")], "form_id string, insert_dt string"))
    df = filing_rows(spark, rows)
    kept = supersession.drop_superseded(df, registry)
    assert sorted(r["tag"] for r in kept.collect()) == sorted(["amended", "amended", "undated", "uncovered", "own", "lone", "lone bad", "tie high", "covers"])
    assert sorted(r["tag"] for r in supersession.drop_superseded(kept, registry).collect()) == sorted(r["tag"] for r in kept.collect())
    without = supersession.drop_superseded(df, registry.limit(0))
    assert "amended" in {r["tag"] for r in without.collect()}
    assert supersession.drop_superseded(df.limit(0), registry).count() == 0


def test_components_equal_search(spark):
    rng = random.Random(1)
    for n, m, parts in ((60, 40, 1), (200, 150, 8), (30, 0, 2)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(n, n + 40)] if m else []) + [(None, 3), (4, 4)]
        df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
        got = {r["node"]: r["component"] for r in connected_components(df).collect()}
        parent = {}

        def root(i):
            while parent.setdefault(i, i) != i:
                i = parent[i]
            return i

        for x, y in edges:
            if x is not None and x != y:
                p, q = sorted((root(x), root(y)))
                parent[q] = p
        assert got == {i: root(i) for i in parent}


def test_tables_between_steps_can_be_deleted(spark):
    from pathlib import Path

    from donorloom.operators import shared

    tables = [shared.materialize(spark.range(3), "kept") for _ in range(2)]
    assert all(Path(t._table.removeprefix("file:")).exists() and t.count() == 3 for t in tables)
    shared.discard(tables[0])
    assert not Path(tables[0]._table.removeprefix("file:")).exists() and tables[1].count() == 3
    assert shared.sweep(spark) >= 1 and not Path(tables[1]._table.removeprefix("file:")).exists() and shared.sweep(spark) == 0


def names_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "canonical string")


def test_prefix_edges_equal_brute_force(spark):
    fixed = ["ACME GAS", "ACME GAS WEST", "WALGREENS", "WALGREENS BOOTS", "WALGREEN", "NORTHERN GAS", "NORTHERN GASOLINE"]
    rng = random.Random(2)
    names = sorted({*fixed, *("".join(rng.choices("AB ", k=rng.randint(1, 14))).strip() for _ in range(400))} - {""})
    got = {(r["a"], r["b"]) for r in clusters.prefix_edges(names_of(spark, names)).collect()}
    want = set()
    for x, y in combinations(names, 2):
        s, t = sorted((x, y), key=len)
        if len(s) >= 7 and len(t) > len(s) and t.startswith(s):
            w = len(s.split())
            if (w >= 2 and len(s) >= 10) or (w == 1 and t.startswith(s + " ")):
                want.add((s, t))
    assert got == want and ("WALGREENS", "WALGREENS BOOTS") in got and ("NORTHERN GAS", "NORTHERN GASOLINE") in got and ("ACME GAS", "ACME GAS WEST") not in got


def test_clusters_whatever_the_partitions(spark):
    donors = ["Acme Widget Makers Inc", "ACME Widget Makers", "Acme Widgets Makers", "Zeta", "Zeta Holdings", "Omega Foods", "Alpha Beta", "!!", "(x)", None]
    groups = spark.createDataFrame([(0, "Zeta"), (0, "Omega Foods")], "group_id int, name string")
    validated = spark.createDataFrame([("ALPHA BETA", "g"), ("ZETA HOLDINGS", "g")], "donor_upper string, donor_group string")
    table = spark.createDataFrame([(d,) for d in donors], "donor string")
    results = []
    for parts in (1, 5):
        got = clusters.cluster_donors(table.repartition(parts), donor_groups=validated, groups=groups)
        results.append({r["donor"]: r["canonical_donor"] for r in got.collect()})
    assert results[0] == results[1]
    r = results[0]
    assert r["Acme Widget Makers Inc"] == r["ACME Widget Makers"] == r["Acme Widgets Makers"] == "ACME WIDGET MAKERS"
    assert r["Zeta"] == r["Omega Foods"] == "ZETA" and r["Alpha Beta"] == r["Zeta Holdings"] and r["!!"] == "!!" and r["(x)"] == ""


def test_salted_blocks_find_the_same_pairs(spark):
    names = names_of(spark, [f"NATIONAL BANK NUMBER {i}" for i in range(40)])
    pairs = [{(r["a"], r["b"]) for r in clusters.fuzzy_pairs(names, n).collect()} for n in (2000, 7)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 100


def test_address_edges(spark):
    named = spark.createDataFrame([("One", "ONE"), ("Two", "TWO"), ("Six", "SIX")], "donor string, canonical string")
    at = spark.createDataFrame([("ONE", "1 Main St", "X", "NY"), ("ONE", "9 Far Rd", "Y", "TX"), ("TWO", "1 Main Street", "X", "NY"), ("SIX", "", "X", "NY")], "donor_upper string, street string, city string, state string")
    pairs = spark.createDataFrame([("ONE", "TWO", 88.0, 92.0), ("ONE", "SIX", 88.0, 92.0), ("SIX", "TWO", 95.0, 92.0)], "a string, b string, ratio double, threshold double")
    assert [(r["a"], r["b"]) for r in clusters.address_edges(pairs, named, at).collect()] == [("ONE", "TWO")]
    assert [(r["a"], r["b"]) for r in clusters.fuzzy_edges(pairs).collect()] == [("SIX", "TWO")]


def test_search_tiers(spark):
    donors = spark.createDataFrame([(d,) for d in ("CVS Pharmacy", "MCVS Corp", "IBM", "International Business Machines", "Walgreens Boots", "Farmers Mutual", "Acme Widget", "Philip Morris USA", "Altria", None)], "donor string")
    terms = spark.createDataFrame([("CVS",), ("International Business Machines Inc",), ("Walgreens",), ("Farmers Mutual of Iowa",), ("Acme Wijget",), ("Altria Client Services",), (" ",)], "query string")
    got = {(r["query"], r["donor"]): (r["score"], r["match_type"]) for r in search.search_donors(terms, donors, aliases.sample_groups(spark)).collect()}
    assert got["CVS", "CVS Pharmacy"] == (96.0, "prefix match") and got.get(("CVS", "MCVS Corp"), (0, ""))[1] != "prefix match"
    assert got["International Business Machines Inc", "International Business Machines"] == (100.0, "exact match") and got["International Business Machines Inc", "IBM"] == (93.0, "acronym match")
    assert got["Walgreens", "Walgreens Boots"] == (96.0, "prefix match") and got["Acme Wijget", "Acme Widget"][1] == "fuzzy match"
    assert got["Farmers Mutual of Iowa", "Farmers Mutual"] == (96.0, "prefix match")
    assert got["Altria Client Services", "Philip Morris USA"] == got["Altria Client Services", "Altria"] == (99.0, "alias match")


def test_first_search_name_decides(spark):
    found = spark.createDataFrame([("q", 1, "d", 1, 100.0, "exact match"), ("q", 0, "d", 4, 73.0, "fuzzy match"), ("q", 0, "d", 2, 96.0, "prefix match")], "query string, pos int, donor string, tier int, score double, match_type string")
    assert [(r["score"], r["match_type"]) for r in search.first_match(found).collect()] == [(96.0, "prefix match")]


def test_address_confidence(spark):
    rows = [("Strong", "1 Main Street"), ("Weak", "1 Main St"), ("Other", "1 Main St."), ("Half", "1 Main St"), ("Crowd", "9 Tower Road")] + [(f"C{i}", "9 Tower Rd") for i in range(6)]
    table = spark.createDataFrame([(d, s, "NY", "10001", True) for d, s in rows], "donor string, street string, state string, zip_code string, is_company boolean")
    index = addresses.address_index(table)
    assert {r["donor"] for r in addresses.shared_keys(index).collect()} == {"Strong", "Weak", "Other", "Half"}
    matches = spark.createDataFrame([("q", "Strong", 96.0, "prefix match"), ("q", "Weak", 80.0, "fuzzy match"), ("q", "Half", 85.5, "fuzzy match"), ("q", "Crowd", 90.0, "x")], "query string, donor string, score double, match_type string")
    got = {r["donor"]: (r["score"], r["match_type"]) for r in search.address_confidence(matches, index).collect()}
    assert got == {"Strong": (96.0, "prefix match"), "Weak": (88.0, "address-confirmed fuzzy match"), "Half": (85.5, "fuzzy match"), "Crowd": (90.0, "x")}
    assert [tuple(r) for r in search.colocated_donors(matches, index).collect()] == [("q", "Other", 85.0, "address match")]


def test_comparison(spark):
    rows = spark.createDataFrame(
        [("a1", "A", "Individual", "R1", 600.0), ("a2", "A", "Individual", "R1", 500.0), ("a2", "A", "Individual", "R3", 1.0), ("b", "B", "Individual", "R1", 5000.0), ("b", "B", "Individual", "R2", 1.0), ("c", "C", "Individual", "R1", 10.0), (None, None, "Individual", "R1", 9999.0)],
        "donor string, canonical_donor string, donor_type string, recipient string, amount double",
    )
    out = compare.compare(rows, ["R1"], ["R2"])
    assert [r[0] for r in out["qualifying"].collect()] == ["A"] and {r["display_name"] for r in out["names"].collect()} == {"a2"}
    assert sorted(r[0] for r in compare.qualifying(rows, ["R1"], []).collect()) == ["A", "B"]
    assert [(r["R1"], r["R2"], r["total"]) for r in out["Individual"].collect()] == [(1100.0, 0.0, 1100.0)] and out["Non-Individual"].count() == 0
    assert sorted(r["donor"] for r in out["line_items"].collect()) == ["a1", "a2"]


def test_statuses(spark):
    rows = spark.createDataFrame([(0.0, 0.99), (0.0, 1.0), (0.0, 2000.0), (0.0, 2000.01)], "db double, xl double")
    status = reconcile.match_status(F.col("db"), F.col("xl"))
    assert [r[0] for r in rows.orderBy("xl").select(status).collect()] == ["Yes", "Close match", "Close match", "No"]
    both = [r[0] for r in rows.orderBy("xl").select(reconcile.combined_status(status, F.lit("Close match"))).collect()]
    assert both == ["Close match", "Close match", "Close match", "No"]


def test_qc_sheet(spark):
    donors = spark.createDataFrame([("Acme Widget Inc", 100.0, 5.0), ("Walgreens Boots Alliance", 7.0, 0.0), ("Zed", 1.0, 1.0)], "donor string, db_a double, db_b double")
    key = filings.answer_key(spark.createDataFrame([("ACME WIDGET", "$100", "(5)"), ("Walgreens", "7.5", "0"), ("Nobody", "9,000", ""), ("", "1", "1"), ("Zero", "0", "x")], "n string, p string, q string"), "n", "p", "q")
    got = {r["company"]: r for r in reconcile.qc_sheet(key, donors).collect()}
    assert set(got) == {"ACME WIDGET", "Walgreens", "Nobody"}
    assert got["ACME WIDGET"]["both_match"] == "Yes" and got["Walgreens"]["matched_donor"] == "Walgreens Boots Alliance"
    assert got["Nobody"]["matched_donor"] == "(none)" and got["Nobody"]["a_match"] == "No" and got["Nobody"]["b_match"] == "Yes"
    sheet = reconcile.qc_sheet(key, donors).withColumn("year", F.lit(2023))
    now = reconcile.summarize_qc(sheet, "year")
    assert {(r["metric"], r["delta"]) for r in reconcile.qc_delta(now, now).collect()} == {(m, 0.0) for m in ("both_yes", "a_yes", "b_yes", "neither")}


def test_filters(spark):
    rows = spark.createDataFrame([("x", "Individual", "NY", "New York", 5.0, "2023-01-01"), ("x", "Individual", "NY", "New York", 5.0, "2023-01-01"), ("y", "Individual", "NJ", "a.b", 50.0, None)], "donor string, donor_type string, state string, city string, amount double, d string")
    rows = rows.withColumns({"date": F.to_timestamp("d"), "recipient": F.lit("R"), "recipient_party": F.lit("P"), "employer": F.lit(""), "occupation": F.lit("")})
    count = lambda **k: filters.search_contributions(rows, filters.Search(**k)).count()
    assert count() == 2 and count(dedupe=False) == 3 and count(start="2023-01-01", end="2023-01-01") == 1 and count(city="A.B") == 1 and count(city="w.y") == 0
    assert count(city="w.y", regex=True) == 1 and count(least=6) == 1 and count(most=6) == 1 and count(states=["NJ"]) == 1
    assert filters.of_donors(rows, rows.filter("donor = 'y'")).count() == 1


def test_sources_and_sinks(spark, tmp_path):
    import gzip

    raw = tmp_path / "raw.csv.gz"
    with gzip.open(raw, "wb") as f:
        f.write(b'form_id,recipient_ein,recipient_name,contributor_name,amount,date,period_end\n1,52-1304889,Org,"Smith, ""Al""\nJr",5,20230101,20230331\n2,521304889,Org,Caf\xe9 Inc,x,,20230331\n')
    rows = filings.read_raw_contributions(spark, str(raw))
    assert rows.count() == 2 and rows.columns == list(filings.RAW_COLUMNS) and rows.filter(F.col("contributor_name").contains("\n")).count() == 1
    parents = spark.createDataFrame([("521304889", "DGA", "D")], "ein string, recipient string, party string")
    matched = rollup.matched_rows(rows, parents, spark.createDataFrame([], "ein string, parent_ein string"))
    clean = matched.select(*rollup.CONTRIBUTION_COLUMNS)
    sinks.write_contributions(clean, str(tmp_path / "c"))
    assert filings.read_contributions(spark, str(tmp_path / "c")).count() == 2
    sinks.write_recipient_summary(reports.recipient_summary(clean), str(tmp_path / "s"))
    sinks.export_line_items(reports.line_items(clean, None), str(tmp_path / "l"))
    with pytest.raises(ValueError, match="more than 1"):
        sinks.export_line_items(reports.line_items(clean, None), str(tmp_path / "m"), cap=1)
    sinks.export_summary(reports.recipient_breakdown(clean), str(tmp_path / "b"))
    for name, text in (("o", '{"A B": "g", "": "h"}'), ("l", '[{"donor": " a b ", "donor_group": "g"}, {"donor": "x", "donor_group": ""}]')):
        (tmp_path / f"{name}.json").write_text(text)
        assert [tuple(r) for r in filings.read_donor_groups(spark, str(tmp_path / f"{name}.json")).collect()] == [("A B", "g")]
    sinks.write_donor_groups(filings.read_donor_groups(spark, str(tmp_path / "o.json")), str(tmp_path / "g"))
    (tmp_path / "reg.csv").write_text("form_id,insert_dt\n1,2023-01-02\n1,2024\n")
    assert [tuple(r) for r in filings.read_form_registry(spark, str(tmp_path / "reg.csv")).collect()] == [("1", 20240000000000)]
    (tmp_path / "key.csv").write_text("Company Name,D,R\nAcme,$5,0\n")
    key = filings.read_answer_key(spark, str(tmp_path / "key.csv"), "Company Name", "D", "R")
    sheet = reconcile.qc_sheet(key, spark.createDataFrame([("Acme", 5.0, 0.0)], "donor string, db_a double, db_b double")).withColumn("year", F.lit(2023))
    sinks.write_qc_sheet(sheet, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_stream_totals(spark, tmp_path):
    from donorloom.streaming.filings import raw_stream, running_totals

    rows = [("521304889", "Org", "Acme Inc", "", "", "10.10", "20230101", "", "20230331", "", "", "", "", "1"), ("521304889", "Org", "Acme Inc", "", "", "0.20", "20240101", "", "20230331", "", "", "", "", "1")]
    spark.createDataFrame(rows, filings.RAW_SCHEMA).write.parquet(str(tmp_path / "in"))
    parents = spark.createDataFrame([("521304889", "DGA", "D")], "ein string, recipient string, party string")
    totals = running_totals(raw_stream(spark, str(tmp_path / "in")), parents, spark.createDataFrame([], "ein string, parent_ein string"))
    q = totals.writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["year"], r["total_amount"], r["transactions"]) for r in spark.table("totals").collect()) == [(2023, 10.1, 1), (2024, 0.2, 1)]
