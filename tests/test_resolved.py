from pyspark.sql import functions as F

from donorloom.operators import clusters, compare, components, reconcile

DONORS = ["Acme Widget Makers Inc", "Acme Widgets Makers", "Acme Widget Makers West", "Zeta", "Omega Foods, LLC", "Lone Star"]


def groups_of(spark):
    return spark.createDataFrame([(0, "Zeta"), (0, "Omega Foods")], "group_id int, name string")


def resolved(spark):
    """Two rows a donor, with the clusters of all links between names."""
    gave = [(d, "Non-Individual", r, 100.0 * (i + 1) + (r == "R2")) for i, d in enumerate(DONORS) for r in ("R1", "R2")]
    rows = spark.createDataFrame(gave, "donor string, donor_type string, recipient string, amount double")
    return compare.attach_clusters(rows, clusters.cluster_donors(rows.select("donor"), groups=groups_of(spark)))


def test_comparison_of_resolved_clusters(spark):
    """one row a cluster, its sums over all its donors."""
    rows = compare.compare(resolved(spark), ["R1"], ["R2"], 500, 700)["Non-Individual"].collect()
    assert {(r["canonical_donor"], r["display_name"], r["R1"], r["R2"]) for r in rows} == {("ACME WIDGET MAKERS", "Acme Widget Makers Inc", 600.0, 603.0), ("LONE STAR", "Lone Star", 600.0, 601.0)}


def test_every_kind_of_link(spark):
    """validated groups and addresses of borderline pairs join names that nothing else does."""
    named = ["National Paper Mill East", "National Paper Mall Ecse", "National Paper Hull Ecso", "Zeta", "Lone Star", "Quiet Lake Inc"]
    table = spark.createDataFrame([(d,) for d in named], "donor string")
    at = [("NATIONAL PAPER MILL EAST", "1 Main St", "X", "NY"), ("NATIONAL PAPER MALL ECSE", "1 Main Street", "X", "NY"), ("NATIONAL PAPER HULL ECSO", "77 Far Rd", "Y", "TX")]
    addresses = spark.createDataFrame(at, "donor_upper string, street string, city string, state string")
    validated = spark.createDataFrame([("LONE STAR", "g"), ("QUIET LAKE INC", "g")], "donor_upper string, donor_group string")
    got = {r["donor"]: r["canonical_donor"] for r in clusters.cluster_donors(table, addresses, validated, groups_of(spark)).collect()}
    assert got == dict(zip(named, ["NATIONAL PAPER MALL ECSE"] * 2 + ["NATIONAL PAPER HULL ECSO", "ZETA", "LONE STAR", "LONE STAR"], strict=True))


def test_grown_clusters_of_names(spark):
    """links between names that come one by one give the clusters of a full run."""
    named = clusters.canonicals(spark.createDataFrame([(d,) for d in DONORS], "donor string"))
    links = sorted(tuple(r) for r in clusters.donor_links(named, groups=groups_of(spark)).collect())
    assert len(links) >= 3
    grown = components.connected_components(spark.createDataFrame(links[:1], "a string, b string"))
    for link in links[1:]:
        grown = components.grow_components(grown, spark.createDataFrame([link], "a string, b string"))
    got = {r["donor"]: r["canonical_donor"] for r in clusters.label_donors(named, grown).collect()}
    assert got == dict(zip(DONORS, ["ACME WIDGET MAKERS"] * 3 + ["ZETA", "ZETA", "LONE STAR"], strict=True))


def test_sheet_of_resolved_clusters(spark):
    """a company's total is that of the whole cluster its name belongs to."""
    rows = resolved(spark)
    sides = [F.sum(F.when(F.col("recipient") == r, F.col("amount"))).alias(f"db_{s}") for s, r in (("a", "R1"), ("b", "R2"))]
    sums = rows.groupBy("canonical_donor").agg(*sides)
    donors = sums.join(compare.display_names(rows), "canonical_donor").select(F.col("display_name").alias("donor"), "db_a", "db_b")
    key = spark.createDataFrame([("ACME WIDGET MAKERS", 600.0, 603.0), ("Omega Foods Co", 900.0, 9000.0)], "company string, xl_a double, xl_b double")
    got = {r["company"]: (r["matched_donor"], r["db_a"], r["db_b"], r["a_match"], r["b_match"]) for r in reconcile.qc_sheet(key, donors).collect()}
    assert got == {"ACME WIDGET MAKERS": ("Acme Widget Makers Inc", 600.0, 603.0, "Yes", "Yes"), "Omega Foods Co": ("Omega Foods, LLC", 900.0, 902.0, "Yes", "No")}
