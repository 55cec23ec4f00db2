import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from donorloom.functions.address import address_form
from donorloom.functions.similarity import indel_ratio, ratios
from donorloom.operators import clusters, similar


def block(rng, n, words=60):
    """Names that all begin alike, many of them a few characters from another."""
    parts = ["".join(rng.choices("ABCDEFGHILMNORSTU", k=rng.randint(2, 7))) for _ in range(words)]
    names = []
    while len(names) < n:
        name = "UNITED " + " ".join(rng.choices(parts, k=rng.randint(1, 4)))
        names.append(name)
        for _ in range(rng.randint(0, 3)):
            s = list(rng.choice(names[-4:]))
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(5, len(s) + 1)
                if rng.random() < 0.5 and at < len(s):
                    del s[at]
                else:
                    s.insert(at, rng.choice("ABCDEFÉ1 "))
            names.append("".join(s))
    return sorted(set(names))[:n]


def brute(names):
    own = [n for n in names if len(n) >= 15 and len(n.split()) >= 2]
    pairs = [(a, b) for a, b in combinations(sorted(set(own)), 2) if a[:5] == b[:5]]
    found = {}
    for (a, b), r in zip(pairs, ratios([a for a, _ in pairs], [b for _, b in pairs]), strict=True):
        t = 92.0 if min(len(a), len(b)) < 20 else 90.0
        if r >= t - 5:
            found[a, b] = (round(float(r), 6), t)
    return found


def names_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "canonical string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segment_index_loses_no_pair(spark, seed):
    """The index alone, blocks compared whole, and both are equal to comparing all pairs; other blocks, short names, null."""
    rng = random.Random(seed)
    names = block(rng, 350) + ["NATIONAL BANK NUMBER " + str(i) for i in range(40)] + ["UNITED", "", None, "UNITED A B", "X" * 30, "LONG " * 60, "LONG " * 58 + "LONGER"]
    want = brute([n for n in names if n])
    assert len(want) > 150
    for most in (0, 100, 10_000):
        got = {(r["a"], r["b"]): (round(r["ratio"], 6), r["threshold"]) for r in clusters.fuzzy_pairs(names_of(spark, names), most).collect()}
        assert got == want


def test_segment_index_compares_few(spark):
    """The part of a block's pairs that is compared, by the index, by counts of characters, and by neither."""
    names = block(random.Random(7), 2000, words=400)
    table = names_of(spark, names).withColumn("block", F.substr("canonical", F.lit(1), F.lit(5))).filter(F.length("canonical") >= 15)
    n = table.count()
    with_index = similar.similar_candidates(table, 0).count()
    by_counts = similar.similar_candidates(table, 10_000).count()
    assert with_index < 0.02 * n * (n - 1) / 2 and with_index <= by_counts < 0.2 * n * (n - 1) / 2


def test_counts_bound_the_ratio(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("AB1é 0", k=rng.randint(0, 12))), "".join(rng.choices("AB1é 0ü", k=rng.randint(0, 12)))) for _ in range(400)]
    x, y = F.col("x"), F.col("y")
    got = spark.createDataFrame(rows, "x string, y string").select(similar.ratio_bound(similar.letter_counts(x), similar.letter_counts(y)).alias("most"), indel_ratio(x, y).alias("ratio")).collect()
    assert all(r["most"] >= r["ratio"] - 1e-9 for r in got) and sum(r["most"] < 75 for r in got) > 50


def test_address_edges_compare_few(spark):
    """Addresses of similar donors: as all pairs of forms decide, though few are compared."""
    rng = random.Random(9)
    street = lambda: f"{rng.randint(1, 40)} {rng.choice(['Main', 'Maine', 'Oak Hill', 'Far West', 'Jefferson Davis'])} {rng.choice(['St', 'Street', 'Rd', 'Suite 3', 'Suite 4'])}"
    names = [f"N{i:02}" for i in range(40)]
    places = [(n, street(), rng.choice(["Albany", "Albani", "New-York", "Buffalo", ""]), rng.choice(["NY", "NJ"])) for n in names for _ in range(3)]
    at = spark.createDataFrame([*places, ("N01", "", "Albany", "NY")], "donor_upper string, street string, city string, state string")
    named = spark.createDataFrame([(n, n) for n in names], "donor string, canonical string")
    pairs = spark.createDataFrame([(a, b, 80.0, 90.0) for a, b in combinations(names, 2)], "a string, b string, ratio double, threshold double")
    got = {(r["a"], r["b"]) for r in clusters.address_edges(pairs, named, at).collect()}
    forms = [(r["n"], r["f"]) for r in at.select(F.col("donor_upper").alias("n"), address_form(F.struct("street", "city", "state")).alias("f")).collect()]
    forms = [(n, f) for n, f in forms if f["street"]]
    want = set()
    for (a, x), (b, y) in [(p, q) for p in forms for q in forms if p[0] < q[0] and p[1]["state"] == q[1]["state"]]:
        city = not x["city"] or not y["city"] or ratios([x["city"]], [y["city"]])[0] >= 80
        if city and ratios([x["street"]], [y["street"]])[0] >= 75 and (x["part"] is None or y["part"] is None or x["part"] == y["part"]):
            want.add((a, b))
    assert got == want and want
    form = lambda s: spark.createDataFrame([(f["street"], f["part"], f["city"], f["state"]) for _, f in forms], "street string, part string, city string, state string").select(F.struct("*").alias(s), *(similar.letter_counts(F.col(c)).alias(f"{s}_{c}") for c in ("street", "city")))
    compared = clusters.address_candidates(form("x").crossJoin(form("y"))).count()
    assert compared < 0.4 * len(forms) ** 2


def test_address_edges_read_their_rows_once(spark):
    """what pairs and addresses are made of is read once, however often their tables are."""
    read = {"pairs": spark.sparkContext.accumulator(0), "at": spark.sparkContext.accumulator(0)}

    def counting(df, name):
        def run(batches, own=read[name]):
            for b in batches:
                own.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    names = [f"N{i:02}" for i in range(12)]
    named = spark.createDataFrame([(n, n) for n in names], "donor string, canonical string")
    places = [(n, f"{3 * i + j} Main St{['', ' Suite 1', ' Suite 2'][i % 3]}", "Albany", "NY") for i, n in enumerate(names) for j in range(6)]
    at = spark.createDataFrame(places, "donor_upper string, street string, city string, state string")
    pairs = spark.createDataFrame([(a, b, 80.0, 90.0) for a, b in combinations(names, 2)], "a string, b string, ratio double, threshold double")
    got = clusters.address_edges(counting(pairs, "pairs"), named, counting(at, "at")).collect()
    assert len(got) == len(set(got)) > 0
    assert {name: n.value for name, n in read.items()} == {"pairs": len(names) * (len(names) - 1) // 2, "at": len(places)}
