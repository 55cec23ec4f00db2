import random

import pytest

from donorloom.operators import reconcile
from donorloom.operators.prefixes import prefix_pairs


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_prefix_pairs_equal_brute_force(spark, parts):
    """As many ranges as texts or one; beginnings that are texts themselves or not, that end a word or not, of a run of ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for seed in range(3):
            rng = random.Random(seed)
            some = lambda n: ["".join(rng.choices("AB é", k=rng.randint(0, 7))) for _ in range(n)]
            begins = {(t, len(t) % 2 == 0) for t in {*some(40), "A", "AB", "B"}}
            texts = some(150) + ["AB" * n for n in range(30)] + ["A B", "", None, "AB"]
            got = prefix_pairs(spark.createDataFrame([*begins, (None, True), ("", True)], "text string, free boolean"), spark.createDataFrame([(t,) for t in texts], "text string"))
            want = {(s, t) for s, free in begins for t in texts if s and t and t.startswith(s) and (free or t == s or t[len(s)] == " ")}
            rows = [(r["shorter"], r["longer"]) for r in got.collect()]
            assert len(rows) == len(set(rows)) and set(rows) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert prefix_pairs(spark.createDataFrame([], "text string, free boolean"), spark.createDataFrame([("A",)], "text string")).collect() == []


def test_companies_by_prefix(spark):
    """The longest beginning decides, whichever side it is on."""
    owned = spark.createDataFrame([("NORTHERN GAS", "one"), ("NORTHERN GAS PIPE", "two"), ("WALGREENS", "three"), ("WALGREENSBORO", "four"), ("SHORT", "five")], "variant string, donor string")
    companies = spark.createDataFrame([("Northern Gas Pipe Line West",), ("Walgreens Boots",), ("Walgreensb",), ("Short",), ("Northern Gas",)], "company string")
    got = {r["company"]: r["donor"] for r in reconcile.match_prefix(companies, owned).select("company", "donor").collect()}
    assert got == {"Northern Gas Pipe Line West": "two", "Walgreens Boots": "three", "Northern Gas": got["Northern Gas"]}
    assert got["Northern Gas"] == "one"
