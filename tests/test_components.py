import random

from donorloom.operators import components
from donorloom.operators.components import connected_components, grow_components
from donorloom.operators.shared import materialize


def test_grown_components_equal_a_full_run(spark):
    """Ten random batches, of new nodes, of links within and between what is known, null ends, loops and an empty one."""
    rng = random.Random(6)
    edges, known = [], spark.createDataFrame([], "node long, component long")
    for batch in range(10):
        most = 40 * (batch + 1)
        new = [] if batch == 4 else [(rng.randrange(most), rng.randrange(most)) for _ in range(18)] + [(None, 1), (2, None), (5, 5)]
        edges += new
        known = materialize(grow_components(known, spark.createDataFrame(new, "a long, b long")), "known")
        got = sorted(tuple(r) for r in known.collect())
        assert got == sorted(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert len(got) > 150 and len({c for _, c in got}) < len(got)


def test_rounds_end_with_the_stars(spark, monkeypatch):
    """What is stars already takes one round, and no other that would only show that nothing changes; repeated links and both
    directions of a link are one. A chain takes as many rounds as it needs."""
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name="step": written.append(name) or materialize(df, name))
    make = lambda links: connected_components(spark.createDataFrame(links, "a long, b long"))
    got = sorted(tuple(r) for r in make([(1, n) for n in range(2, 40)] * 2 + [(n, 50) for n in range(51, 60)] + [(3, 1), (None, 1), (7, 7)]).collect())
    assert got == [(n, 1) for n in range(1, 40)] + [(n, 50) for n in range(50, 60)]
    assert written == ["edges", "stars"]
    order = random.Random(2).sample(range(200), 200)
    assert sorted(tuple(r) for r in make(list(zip(order, order[1:]))).collect()) == [(n, 0) for n in range(200)]
    assert make([]).count() == 0


def test_names_are_nodes_like_numbers(spark):
    """Nodes are of whatever type the links have: names that are no numbers, and names that look like some."""
    names = ["BLUE WIDGET", "COLD ANVIL", "LARGE GEAR", "10", "9", "", "É"]
    links = [(names[0], names[1]), (names[2], names[1]), (names[3], names[4]), (names[5], names[6]), (None, "X"), ("Y", "Y")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {"BLUE WIDGET": "BLUE WIDGET", "COLD ANVIL": "BLUE WIDGET", "LARGE GEAR": "BLUE WIDGET", "10": "10", "9": "10", "": "", "É": ""}
