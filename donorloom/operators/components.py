"""Connected components on DataFrames: alternating large-star and small-star (Kiveris et al., SoCC 2014), and components that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorloom.operators.shared import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours, linked with the least of the node and its neighbours. As links go from the greater end ``u``
    to the lesser one ``v``, that is the least ``v`` of the node's own links, or the node itself where it has none."""
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    return (
        linked.filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _unsettled(edges: DataFrame) -> int:
    """Nodes with two lesser neighbours, or with a lesser and a greater one; without any, the links are stars around the least
    nodes, and a further round would change nothing."""
    lesser = edges.select("u", F.col("v").alias("lo"), F.col("v").alias("hi"), F.lit(False).alias("above"))
    none = F.lit(None).cast(edges.schema["v"].dataType)
    greater = edges.select(F.col("v").alias("u"), none.alias("lo"), none.alias("hi"), F.lit(True).alias("above"))
    each = lesser.union(greater).groupBy("u").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("above").alias("above"))
    return each.agg(F.count_if((F.col("lo") != F.col("hi")) | (F.col("lo").isNotNull() & F.col("above"))).alias("n")).first()["n"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node that has a link; ``component`` is the least node reachable.

    Null ends and self-links are ignored; repeated links count once; no links give an empty table.
    Each round is written to the shared folder and the one before it deleted, so lineage and disk do not grow and nothing
    reaches the driver but a count. Rounds end when every node has one lesser neighbour at most, which has none: a count of
    the nodes for which that does not hold takes less than half of the exchanges of another round. Raises if ``max_rounds`` is
    not enough.
    """
    now = materialize(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")),
        "edges",
    )
    for _ in range(max_rounds):
        before, now = now, materialize(_small_star(_large_star(now)), "stars")
        discard(before)
        if _unsettled(now) == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def grow_components(known: DataFrame, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` of ``known`` (the same columns) after links are added, without touching the links that made it.

    Each component that is known stands for its nodes: only the new links between different components, and between nodes that
    are new, go through the rounds. Nodes of components that stay as they are keep their row. As in a full run, ``component`` is the
    least node reachable. Null ends and self-links are ignored; ``known`` may be empty.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u != v")
    of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_own"))
    met = ends.join(of("u"), "u", "left").join(of("v"), "v", "left")
    met = materialize(met.select("u", "v", F.coalesce("u_own", "u").alias("a"), F.coalesce("v_own", "v").alias("b")), "new-links")
    merged = materialize(connected_components(met.select("a", "b"), max_rounds=max_rounds), "merged")
    root = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    old = known.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    fresh = met.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("a").alias("own")), F.struct(F.col("v").alias("node"), F.col("b").alias("own")))).alias("x"))
    fresh = fresh.select("x.*").filter("node = own").distinct().join(known.select("node"), "node", "left_anti")
    return old.union(fresh.join(root, fresh["own"] == root["component"], "left").select("node", F.coalesce("root", "own").alias("component")))
