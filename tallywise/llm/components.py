"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Rows that a task writes at least, where a table is small: small graphs go through few tasks.
ROWS_A_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b: long): component is the smallest id that can be reached.

    Each round every node takes its smallest neighbour's name and edges are renamed, which at least halves the nodes
    of each component; the rounds' names are then followed back. Rounds grow with the logarithm of a component's size.
    No edges give no rows; loops and repeated edges are harmless.
    """
    nodes = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    names: list[DataFrame] = []
    while left := edges.count():
        tasks = -(-2 * left // ROWS_A_TASK)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        name = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("name")).coalesce(tasks), f"names{len(names)}")
        one = edges.join(name.select(F.col("id").alias("a"), F.col("name").alias("na")), "a")
        two = one.join(name.select(F.col("id").alias("b"), F.col("name").alias("nb")), "b").where("na <> nb")
        edges = materialise(two.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct().coalesce(tasks), f"edges{len(names) + 1}")
        names.append(name)
    out = nodes.select("id", F.col("id").alias("component"))
    for name in names:
        step = name.select(F.col("id").alias("component"), "name")
        out = out.join(step, "component", "left").select("id", F.coalesce("name", "component").alias("component"))
    return materialise(out, "components")


def extended(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of the edges that gave ``known`` (id, component) and of further ones: only those components that
    the new edges touch are joined."""
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    rows = materialise(ends.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "ends")
    moved = edges.join(rows.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(rows.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    joined = components(moved.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("now"))
    all_ = known.unionByName(rows.join(known, "id", "left_anti"))
    return materialise(all_.join(joined, "component", "left").select("id", F.coalesce("now", "component").alias("component")), "components")
