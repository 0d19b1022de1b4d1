"""Connected components of an edge table, by repeated contraction.

Each round every node takes the smallest id among itself and its neighbours,
edges are renamed accordingly and the ones inside a node vanish. With ids that
do not follow the graph's shape (hashes) the edges shrink by a constant factor
a round. Nothing but edge counts reaches the driver; every round is written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordergate.llm.common import discard, store


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name of each node, renamed distinct edges)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    names = store(both.groupBy("a").agg(F.least("a", F.min("b")).alias("name")).withColumnRenamed("a", "node"), "names")
    left = names.select(F.col("node").alias("a"), F.col("name").alias("x"))
    right = names.select(F.col("node").alias("b"), F.col("name").alias("y"))
    renamed = (edges.join(left, "a").join(right, "b").where("x != y")
               .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return names, store(renamed, "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component's id is
    the id of one of its nodes."""
    edges = store(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        names, renamed = _contract(edges)
        discard(edges)
        rounds.append(names)
        edges = renamed
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[-1].withColumnRenamed("name", "component")
    for names in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("name"), "component")
        whole = store(names.join(later, "name", "left")
                      .select("node", F.coalesce("component", "name").alias("component")), "components")
        discard(found)
        discard(names)
        found = whole
    return found
