"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every neighbour of a node is linked to the least node of the neighbourhood.

    ``large`` moves the neighbours above the node, otherwise the node itself and those below. A node
    with very many neighbours meets one row of least neighbours, so its rows may stand in many tasks.
    """
    if large:
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    moved = sides.join(least, "a")
    if large:
        moved = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        own = least.select("a", F.col("low").alias("b"))
        moved = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).union(own)
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    Each round is written to the shared folder; only two numbers a round reach the driver.
    """
    edges = edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct()
    last = None
    while True:
        edges = stored(_star(_star(edges, True), False), "stars")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == last or not state[0]:
            break
        last = tuple(state)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
