"""Connected components of a graph of 64-bit nodes, by alternating large and small stars.

Each round is a few joins and minimums over the edges; a hot node's edges are reduced before the shuffle and its join is
one that Spark splits by itself. Rounds are written tables in the shared folder, so a lost executor costs one round; a round's
tables are deleted when the next one is written.

Edges with a null end, and those of a node to itself, join nothing. Repeated edges count once. No edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, materialize, recorded


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """``pairs`` (a, b): b is a neighbour of a. Links the larger (large) or all (small) neighbours to the least of them and a."""
    least = pairs.groupBy(F.col("a").alias("m_a")).agg(F.min("b").alias("m"))
    joined = pairs.join(least, F.col("a") == F.col("m_a")).withColumn("m", F.least("m", "a"))
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    both = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return both.filter(F.col("a") != F.col("b"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: bigint) to one row for each node that has an edge to another: node, label (the least node it can reach)."""
    down = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    with recorded(old := []):
        now = materialize(down, "edges")
    state = _state(now)
    while state[0]:
        with recorded(made := []):
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            wide = materialize(_star(both, True).distinct(), "large-star")
            now = materialize(_star(wide, False).distinct(), "small-star")
        drop(edges.sparkSession, [*old, made[0]])
        old, was, state = made[1:], state, _state(now)
        if was == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
