"""Connected components of a graph in a DataFrame, by alternating stars.

Each round turns every vertex's neighbours towards the smallest vertex seen. A round is two
aggregations (combined before the shuffle) and two joins of the edges with one row per vertex.
The aggregate is stored before it is joined, so that both sides of the join are plain shuffles and
adaptive execution can split the edges of a vertex that has very many. The number of rounds grows
with the logarithm of the longest path. Only edge counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import scratch


def _least(directed: DataFrame, name: str) -> DataFrame:
    """The smallest of u and its neighbours, per u."""
    return scratch.keep(directed.groupBy("u").agg(F.min(F.least("v", "u")).alias("m")), name)


def _ordered(edges: DataFrame) -> DataFrame:
    """Every edge once, the larger end first."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each u sends its larger neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, "large-least")
    moved = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    stored = scratch.keep(_ordered(moved), "large")
    scratch.drop(least)
    return stored


def _small_star(edges: DataFrame) -> DataFrame:
    """Each u sends its smaller neighbours, and itself, to the smallest one."""
    least = _least(edges, "small-least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    stored = scratch.keep(_ordered(moved.unionByName(own)), "small")
    scratch.drop(least)
    return stored


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """One row (vertex, component) per vertex of ``edges``; component is its smallest vertex.

    Rows with a null end and loops are ignored; repeated edges count once. No edges, no rows.
    """
    ends = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    stars, seen = scratch.keep(_ordered(ends), "edges"), None
    while True:
        # Stars around their smallest vertex are the only edge sets that both steps leave as they are.
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, large = state, _large_star(stars)
        scratch.drop(stars)
        stars = _small_star(large)
        scratch.drop(large)
    return stars.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
