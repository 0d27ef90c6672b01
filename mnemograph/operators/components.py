"""Connected components of an undirected graph, as alternating star contractions.

Each round is two groupings by node with a minimum (combined on the map side) and two
joins. No neighbourhood is ever gathered in one task: a hub's edges stay rows, and the
join that sends the hub's minimum to them is split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.session import cut, unpriced


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours to the smallest node in reach.

    ``pairs`` holds (u, v). For the large star it holds both directions and only larger
    neighbours move; for the small star it holds u > v and all neighbours move.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(unpriced(least), "u")
    if larger_only:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    ``component`` is the smallest node of the component. Edges with a null end and
    self-loops are ignored, repeated edges count once; without edges the result is empty.
    Nodes without any edge are the caller's to add. Raises ``RuntimeError`` if the
    contraction has not settled after ``max_rounds`` rounds.
    """
    base = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(
        F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    )
    current = cut(base.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stamp = F.struct(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h"),
    )
    before = current.agg(stamp.alias("s")).first().s
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger_only=True)
        current = cut(_star(large, larger_only=False))
        now = current.agg(stamp.alias("s")).first().s
        if now == before:
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
