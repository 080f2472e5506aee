"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is two groupings with partial aggregation, so the work is linear in the edges a round and the number of rounds
logarithmic; a hub only ever gathers its minimum, never its list of neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v): link the neighbours of a node to the least among them and itself."""
    if large:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    else:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:  # both sides of the join are then plain exchanges, so a hub's rows can be split among tasks
        least = materialise(least, "least")
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
    out = out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return out if large else out.distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its least node.

    Self edges only register their node. Edges with a null end are ignored, repeated edges count once, and an empty table
    gives an empty result. Only one number a round, the fingerprint of the edge set, reaches the driver.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = ends.select(F.col("u").alias("node")).unionByName(ends.select(F.col("v").alias("node"))).distinct()
    cur = materialise(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        cur = materialise(_star(_star(cur, True), False), "edges")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
