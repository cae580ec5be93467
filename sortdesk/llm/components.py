"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _relabel(edges: DataFrame, to: DataFrame) -> DataFrame:
    """Both ends through the map (v, root); equal ends and repeated edges go."""
    a = to.select(F.col("v").alias("u"), F.col("root").alias("ru"))
    b = to.select("v", F.col("root").alias("rv"))
    moved = edges.join(a, "u").join(b, "v")
    low, high = F.least("ru", "rv"), F.greatest("ru", "rv")
    return moved.where("ru <> rv").select(low.alias("u"), high.alias("v")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (u, v); root is one vertex of its component.

    Each round sends a vertex to the vertex of least hash within two steps, follows that twice
    more, and keeps the edges between the images. Hashes change with the round, so chains and
    stars both shrink by a constant share. Hub vertices are aggregated before the shuffle, and
    the joins are plain equality joins on written tables, which adaptive execution splits on
    hot keys.
    """
    edges = written(edges.where("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    total = edges.select(F.col("u").alias("v"), F.col("v").alias("root")).limit(0)
    round_no = 0
    while not edges.isEmpty():
        step = written(_step(edges, round_no), "step")
        edges = written(_relabel(edges, step), "edges")
        onward = step.select(F.col("v").alias("root"), F.col("root").alias("further"))
        moved = total.join(onward, "root", "left").select(
            "v", F.coalesce("further", "root").alias("root"))
        total = written(step if round_no == 0 else moved, "roots")
        round_no += 1
    return total


def _step(edges: DataFrame, round_no: int) -> DataFrame:
    """(v, root): the vertex of least hash within two steps, then twice that vertex's own."""
    def rank(c):
        return F.struct(F.xxhash64(F.lit(round_no), c).alias("h"), F.col(c).alias("x"))

    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join below has an exchange on either side and hubs can be split
    near = written(both.groupBy("u").agg(
        F.least(F.min(rank("v")), F.first(rank("u"))).alias("m")), "nearest")
    beside = both.join(near.select(F.col("u").alias("v"), "m"), "v")
    far = beside.unionByName(near.select(F.lit(None).cast("long").alias("v"), "u", "m"))
    step = written(far.groupBy("u").agg(F.min("m").alias("m")).select(
        F.col("u").alias("v"), F.col("m.x").alias("root")), "near")
    for _ in range(2):
        onward = step.select(F.col("v").alias("root"), F.col("root").alias("further"))
        step = step.join(onward, "root").select("v", F.col("further").alias("root"))
    return step
