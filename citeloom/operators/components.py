"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour of a node (the larger ones, or the smaller ones and itself) to the least of them all."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the least id that is linked to it, directly or not.

    Every id is first merged with its least neighbour; only what that leaves open, which is little where most components are small
    and dense, goes through rounds of stars. Their number grows with the logarithm of a component's size; beyond max_rounds
    an error is raised. Null ends and links of an id to itself are ignored; repeated links count once. No links give no
    rows. Nothing but two numbers a round comes to the driver.
    """
    edges = cut_lineage(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    merged = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).withColumn("m", F.least("id", "m")))
    # links between merged ids; where an id's least neighbour has a lesser one itself, that is a link too
    ends = edges.join(merged.select(F.col("id").alias("a"), F.col("m").alias("x")), "a").join(merged.select(F.col("id").alias("b"), F.col("m").alias("y")), "b").select("x", "y")
    ends = ends.unionAll(merged.where("id <> m").join(merged.select(F.col("id").alias("m"), F.col("m").alias("n")), "m").select(F.col("m").alias("x"), F.col("n").alias("y")))
    edges = cut_lineage(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if edges.limit(1).count() == 0:
        return merged.select("id", F.col("m").alias("component"))
    before = None
    for _ in range(max_rounds):
        edges = cut_lineage(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    found = edges.select(F.col("a").alias("m"), F.col("b").alias("component"))
    return merged.join(found, "m", "left").select("id", F.coalesce("component", "m").alias("component"))
