"""Connected components by alternating large-star and small-star steps, all on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star links every larger neighbour of a node to the least of node and neighbours; small star links the node and
    its smaller neighbours to the least of them. Both keep the components."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u")
    if large:
        return out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    return (out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a != b").distinct())


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Nodes of ``edges`` (a, b; long) that are not the least of their component: a, and that least node as b.

    Steps alternate until the edges stay the same, which their count and two sums tell; only these numbers reach the driver.
    Every step is a written table, so a lost executor costs the current step."""
    def mark(e: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = mark(now)
    for _ in range(rounds):
        now = stored(_star(_star(now, True), False))
        after = mark(now)
        if after == before:
            return now
        before = after
    raise RuntimeError(f"no end after {rounds} rounds")
