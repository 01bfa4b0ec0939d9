"""Connected components by alternating stars, on edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.llm._shared import cut, discard


def _low(edges: DataFrame) -> DataFrame:
    """Smallest neighbour (or itself) of each u in ``(u, v)``; partial minima leave each task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_low(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = down.join(_low(down), "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(id, component_id)`` of every id in ``edges (u, v)`` but the smallest of its component.

    ``component_id`` is the smallest id reachable.  Each round is written to
    the shared folder; a hub's edges are joined with a row of their own, which
    adaptive execution can split, and never gathered in a group.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        after = cut(_small_star(_large_star(now)))
        discard(now)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return after.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        seen, now = state, after
    raise RuntimeError("the components did not settle")
