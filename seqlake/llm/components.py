"""Connected components as Spark jobs: alternating large and small stars over written edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the smallest id reachable.

    Every round writes its edges, so lineage stays short; the number of rounds grows with the
    logarithm of the longest chain.
    """
    now = scratch.save(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = _state(now)
    while True:
        following = scratch.save(_small_star(_large_star(now)), "edges")
        scratch.drop(now)
        now, before, state = following, state, _state(following)
        if state == before:
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
