"""Connected components of a link table by alternating large-star and small-star steps.

Every step is two keyed joins and two minima; a node with a third of all links
costs one partial minimum per task, and its join side can be split by adaptive
execution.  Nothing is collected but two totals per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltide.llm.common import Stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _totals(links: DataFrame):
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(stage: Stage, links: DataFrame, name: str) -> DataFrame:
    """``(u, v)``: each linked node and the smallest node it can reach, the smallest left out.

    ``links`` has long columns ``a`` and ``b``; loops, repeats and null ends are ignored.
    """
    current = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = stage.put(current.distinct(), f"{name}-0")
    before, turn = _totals(current), 0
    while before[0]:
        turn += 1
        current = stage.put(_small_star(_large_star(current)), f"{name}-{turn}")
        stage.drop(f"{name}-{turn - 1}")
        now = _totals(current)
        if now == before:
            break
        before = now
    return current
