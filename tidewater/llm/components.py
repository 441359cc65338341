"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregates (combined map-side) and two equi-joins that AQE can
split, so a hub with a third of all edges is not gathered in one task.  Rounds are
checkpointed in the shared folder; their number is logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import cut_lineage

MAX_ROUNDS = 64


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "k")
    return (both.join(low, both.u == low.k).where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    moved = down.join(low, down.u == low.k).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v) but the roots; root is the least node reached."""
    e = cut_lineage(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct())
    seen = _digest(e)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        e = cut_lineage(_small_star(_large_star(e)))
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
