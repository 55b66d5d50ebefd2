"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.storage import stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s")).first()
    return row["n"], row["s"] or 0


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b) to (node, root): the least node of each component, for every node of an edge between two.

    Each round is an aggregate and a join on edges, so no neighbourhood is
    gathered; rounds go on until nothing changes and every round is stored.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(now, "components")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where(F.col("u") != F.col("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        nxt = stored(small.select("e.u", F.col("e.m").alias("v")).where(F.col("u") != F.col("v")).distinct(), "components")
        after = _mark(nxt)
        now, done, mark = nxt, after == mark, after
        if done:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
