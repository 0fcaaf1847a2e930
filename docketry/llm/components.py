"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed; each round is written to the shared folder, which cuts lineage.
The number of rounds grows with the logarithm of the longest chain.  Minima come from
partial aggregates, and the joins on them are plain equi-joins, which adaptive execution
splits where a hub has many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import Scratch


def _sum(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is its least reachable node."""
    u, v = F.greatest(a, b), F.least(a, b)
    now = scratch.table(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct(), "edges")
    said = _sum(now)
    for _ in range(rounds):
        if not said[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pair = lambda x: F.struct(F.col(x).alias("u"), F.col("m").alias("v"))
        nxt = small.select(F.explode(F.array(pair("u"), pair("v"))).alias("e")).select("e.*").where("u <> v").distinct()
        nxt = scratch.table(nxt, "edges")
        told = _sum(nxt)
        scratch.drop(now)
        now, done, said = nxt, told == said, told
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
