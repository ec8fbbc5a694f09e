"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronosift.session import stored


def _lowest(edges: DataFrame) -> DataFrame:
    """Distinct (u, v), whether any copy `moved`, and m, the smallest of u and its neighbours."""
    # one exchange by u serves both: a node's edges are deduplicated and sorted where they lie
    dealt = edges.repartition("u").groupBy("u", "v").agg(F.max("moved").alias("moved"))
    return dealt.withColumn("m", F.least("u", F.min("v").over(W.partitionBy("u"))))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: a, b (longs). Returns id, component (the smallest id reachable)
    for every id that occurs.

    Stars are contracted in turn: each node sends its larger neighbours, then
    its smaller ones, to the smallest of its neighbours. The number of rounds
    grows with the logarithm of the longest path. A round is two exchanges by
    node, without a broadcast, and a table in the shared folder, so the driver
    holds no more for many links than for few. A node's edges of 16 bytes are
    read in one task, which spills them.
    """
    e = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(rounds):
        still = F.lit(False)
        both = e.select(F.inline(F.array(F.struct("u", "v", still.alias("moved")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), still.alias("moved")))))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
        # the edge to the smallest neighbour stays the node's own; the others become edges of those neighbours
        small = _lowest(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | (F.col("v") != F.col("m"))).alias("moved"))
        e = stored(small, "links")
        if not e.where("moved").head(1):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
