"""Ordered sums over many distinct values without one ordered pass: values fall
into ranges by approximate cuts, sums run within ranges and over their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of one group. Cuts are approximate; results don't depend on them.
RANGES = 256


def running_counts(counts: DataFrame, keys: list[str], value: str, columns: dict[str, str], ranges: int = RANGES) -> DataFrame:
    """counts: one row per group (`keys`) and distinct `value`. For each column n
    -> name, the sum of n up to and with the row's value in its group (`name`),
    and the group's sum (n_total). What is broadcast has one row per group, or
    one per group and range."""
    points = [i / ranges for i in range(1, ranges)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, points, 20 * ranges).alias("__cuts"))
    dealt = counts.join(F.broadcast(cuts), keys) if keys else counts.crossJoin(F.broadcast(cuts))
    dealt = dealt.withColumn("__r", F.coalesce(F.size(F.filter("__cuts", lambda x: x < F.col(value))), F.lit(0))).drop("__cuts")
    totals = dealt.groupBy(*keys, "__r").agg(*[F.sum(n).alias(f"__t_{n}") for n in columns])
    over = W.partitionBy(*keys).orderBy("__r")
    before = totals.select(
        *keys, "__r", *[F.coalesce(F.sum(f"__t_{n}").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"__b_{n}") for n in columns],
        *[F.sum(f"__t_{n}").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(f"{n}_total") for n in columns],
    )
    within = W.partitionBy(*keys, "__r").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.withColumns({f"__w_{n}": F.sum(n).over(within) for n in columns}).join(F.broadcast(before), [*keys, "__r"])
    return out.withColumns({name: F.col(f"__w_{n}") + F.col(f"__b_{n}") for n, name in columns.items()}).drop("__r", *[f"__{k}_{n}" for n in columns for k in "wb"])
