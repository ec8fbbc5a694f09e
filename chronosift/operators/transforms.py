"""Transforms of one feature against a frozen baseline: a column added to any
rows. The statistics come from a table of the suite, one row per feature
(`baselines.robust_stats`), or from one of counts per value."""

from __future__ import annotations

from abc import abstractmethod
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.functions import scalar as S
from chronosift.operators.base import Transformation
from chronosift.operators.baselines import QUANTILES


class _OfStatistics(Transformation):
    """`feature` against its row in the suite's table `stats`; without such a row
    statistics are null, which each transform defines."""

    name = ""

    def __init__(self, suite, feature: str, stats: str = "stats"):
        super().__init__(suite)
        self.feature, self.stats = feature, stats

    def transform(self, df: DataFrame) -> DataFrame:
        fields = ("mean", "std", *QUANTILES, "mad")
        row = self.suite.tables[self.stats].where(F.col("feature") == self.feature).agg(*[F.max(c).alias(f"__{c}") for c in fields])  # one row
        v = F.col(self.feature).cast("double")
        out = df.crossJoin(F.broadcast(row)).withColumn(f"{self.feature}_{self.name}", self.column(v, lambda c: F.col(f"__{c}")))
        return out.drop(*[f"__{c}" for c in fields])

    @abstractmethod
    def column(self, v: Column, of) -> Column: ...


class RobustZ(_OfStatistics):
    name = "robust_z"

    def column(self, v: Column, of) -> Column:
        return S.robust_z(v, of("p50"), of("mad"), of("std"))


class IqrDistance(_OfStatistics):
    name = "iqr_distance"

    def column(self, v: Column, of) -> Column:
        return S.iqr_distance(v, of("p25"), of("p75"))


class TailDistance(_OfStatistics):
    name = "tail_distance"

    def column(self, v: Column, of) -> Column:
        return S.tail_distance(v, of("p25"), of("p75"), of("p99"))


class PercentileRank(_OfStatistics):
    name = "percentile_rank"

    def column(self, v: Column, of) -> Column:
        return S.percentile_rank(v, [of(q) for q in QUANTILES], of("mad"))


class FrequencyRarity(Transformation):
    """-log10 of the share of the row's key among all counted keys of the suite's
    table; keys without a count, and with a null, are unseen."""

    def __init__(self, suite, table: str, fields: tuple[str, ...]):
        super().__init__(suite)
        self.table, self.fields = table, fields

    def transform(self, df: DataFrame) -> DataFrame:
        counts = self.suite.tables[self.table]
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("__total"))  # one row
        known = counts.select(*[F.col(f).alias(f"__k{i}") for i, f in enumerate(self.fields)], F.col("n").alias("__n"))
        same = reduce(lambda a, b: a & b, [F.col(f) == F.col(f"__k{i}") for i, f in enumerate(self.fields)])
        out = df.join(known, same, "left").crossJoin(F.broadcast(total))
        return out.withColumn(f"{'_'.join(self.fields)}_rarity", S.frequency_rarity(F.col("__n"), F.col("__total"))).drop("__n", "__total", *[f"__k{i}" for i in range(len(self.fields))])
