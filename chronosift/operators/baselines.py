"""Baselines: fitted once on a training period, frozen, versioned."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.functions.scalar import KNOTS
from chronosift.operators.ranges import running_counts
from chronosift.operators.windowing import guard_bounds


class ImmutableBaselineError(RuntimeError):
    """A frozen baseline is fitted or written again."""


def distinct_values(df: DataFrame, *fields: str) -> DataFrame:
    """Distinct entities or pairs; rows with a null do not count."""
    return df.select(*fields).dropna().distinct()


def frequencies(df: DataFrame, *fields: str, max_keys: int | None = None) -> DataFrame:
    """Occurrences per key; rows with a null key do not count. `max_keys` is an
    assertion, not a cap."""
    out = df.select(*fields).dropna().groupBy(*fields).agg(F.count("*").alias("n"))
    if max_keys is not None and out.count() > max_keys:
        raise MemoryError(f"more than {max_keys} keys of {fields}")
    return out


def merge_frequencies(parts: list[DataFrame], *fields: str) -> DataFrame:
    """Final counts of partial ones, as appended batch by batch."""
    return reduce(DataFrame.unionByName, parts).groupBy(*fields).agg(F.sum("n").alias("n"))


def hour_histogram(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Events per hour of day, all 24 hours present."""
    h = df.groupBy(F.hour(ts).cast("long").alias("hour_of_day")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(24).withColumnRenamed("id", "hour_of_day").join(F.broadcast(h), "hour_of_day", "left").fillna(0)


def melt(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, value; nulls dropped."""
    return df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "value").dropna()


#: Names of the quantile columns, in the order of KNOTS.
QUANTILES = ("p25", "p50", "p75", "p90", "p95", "p99", "p999")


def exact_quantiles(long: DataFrame, probabilities: list[float]) -> DataFrame:
    """long: feature, value. Per feature `q`, the exact interpolated quantiles.

    The rows of rank p * (n - 1), rounded down and up, are found by counts per
    distinct value; no task holds more than a range of a feature's values."""
    c = long.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))
    c = running_counts(c, ["feature"], "value", {"n": "upto"})
    place = lambda p: F.lit(float(p)) * (F.col("n_total") - 1)
    wanted = F.array(*[F.struct(F.lit(2 * i + up).alias("i"), (F.ceil(place(p)) if up else F.floor(place(p))).alias("at")) for i, p in enumerate(probabilities) for up in (0, 1)])
    hit = F.filter(wanted, lambda w: (w["at"] >= F.col("upto") - F.col("n")) & (w["at"] < F.col("upto")))
    # at most two rows per probability and feature
    rows = c.withColumn("w", F.explode(hit)).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("w.i", "value"))).alias("m"), F.max("n_total").alias("n_total"))
    low, high = (lambda i: F.col("m")[F.lit(2 * i)]), (lambda i: F.col("m")[F.lit(2 * i + 1)])
    return rows.select("feature", F.array(*[low(i) + (high(i) - low(i)) * (place(p) - F.floor(place(p))) for i, p in enumerate(probabilities)]).alias("q"))


def robust_stats(df: DataFrame, features: list[str], standard: tuple[str, ...] = ()) -> DataFrame:
    """Per feature: n, mean, sample deviation, exact quantiles, unscaled MAD,
    IQR and the calibration method."""
    long = melt(df, features)
    base = long.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    # from here on one row per feature: a list of names, not data
    base = base.join(F.broadcast(exact_quantiles(long, list(KNOTS))), "feature")
    base = base.select("feature", "n", "mean", "std", *[F.col("q")[i].alias(c) for i, c in enumerate(QUANTILES)])
    dev = long.join(F.broadcast(base.select("feature", "p50")), "feature").select("feature", F.abs(F.col("value") - F.col("p50")).alias("value"))
    out = base.join(F.broadcast(exact_quantiles(dev, [0.5]).select("feature", F.col("q")[0].alias("mad"))), "feature")
    method = F.when(F.col("feature").isin(list(standard)), "standard").otherwise("robust") if standard else F.lit("robust")
    return out.withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("calibration_method", method)


class BaselineSuite:
    """A version of named baseline tables under a folder; frozen when saved."""

    def __init__(self, spark: SparkSession, root: str, version: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{version}"
        self.tables: dict[str, DataFrame] = {}

    def _hadoop(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @property
    def frozen(self) -> bool:
        fs, p = self._hadoop(".frozen")
        return fs.exists(p)

    def fit(self, training: DataFrame, builders: dict, ts: str, bound: str) -> BaselineSuite:
        """builders: name -> function of the training rows. Rows must lie before the bound."""
        if self.frozen:
            raise ImmutableBaselineError(self.path)
        guard_bounds(training, ts, bound)
        self.tables = {n: b(training) for n, b in builders.items()}
        return self

    def save(self) -> None:
        if self.frozen:
            raise ImmutableBaselineError(self.path)
        for n, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{self.path}/{n}")
        fs, p = self._hadoop(".frozen")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(sorted(self.tables)).encode()))
        out.close()

    def load(self, names: list[str]) -> BaselineSuite:
        if not self.frozen:
            raise ImmutableBaselineError(f"{self.path} is not frozen")
        self.tables = {n: self.spark.read.parquet(f"{self.path}/{n}") for n in names}
        return self
