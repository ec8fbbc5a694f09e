"""Dataset profile, deduplication and generic top-k aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def profile(events: DataFrame, columns: list[str], approx: list[str]) -> DataFrame:
    """One pass: rows, time range, exact distinct ids, filled counts, approximate distinct counts."""
    return events.agg(
        F.count("*").alias("rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count_distinct("_id").alias("distinct_ids"),
        *[F.count(c).alias(f"filled_{c}") for c in columns], *[F.approx_count_distinct(c).alias(f"approx_{c}") for c in approx],
    ).withColumn("duplicate_rate_pct", F.when(F.col("rows") > 0, (1 - F.col("distinct_ids") / F.col("rows")) * 100).otherwise(0.0))


def missingness(df: DataFrame, columns: list[str], above_pct: float = 20.0) -> DataFrame:
    """column, missing, percent, flagged."""
    one = df.agg(F.count("*").alias("__n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    long = one.unpivot(["__n"], columns, "column_name", "missing")
    pct = F.when(F.col("__n") > 0, F.col("missing") / F.col("__n") * 100).otherwise(0.0)
    return long.select("column_name", "missing", pct.alias("pct"), (pct > above_pct).alias("flagged"))


def volume(events: DataFrame, unit: str) -> DataFrame:
    return events.groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(F.count("*").alias("n"))


def group_counts(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("n"))


def dedup_exact(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key: the first in the given order, by a mergeable minimum."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("__row"))).alias("m"))
    return picked.select(key, "m.__row.*")


def dedup_metrics(df: DataFrame, key: str) -> DataFrame:
    g = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n").alias("input_rows"), F.count("*").alias("retained_rows"))
    return g.select("input_rows", (F.col("input_rows") - F.col("retained_rows")).alias("duplicate_rows"), "retained_rows", ((F.col("input_rows") - F.col("retained_rows")) / F.col("input_rows") * 100).alias("duplicate_pct"))


def top_groups(df: DataFrame, where, key: str, value: str, n: int = 5) -> DataFrame:
    """Filter, group, sum and count, and the n largest sums."""
    return df.where(where).groupBy(key).agg(F.sum(value).alias("total"), F.count("*").alias("n")).orderBy(F.desc("total"), key).limit(n)


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """Upsert view of an append-only log: the last row per key."""
    return log.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).where("__r = 1").drop("__r")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 20) -> DataFrame:
    b = F.least(F.greatest(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def mapping_report(columns: list[str], mapping: dict[str, list[str]]) -> dict:
    """Which canonical fields the columns cover; the first candidate found wins."""
    have = set(columns)
    hit = {c: next((p for p in paths if p in have), None) for c, paths in mapping.items()}
    found = {c: p for c, p in hit.items() if p}
    return {
        "mapped": found, "missing": sorted(c for c, p in hit.items() if not p), "unmapped": sorted(have - set(found.values())),
        "coverage_pct": 100.0 * len(found) / len(mapping) if mapping else 0.0,
    }
