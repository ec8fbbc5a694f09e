"""Tumbling windows, dense grids and lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW_S, LATENESS_S = 5, 60
#: Windows of a bucket of the grid; frames never reach further back than RANGE.
GRID_BUCKET, REACH = 17_280, 180


def window_id(ts: Column | str, seconds: int = WINDOW_S) -> Column:
    """Number of the window; starts are inclusive, ends exclusive, also before 1970."""
    return F.floor(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / F.lit(seconds * 1_000_000)).cast("long")


def window_start(w: Column | str, seconds: int = WINDOW_S) -> Column:
    return F.timestamp_seconds((F.col(w) if isinstance(w, str) else w) * seconds)


def event_index(events: DataFrame, seconds: int = WINDOW_S) -> DataFrame:
    return events.select("_id", window_id("ts", seconds).alias("window_id"))


def window_summary(events: DataFrame, seconds: int = WINDOW_S) -> DataFrame:
    return events.groupBy(window_id("ts", seconds).alias("window_id")).agg(F.count("*").alias("event_count"))


def calendar(df: DataFrame, seconds: int = WINDOW_S) -> DataFrame:
    """Calendar columns from window_id; day 0 is Sunday; the slot counts windows of the day."""
    s = F.col("window_id") * seconds
    t = F.timestamp_seconds(s)
    return df.withColumns({
        "hour_of_day": F.hour(t), "minute_of_hour": F.minute(t), "day_of_week": F.dayofweek(t) - 1, "day_of_month": F.dayofmonth(t),
        "window_position_in_hour": (F.pmod(s, F.lit(86400)) / seconds).cast("int"), "is_weekend": F.dayofweek(t).isin(1, 7),
    })


DISTINCT = {"distinct_users": "user_name", "distinct_ips": "source_ip", "distinct_hosts": "host_name", "distinct_processes": "process_name"}


def window_dataset(events: DataFrame, seconds: int = WINDOW_S) -> DataFrame:
    """Count, exact distinct counts (nulls do not count) and calendar per window.
    A window's sets are small, so one aggregation collects them."""
    g = events.groupBy(window_id("ts", seconds).alias("window_id")).agg(
        F.count("*").alias("event_count"), *[F.size(F.collect_set(c)).cast("long").alias(n) for n, c in DISTINCT.items()]
    )
    return calendar(g, seconds)


def dense(summary: DataFrame, columns: list[str]) -> DataFrame:
    """All windows between the first and the last; columns are 0 where nothing
    happened. The grid comes from day buckets, so that it and its join spread."""
    lo_hi = summary.agg(F.min("window_id").alias("lo"), F.max("window_id").alias("hi"))
    grid = lo_hi.where("lo IS NOT NULL").select(
        "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / GRID_BUCKET), F.floor(F.col("hi") / GRID_BUCKET))).alias("b")
    )
    grid = grid.select(F.explode(F.sequence(F.greatest("lo", F.col("b") * GRID_BUCKET), F.least("hi", F.col("b") * GRID_BUCKET + GRID_BUCKET - 1))).alias("window_id"))
    return grid.join(summary, "window_id", "left").fillna(0, columns)


def global_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, and sum, least and largest value of a column."""
    return df.agg(F.count("*").alias("rows"), F.sum(column).alias("total"), F.min(column).alias("least"), F.max(column).alias("largest"))


def contiguity_gaps(dense_windows: DataFrame) -> DataFrame:
    """Windows whose follower is missing, found without ordering the whole grid."""
    following = dense_windows.select((F.col("window_id") - 1).alias("window_id"))
    last = dense_windows.agg(F.max("window_id").alias("last"))
    return dense_windows.join(following, "window_id", "left_anti").crossJoin(F.broadcast(last)).where("window_id < last").select("window_id")


def bucketed_frames(df: DataFrame, add, reach: int = REACH, bucket: int = GRID_BUCKET, key: str = "window_id") -> DataFrame:
    """Apply `add(df, window)` over ordered windows, bucket by bucket: every
    bucket also gets the `reach` rows before it, whose own results are dropped,
    so no frame needs the whole grid in one task."""
    b = F.floor(F.col(key) / bucket)
    copies = F.array_distinct(F.array(b, F.floor((F.col(key) + reach) / bucket)))
    spread = df.withColumn("__b", F.explode(copies))
    out = add(spread, W.partitionBy("__b").orderBy(key))
    return out.where(F.col("__b") == b).drop("__b")


def temporal_split(df: DataFrame, ts: str, bound: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the bound, and from it on."""
    t = F.lit(bound).cast("timestamp")
    return df.where(F.col(ts) < t), df.where(F.col(ts) >= t)


class TemporalLeakageError(ValueError):
    """Training data reaches into the evaluation period."""


def guard_bounds(df: DataFrame, ts: str, bound: str) -> DataFrame:
    top = df.agg(F.max(F.col(ts).cast("timestamp")).alias("t"), F.lit(bound).cast("timestamp").alias("b")).where("t >= b").first()
    if top:
        raise TemporalLeakageError(f"{ts} reaches {top.t}, the bound is {bound}")
    return df


def lateness(events: DataFrame, arrival: list[Column], shard: Column, seconds: int = WINDOW_S, allowed: int = LATENESS_S) -> DataFrame:
    """Status of each event by the exact high-water mark in arrival order, the
    event itself included: LATE when the mark is beyond its window's end by more
    than `allowed`. `shard` cuts the arrival order into stretches (it never falls
    along it); the prefix maximum runs within stretches and over their maxima,
    so no task needs all rows."""
    e = events.withColumn("__t", F.unix_micros("ts")).withColumn("__p", shard)
    inner = e.withColumn("__m", F.max("__t").over(W.partitionBy("__p").orderBy(*arrival).rowsBetween(W.unboundedPreceding, 0)))
    tops = e.groupBy("__p").agg(F.max("__t").alias("__top"))
    before = tops.select("__p", F.max("__top").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    out = inner.join(before, "__p").withColumn("watermark_us", F.greatest("__m", "__before"))
    end = (window_id("ts", seconds) + 1) * (seconds * 1_000_000)
    status = F.when(F.col("watermark_us") > end + allowed * 1_000_000, "LATE").otherwise("ON_TIME")
    return out.withColumn("status", status).drop("__t", "__p", "__m", "__before")


def write_ordered(df: DataFrame, path: str, key: str = "window_id", files: int | None = None) -> None:
    """Parquet in ascending order of `key`: files hold ranges of it and are sorted
    within, so a reader of a range of windows passes over the other files by
    their statistics. Without `files`, Spark settles their number by size."""
    dealt = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.parquet(path)
