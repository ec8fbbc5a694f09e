"""What the evaluation period has that the baseline lacks: users, hosts, their
pairs, hours of the day, hours of each user, and records of measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosift.operators.investigation import first_occurrences, record_breakers

SCHEMA = ("kind", "entity", "first_seen", "first_id", "value", "previous_max")


def hour_maps(df: DataFrame, entity: str, ts: str = "ts") -> DataFrame:
    """entity, hours: a map of 24 bits, bit h set where the entity has an event in
    hour h. Maps of parts merge by or, so an entity of any number of rows is one
    number in every task; rows without the entity or the time do not count."""
    known = df.where(F.col(entity).isNotNull() & F.col(ts).isNotNull())
    return known.groupBy(entity).agg(F.bit_or(F.expr(f"shiftleft(1, hour({ts}))")).alias("hours"))


def new_hours(base: DataFrame, new: DataFrame, entity: str, ts: str = "ts", tie: str = "_id") -> DataFrame:
    """entity, hour, first_seen, first_id: hours in which an entity of the
    baseline is active for the first time. Entities the baseline lacks are new
    themselves and not listed."""
    before = hour_maps(base, entity, ts).select(entity, F.col("hours").alias("__before"))
    first = new.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).groupBy(entity, F.hour(ts).alias("hour")).agg(F.min(F.struct(ts, tie)).alias("__f"))
    fresh = first.join(before, entity).where(F.expr("(__before & shiftleft(1, hour)) = 0"))
    return fresh.select(entity, "hour", F.col(f"__f.{ts}").alias("first_seen"), F.col(f"__f.{tie}").alias("first_id"))


def inventory(base: DataFrame, new: DataFrame, user: str, host: str, measures: dict[str, str], order: str, ts: str = "ts", tie: str = "_id") -> DataFrame:
    """SCHEMA rows. measures: name -> column whose records over the baseline's
    maximum and over everything before them in `order` are listed with both."""

    def rows(found: DataFrame, kind: str, entity: Column, seen: Column = F.col("first_seen"), first: Column = F.col("first_id"), value: Column | None = None, top: Column | None = None) -> DataFrame:
        null = F.lit(None).cast("double")
        return found.select(F.lit(kind).alias("kind"), entity.cast("string").alias("entity"), seen.alias("first_seen"), first.cast("string").alias("first_id"), (null if value is None else value.cast("double")).alias("value"), (null if top is None else top.cast("double")).alias("previous_max"))

    parts = [rows(first_occurrences(base, new, [c], ts, tie), f"new_{n}", F.col(c)) for n, c in (("user", user), ("host", host))]
    parts.append(rows(first_occurrences(base, new, [user, host], ts, tie), "new_relationship", F.concat(user, F.lit(" -> "), host)))
    timed = lambda d: d.withColumn("__hour", F.hour(ts))
    parts.append(rows(first_occurrences(timed(base), timed(new), ["__hour"], ts, tie), "new_hour", F.col("__hour")))
    parts.append(rows(new_hours(base, new, user, ts, tie), "new_user_hour", F.concat(F.col(user), F.lit(" @ "), F.col("hour").cast("string"))))
    for name, column in measures.items():
        parts.append(rows(record_breakers(base, new, column, order), f"record_{name}", F.col(order), F.col(ts), F.col(tie), F.col(column), F.col("previous_max")))
    return reduce(DataFrame.unionByName, parts)
