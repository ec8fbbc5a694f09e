"""All telemetry queries over the driver's tables with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronosift.plans import telemetry


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.flagship(spark, sf_dir)


def queries() -> dict:
    return dict(telemetry.QUERIES)


def oracle_sql() -> dict:
    return dict(telemetry.SQL)
