"""Canonical security events derived from the driver's `events` table, in Spark
and in SQL, by the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.session import table

#: Windows below this time are the baseline period.
SPLIT = "2024-01-22 00:00:00"
SPLIT_S = 1705881600

COLUMNS = {
    "user_name": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('user_', user_id) END",
    "source_ip": "concat(CASE WHEN k % 4 = 0 THEN '8.8.' ELSE '10.0.' END, user_id % 8, '.', k % 50)",
    "destination_ip": "concat('192.168.1.', k % 32)",
    "destination_port": "CAST(CASE WHEN k % 9 = 0 THEN 0 ELSE 1000 + k % 7 END AS BIGINT)",
    "host_name": "concat('host-', user_id % 11)",
    "process_name": "concat('proc-', k % 13)",
    "process_parent_name": "CASE WHEN k % 5 = 0 THEN NULL ELSE concat('parent-', k % 6) END",
    "network_protocol": "CASE WHEN k % 3 = 0 THEN 'tcp' WHEN k % 3 = 1 THEN 'udp' ELSE '' END",
    "event_category": "CASE event_type WHEN 'view' THEN 'network' WHEN 'click' THEN 'process' WHEN 'purchase' THEN 'file' ELSE 'authentication' END",
    "event_action": "CASE WHEN event_type IN ('signup', 'error') THEN 'logon' ELSE event_type END",
    "event_outcome": "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END",
}


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    return e.select(
        F.col("event_id").cast("string").alias("_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value", "k",
        *[F.expr(sql).alias(name) for name, sql in COLUMNS.items()],
    )


def ev_sql(window_s: int = 5) -> str:
    """CTE `ev` with the same columns, t (epoch microseconds) and w (window number)."""
    cols = ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items())
    return (
        "ev AS (SELECT *, t // %d AS w FROM (SELECT CAST(event_id AS VARCHAR) AS id, event_id, ts, epoch_us(ts) AS t, value, k, %s "
        "FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)))" % (window_s * 1_000_000, cols)
    )
