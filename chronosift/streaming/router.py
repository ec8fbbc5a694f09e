"""Structured Streaming operators: exact late routing and counts per window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronosift.operators.windowing import LATENESS_S, WINDOW_S


def route_late(events: DataFrame, key: str = "stream", seconds: int = WINDOW_S, allowed: int = LATENESS_S) -> DataFrame:
    """events: `key`, _id, ts_us (long), arrival (long). Status of each event
    against the key's high-water mark, which the event itself may raise: LATE
    strictly beyond the window's end plus `allowed`. The mark is the state."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else -(2**62)
        rows = pd.concat(list(parts)).sort_values(["arrival", "_id"])
        marks = rows["ts_us"].cummax().clip(lower=mark)
        state.update((int(marks.iloc[-1]),))
        end = (rows["ts_us"] // (seconds * 1_000_000) + 1) * (seconds * 1_000_000)
        late = marks > end + allowed * 1_000_000
        yield pd.DataFrame({"stream": k[0], "_id": rows["_id"], "ts_us": rows["ts_us"], "status": late.map({True: "LATE", False: "ON_TIME"})})

    return events.groupBy(F.col(key).alias("stream")).applyInPandasWithState(run, "stream string, _id string, ts_us long, status string", "mark long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str = "ts", seconds: int = WINDOW_S, allowed: int = LATENESS_S) -> DataFrame:
    """Counts per tumbling window under Spark's own watermark."""
    return events.withWatermark(ts, f"{allowed} seconds").groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("event_count")).select(F.col("w.start").alias("window_start"), "event_count")
