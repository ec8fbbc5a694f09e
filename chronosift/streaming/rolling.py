"""Rolling context and duplicate flags as keyed state that outlives a restart.

State is kept by transformWithState, which needs the RocksDB state store; the
functions set it for the session, and a query keeps the store it began with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronosift.operators.features import METRICS, ROLLING
from chronosift.operators.windowing import LATENESS_S

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Rolling(StatefulProcessor):
    """The last windows of a stream, as many as the longest frame less one, and
    the number of windows seen. Sums are of integers, so they are exact."""

    def __init__(self, metrics: tuple[str, ...], horizons: dict[str, int]):
        self.metrics, self.horizons, self.most = metrics, horizons, max(horizons.values()) - 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", ", ".join(f"m{i} long" for i in range(len(self.metrics))))
        self.last = handle.getValueState("last", "window_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("window_id")
        if self.last.exists():  # a window that came before is not taken again
            new = new[new["window_id"] > self.last.get()[0]]
        if not len(new):
            return
        old = np.array(list(self.held.get()), np.int64).reshape(-1, len(self.metrics))
        every = np.vstack([old, new[list(self.metrics)].to_numpy(np.int64)])
        out = {"stream": [key[0]] * len(new), "window_id": new["window_id"].to_numpy()}
        sums = np.vstack([np.zeros((1, every.shape[1]), np.int64), np.cumsum(every, 0)])
        squares = np.vstack([np.zeros((1, every.shape[1]), np.int64), np.cumsum(every * every, 0)])
        end = np.arange(len(old) + 1, len(every) + 1)
        for h, n in self.horizons.items():
            begin = np.maximum(end - n, 0)
            size = (end - begin).astype(float)
            for i, m in enumerate(self.metrics):
                s, q = (x[end, i] - x[begin, i] for x in (sums, squares))
                s, q = s.astype(float), q.astype(float)
                out |= {f"rolling_{m}_mean_{h}": s / size, f"rolling_{m}_sum_{h}": s, f"rolling_{m}_std_{h}": np.sqrt(np.maximum(0.0, size * q - s * s)) / size}
        kept = every[-self.most :] if self.most else every[:0]
        self.held.put([tuple(map(int, r)) for r in kept])
        self.last.update((int(new["window_id"].iloc[-1]),))
        yield pd.DataFrame(out)

    def close(self) -> None: ...


def rolling_context(windows: DataFrame, metrics: tuple[str, ...] = METRICS, horizons: dict[str, int] = ROLLING) -> DataFrame:
    """windows: stream, window_id (dense and ascending over the batches of a
    stream) and integer metrics. The features of the batch frames
    (`features.rolling_features`), window by window as they come."""
    use_rocksdb(windows)
    names = [f"rolling_{m}_{s}_{h}" for h in horizons for m in metrics for s in ("mean", "sum", "std")]
    schema = "stream string, window_id long, " + ", ".join(f"{n} double" for n in names)
    rows = windows.select("stream", "window_id", *[F.coalesce(F.col(m).cast("long"), F.lit(0).cast("long")).alias(m) for m in metrics])
    return rows.groupBy("stream").transformWithStateInPandas(_Rolling(tuple(metrics), dict(horizons)), schema, "append", "none")


class _Seen(StatefulProcessor):
    """Whether a key occurred; forgotten when the watermark is `keep_ms` beyond its first events."""

    def __init__(self, columns: list[str], keys: tuple[str, ...], ts: str, keep_ms: int):
        self.columns, self.keys, self.ts, self.keep_ms = columns, keys, ts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = known = self.seen.exists()
        newest = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            if not len(part):
                continue
            flag = np.ones(len(part), bool)
            flag[0] = known
            known = True
            newest = max(newest, int(part[self.ts].max().timestamp() * 1000))
            yield part.assign(**dict(zip(self.keys, key)))[self.columns].assign(duplicate=flag)
        if known and not before:
            self.seen.update((True,))
            self.handle.registerTimer(newest + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        yield from ()

    def close(self) -> None: ...


def flag_duplicates(events: DataFrame, keys: tuple[str, str] = ("_id", "raw_timestamp"), ts: str = "ts", allowed: int = LATENESS_S, remember: int = 3600) -> DataFrame:
    """All events, with `duplicate` true for those whose keys came before, within
    `remember` seconds of the watermark. No event is dropped but those that the
    watermark makes late; keys are columns without nulls."""
    use_rocksdb(events)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", duplicate boolean"
    marked = events.withWatermark(ts, f"{allowed} seconds")
    return marked.groupBy(*keys).transformWithStateInPandas(_Seen(events.columns, keys, ts, remember * 1000), schema, "append", "eventTime")
