"""Reading a source safely: retries, an allow list, metadata, and extraction in
micro-batches that go on where they stopped."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a source may be asked for; what would change it is refused by name, and so is anything else.
ALLOWED = frozenset({"ping", "list", "mapping", "search", "count", "read"})
DENIED = frozenset({"index", "create", "update", "delete", "bulk", "reindex", "delete_by_query", "update_by_query", "put_mapping", "put_settings", "delete_index", "create_index"})


class ReadOnlyViolation(PermissionError):
    """An operation that is not on the allow list."""


def allow(operation: str) -> None:
    if operation in DENIED:
        raise ReadOnlyViolation(f"{operation} would change the source")
    if operation not in ALLOWED:
        raise ReadOnlyViolation(operation)


class ReadOnly:
    """A source behind the lists: every call names its operation, by `operations`
    (method -> operation) or by its own name, and is checked before it is made."""

    def __init__(self, source, operations: dict[str, str] | None = None):
        self._source, self._operations = source, operations or {}

    def __getattr__(self, name: str):
        target = getattr(self._source, name)
        if not callable(target) or name.startswith("_"):
            return target

        def checked(*args, **kwargs):
            allow(self._operations.get(name, name))
            return target(*args, **kwargs)

        return checked


def retried(attempts: int = 5, base_s: float = 1.0, most_s: float = 30.0, on: tuple = (ConnectionError, TimeoutError), sleep: Callable = time.sleep):
    """Try again after base, 2 * base, 4 * base ... seconds (with some jitter) where one of `on` is raised."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(*args, **kwargs):
            for n in range(attempts):
                try:
                    return f(*args, **kwargs)
                except on:
                    if n + 1 == attempts:
                        raise
                    sleep(min(most_s, base_s * 2**n) * random.uniform(0.8, 1.0))

        return run

    return wrap


def validate_connection(source, attempts: int = 5, sleep: Callable = time.sleep) -> bool:
    """Whether the source's folder answers; `source` has _fs() (file system, path)."""
    allow("ping")

    @retried(attempts, sleep=sleep)
    def ping() -> bool:
        fs, path = source._fs()
        if not fs.exists(path):
            raise ConnectionError(str(path))
        return True

    return ping()


def field_types(schema: T.StructType, prefix: str = "") -> dict[str, str]:
    """Dotted names of all leaves and their types."""
    out: dict[str, str] = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out |= field_types(f.dataType, f"{prefix}{f.name}.")
        else:
            out[prefix + f.name] = f.dataType.simpleString()
    return out


def source_metadata(df: DataFrame, time: str | None = None) -> dict:
    """Fields, their number, those that hold dates, rows, and the first and last time, in one pass."""
    allow("mapping")
    kinds = field_types(df.schema)
    dates = sorted(n for n, k in kinds.items() if k.startswith(("timestamp", "date")) or n.split(".")[-1] in ("@timestamp", "timestamp"))
    time = time or (dates[0] if dates else None)
    quoted = F.col(".".join(f"`{p}`" for p in time.split("."))).try_cast("timestamp") if time else F.lit(None).cast("timestamp")
    r = df.agg(F.count("*").alias("n"), F.min(quoted).alias("lo"), F.max(quoted).alias("hi")).first()
    return {"fields": kinds, "field_count": len(kinds), "date_fields": dates, "doc_count": r.n, "min_timestamp": r.lo, "max_timestamp": r.hi}


def count_events(df: DataFrame, query: str | None = None) -> int:
    """Rows that meet a condition; all without one."""
    allow("count")
    return (df.where(query) if query else df).count()


def numeric_and_text(df: DataFrame, without: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Columns by type: numbers (no Booleans) and strings."""
    rest = [f for f in df.schema.fields if f.name not in without]
    return [f.name for f in rest if isinstance(f.dataType, T.NumericType)], [f.name for f in rest if isinstance(f.dataType, T.StringType)]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def rename_over(spark: SparkSession, source: str, target: str) -> None:
    """Put one path in place of another in one step of the file system."""
    fs_package, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    kind = getattr(fs_package, "Options$Rename")
    over = gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    a, b = fs_package.Path(source), fs_package.Path(target)
    fs_package.FileContext.getFileContext(b.toUri(), spark._jsc.hadoopConfiguration()).rename(a, b, over)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place, then put
    there in one step, so readers find the old text or the new one."""
    fs, beside = _fs(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename_over(spark, beside.toString(), path)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.text(path, wholetext=True).first().value


def scan(spark: SparkSession, pattern: str) -> DataFrame:
    """All Parquet tables that a glob names, as one."""
    allow("read")
    return spark.read.option("mergeSchema", "true").parquet(pattern)


class Checkpoint:
    """Where an extraction run stands: one small file per run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, run_id: str) -> str:
        return f"{self.root}/checkpoint-{run_id}.json"

    def save(self, run_id: str, state: dict) -> None:
        write_text(self.spark, self._path(run_id), json.dumps(state, sort_keys=True))

    def load(self, run_id: str) -> dict | None:
        text = read_text(self.spark, self._path(run_id))
        return None if text is None else json.loads(text)

    def clear(self, run_id: str) -> None:
        fs, p = _fs(self.spark, self._path(run_id))
        fs.delete(p, False)


def extract(rows: DataFrame, time_us: str, start_us: int, end_us: int, write: Callable[[DataFrame, int], int], checkpoint: Checkpoint, run_id: str, batches: int = 24) -> int:
    """Rows with start <= time < end in `batches` slices of the time range, in
    order. After a slice is written the checkpoint moves behind it, so a run
    that stops goes on with the slice it was in: each row is written at least
    once. `write` gets a slice and its number, and must be idempotent by number
    or be followed by a step that drops repeated ids. Returns rows written so far."""
    allow("read")
    state = checkpoint.load(run_id) or {"next": 0, "written": 0}
    step = -(-(end_us - start_us) // batches)
    for n in range(state["next"], batches):
        lo, hi = start_us + n * step, min(end_us, start_us + (n + 1) * step)
        if lo < hi:
            state["written"] += write(rows.where((F.col(time_us) >= lo) & (F.col(time_us) < hi)), n)
        state["next"] = n + 1
        checkpoint.save(run_id, state)
    return state["written"]
