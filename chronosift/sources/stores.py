"""Sources and sinks: paged reads, partitioned writes, quarantine, manifests, logs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.operators.profile import dedup_exact

DATASETS = ("july", "august")
#: What the methods of a source ask of it.
OPERATIONS = {"discover_sources": "list", "discover_fields": "mapping", "read": "read", "stream_events": "search"}


class JsonlSource:
    """Read-only source of raw hits in JSON lines (`value`), one folder per index."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def discover_sources(self, pattern: str) -> list[str]:
        import fnmatch

        if not pattern:
            raise ValueError("an empty pattern")
        fs, p = self._fs()
        return sorted(n for s in fs.listStatus(p) if s.isDirectory() and fnmatch.fnmatch(n := s.getPath().getName(), pattern))

    def read(self, index: str) -> DataFrame:
        return self.spark.read.text(f"{self.root}/{index}")

    def discover_fields(self, index: str) -> list[str]:
        def names(t, prefix: str = "") -> Iterator[str]:
            for f in t.fields:
                if f.dataType.typeName() == "struct":
                    yield from names(f.dataType, f"{prefix}{f.name}.")
                else:
                    yield prefix + f.name

        source = self.spark.read.json(f"{self.root}/{index}")
        return sorted(names(source.schema["_source"].dataType)) if "_source" in source.columns else []

    def stream_events(self, canonical: DataFrame, start: str, end: str, size: int = 5000, after: tuple | None = None) -> Iterator[tuple[list, tuple]]:
        """Pages in (time, id) order with start <= time < end, and the place to
        resume from; a short page is the last."""
        rows = canonical.where((F.col("@timestamp") >= F.lit(start).cast("timestamp")) & (F.col("@timestamp") < F.lit(end).cast("timestamp")))
        rows = rows.withColumn("__t", F.unix_micros("@timestamp"))
        while True:
            page = rows if after is None else rows.where((F.col("__t") > after[0]) | ((F.col("__t") == after[0]) & (F.col("_id") > after[1])))
            got = page.orderBy("__t", "_id").limit(size).collect()
            if got:
                after = got[-1]["__t"], got[-1]["_id"]
                yield got, after
            if len(got) < size:
                return


class EventStore:
    """dataset/part Parquet tables with a commit marker and a quarantine."""

    def __init__(self, spark: SparkSession, root: str, dataset: str):
        if dataset not in DATASETS:
            raise ValueError(f"{dataset} is none of {DATASETS}")
        self.spark, self.base = spark, f"{root.rstrip('/')}/{dataset}"

    def write_batch(self, good: DataFrame, rejected: DataFrame, part: str, run_id: str) -> None:
        good.write.mode("append").option("compression", "zstd").parquet(f"{self.base}/raw/part={part}/run={run_id}")
        rejected.write.mode("append").json(f"{self.base}/quarantine/part={part}/run={run_id}")

    def _marker(self, part: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/raw/_manifest_{part}.json")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def finalize(self, part: str, run_id: str, total: int) -> None:
        fs, p = self._marker(part)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"run_id": run_id, "total": total}).encode()))
        out.close()

    def load(self, part: str) -> DataFrame:
        """Rows of a finalised part, one per id: the earliest, then the least in its other columns."""
        fs, p = self._marker(part)
        if not fs.exists(p):
            raise FileNotFoundError(f"part {part} is not finalised")
        rows = self.spark.read.parquet(f"{self.base}/raw/part={part}").drop("run")
        return dedup_exact(rows, "_id", [F.col("@timestamp")]).select(*rows.columns)


class ManifestLog:
    """Append-only log of runs: IN_PROGRESS, then COMPLETED or FAILED; a completed run is final."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, run_id: str, status: str, details: dict) -> None:
        row = (run_id, status, datetime.now(timezone.utc).isoformat(), json.dumps(details, sort_keys=True))
        self.spark.createDataFrame([row], "run_id string, status string, at string, details string").coalesce(1).write.mode("append").json(self.path)

    def state(self, run_id: str) -> str | None:
        try:
            rows = self.spark.read.schema("run_id string, status string, at string, details string").json(self.path)
            r = rows.where(F.col("run_id") == run_id).orderBy(F.desc("at")).first()
        except Exception as e:  # the log does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return r.status if r else None

    def initialize(self, config: dict) -> str:
        run_id = uuid.uuid4().hex
        self._append(run_id, "IN_PROGRESS", {"config_hash": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()})
        return run_id

    def close(self, run_id: str, ok: bool, **details) -> None:
        if self.state(run_id) == "COMPLETED":
            raise RuntimeError(f"run {run_id} is completed")
        self._append(run_id, "COMPLETED" if ok else "FAILED", details)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


class AnnotationLog:
    """Append-only labels; the newest label of a target is the maximum by time."""

    LABELS = ("true_positive", "false_positive", "benign", "needs_review", "unknown")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, target_id: str, target_type: str, label: str, analyst: str, timestamp: str, notes: str = "") -> None:
        if label not in self.LABELS:
            raise ValueError(label)
        self.spark.createDataFrame([(target_id, target_type, label, analyst, timestamp, notes)], "target_id string, target_type string, label string, analyst string, timestamp string, notes string").write.mode("append").json(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("target_id string, target_type string, label string, analyst string, timestamp string, notes string").json(self.path)

    def history(self, target_id: str) -> DataFrame:
        return self.rows().where(F.col("target_id") == target_id).orderBy("timestamp")

    def current(self) -> DataFrame:
        return self.rows().groupBy("target_id").agg(F.max_by("label", "timestamp").alias("label"))
