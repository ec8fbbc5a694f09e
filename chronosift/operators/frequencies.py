"""Frequencies that grow batch by batch: partial counts are appended, totals are
their sums, and compaction replaces what it has summed in one step."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.operators.baselines import frequencies, merge_frequencies
from chronosift.session import stored
from chronosift.sources.extraction import _fs, read_text, write_text
from chronosift.sources.versions import VersionedTable

#: Name of a table and the fields that are its key.
PAIRS = {"user_ip": ("user_name", "source_ip"), "ip_host": ("source_ip", "host_name"), "process_command": ("process_name", "process_command_line")}


class FrequencyTables:
    """Under `root`, per name: `partial`/<batch> with the counts of one batch, and
    a versioned table `total` whose manifest names the batches it holds. A batch
    that is given again replaces its counts, or changes nothing once it is in the
    total, so replaying changes no total. Rows with a null in a key don't count."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables or PAIRS

    def _total(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}/total")

    def _held(self, name: str) -> list[str]:
        return self._total(name).manifest()["details"]["batches"] if self._total(name).current() else []

    def partials(self, name: str) -> list[str]:
        """Batches that are written whole and not yet in the total."""
        fs, p = _fs(self.spark, f"{self.root}/{name}/partial")
        have = sorted(n[: -len(".json")] for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".json") and not n.startswith(".")) if fs.exists(p) else []
        return [b for b in have if b not in self._held(name)]

    def append(self, events: DataFrame, batch: str) -> None:
        """Counts of one batch of events. A batch counts once its marker is
        written; the marker names the folder, so a stop leaves nothing half done."""
        for name, fields in self.tables.items():
            if batch in self._held(name):
                continue
            base = f"{self.root}/{name}/partial"
            last = json.loads(read_text(self.spark, f"{base}/{batch}.json") or '{"n": 0}')["n"]
            frequencies(events, *fields).write.mode("overwrite").parquet(f"{base}/{batch}-{last + 1}")
            write_text(self.spark, f"{base}/{batch}.json", json.dumps({"n": last + 1}))

    def _parts(self, name: str, batches: list[str]) -> list[DataFrame]:
        base = f"{self.root}/{name}/partial"
        numbers = {b: json.loads(read_text(self.spark, f"{base}/{b}.json"))["n"] for b in batches}
        return [self.spark.read.parquet(f"{base}/{b}-{n}") for b, n in numbers.items()] + ([self._total(name).read()] if self._total(name).current() else [])

    def totals(self, name: str) -> DataFrame:
        """The fields and n, over all batches."""
        parts = self._parts(name, self.partials(name))
        if not parts:
            raise FileNotFoundError(f"{self.root}/{name} has no batch")
        return merge_frequencies(parts, *self.tables[name])

    def compact(self, name: str) -> None:
        """Put the sums in place of the partial counts; readers see one or the other."""
        batches = self.partials(name)
        if not batches:
            return
        self._total(name).write(merge_frequencies(self._parts(name, batches), *self.tables[name]), batches=sorted({*self._held(name), *batches}))
        for b in batches:
            fs, p = _fs(self.spark, f"{self.root}/{name}/partial")
            for s in fs.listStatus(p):
                n = s.getPath().getName()
                if n == f"{b}.json" or n.rpartition("-")[0] == b:
                    fs.delete(s.getPath(), True)


def duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows, with `duplicate`: an earlier row (by `order`, which is unique
    within a key) has the same keys. Rows without one of the keys are none. The
    first of a key is a mergeable minimum, and the join can split a key of many
    rows."""
    first = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*order)).alias("__first"), F.count("*").alias("__n"))
    first = stored(first.where("__n > 1").drop("__n"), "first-of-keys")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)])
    out = df.join(first.hint("merge"), same, "left")
    return out.withColumn("duplicate", F.coalesce(F.struct(*order) > F.col("__first"), F.lit(False))).select(*df.columns, "duplicate")


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """input_rows, duplicate_rows (all but one of each key), by a count per key; no row is dropped."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"))
