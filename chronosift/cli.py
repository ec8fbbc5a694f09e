"""Command line: python -m chronosift.cli GROUP COMMAND, or `run` for all stages."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift import settings as conf
from chronosift.operators import base, investigation, profile, reports, windowing
from chronosift.operators import detectors as D
from chronosift.session import get_session
from chronosift.sources import canonical, extraction, stores
from chronosift.sources.versions import VersionedTable

FEATURES = ["event_count", "distinct_users", "distinct_ips", "distinct_hosts", "distinct_processes"]
MODELS = ("statistical", "rarity", "pca", "isolation_forest", "autoencoder", "sequence")


class Run:
    """Stages of one run over a folder: each reads what earlier ones wrote there."""

    def __init__(self, spark: SparkSession, s: conf.Settings, index: str):
        self.spark, self.s, self.index = spark, s, index
        self.root = f"{s.store_root.rstrip('/')}/{index}"
        self.source = extraction.ReadOnly(stores.JsonlSource(spark, s.source_root), stores.OPERATIONS)

    def _put(self, df: DataFrame, name: str) -> DataFrame:
        """A new version of a stage's table; a stop in between leaves the one before."""
        t = VersionedTable(self.spark, f"{self.root}/{name}")
        t.write(df, index=self.index)
        t.vacuum()
        return t.read()

    def _get(self, name: str) -> DataFrame:
        return VersionedTable(self.spark, f"{self.root}/{name}").read()

    def test_connection(self) -> dict:
        return {"connected": extraction.validate_connection(self.source, attempts=1)}

    def sources(self) -> dict:
        return {"sources": self.source.discover_sources(self.s.index_pattern)}

    def mapping(self) -> dict:
        meta = extraction.source_metadata(self.spark.read.json(f"{self.s.source_root.rstrip('/')}/{self.index}"))
        return {"fields": meta["fields"], "field_count": meta["field_count"], "doc_count": meta["doc_count"]}

    def ingest(self) -> dict:
        good, bad = canonical.split_rejects(canonical.canonicalise(self.source.read(self.index)))
        events = self._put(good, "events")
        bad.write.mode("overwrite").json(f"{self.root}/quarantine")
        return {"events": events.count()}

    def dedup(self) -> dict:
        first = self._get("events").groupBy("_id").agg(F.min(F.struct("@timestamp", "raw_timestamp")).alias("first"), F.count("*").alias("n"))
        rows = self._get("events").join(first, "_id").where(F.struct("@timestamp", "raw_timestamp") == F.col("first")).drop("first", "n").dropDuplicates(["_id"])
        return {"unique": self._put(rows.withColumn("ts", F.col("@timestamp")), "unique").count()}

    def profile(self) -> dict:
        r = profile.missingness(self._get("unique"), ["user_name", "source_ip", "host_name"], 5.0)
        return {"columns": self._put(r, "profile").count()}

    def index_windows(self) -> dict:
        return {"windows": self._put(windowing.window_summary(self._get("unique")), "index").count()}

    def windows(self) -> dict:
        d = windowing.window_dataset(self._get("unique")).select("window_id", *FEATURES)
        return {"windows": self._put(d, "windows").count()}

    def grid(self) -> dict:
        return {"windows": self._put(windowing.dense(self._get("windows"), FEATURES), "grid").count()}

    def split(self) -> dict:
        d = self._get("grid").withColumn("ts", F.timestamp_seconds(F.col("window_id") * windowing.WINDOW_S))
        a, b = windowing.temporal_split(d, "ts", self.s.training_end)
        return {"train": self._put(a, "train").count(), "new": self._put(b, "new").count()}

    def train(self) -> dict:
        for name in MODELS:
            base.KINDS[name](FEATURES).fit(self._get("train"), "ts", self.s.training_end).save(self.spark, f"{self.root}/models/{name}")
        return {"models": list(MODELS)}

    def verify(self) -> dict:
        found = [base.Detector.load(self.spark, f"{self.root}/models/{n}") for n in MODELS]
        return {"scores": base.sample_gate(found, self._get("new"))}

    def infer(self) -> dict:
        d = self._get("new")
        for n in MODELS:
            got = base.Detector.load(self.spark, f"{self.root}/models/{n}").predict(self._get("new"))
            d = d.join(got.select("window_id", F.col("evidence").alias(f"evidence_{n}")), "window_id")
        d = D.ensemble(d, {n: f"evidence_{n}" for n in MODELS})
        return {"windows": self._put(d, "scored").count()}

    def rank(self) -> dict:
        top = investigation.top_windows(self._get("scored"), [f"evidence_{n}" for n in MODELS], floor=None)
        rows = reports.report_rows(top, {n: f"evidence_{n}" for n in MODELS}, reports.medians(self._get("train"), FEATURES))
        return {"top": self._put(rows.drop("agreeing_detectors", "baseline_ratios"), "top").count()}

    def report(self) -> dict:
        scored = self._get("scored")
        rate = reports.anomaly_rates(scored, F.col("ensemble_flagged")).first().asDict()
        daily = investigation.daily_flag_rate(scored, F.col("ensemble_flagged")).first()
        top = [r.asDict() for r in self._get("top").orderBy(F.desc("ensemble_evidence"), F.desc("window_id")).collect()]  # a hundred rows at most
        package = reports.results_package(self.index, {"windows": rate["windows"], "days": (rate["windows"] or 0) * windowing.WINDOW_S / 86400}, {"ensemble": {"mean_pct": daily.mean_pct, "std_pct": daily.std_pct}}, top)
        reports.write_report(self.spark, f"{self.root}/report", package)
        return {"sane": rate["sane"], "top": len(top)}

    def stages(self) -> list[tuple[str, Callable[[], dict]]]:
        return [
            ("test-connection", self.test_connection), ("ingest", self.ingest), ("dedup", self.dedup), ("profile", self.profile), ("index", self.index_windows), ("windows", self.windows), ("grid", self.grid),
            ("split", self.split), ("train", self.train), ("verify", self.verify), ("infer", self.infer), ("rank", self.rank), ("report", self.report),
        ]

    def all(self, start_from: str | None = None, only: str | None = None) -> dict:
        """Stages in order, until one fails; the summary is written either way."""
        names = [n for n, _ in self.stages()]
        for x in (start_from, only):
            if x is not None and x not in names:
                raise ValueError(f"{x} is none of {names}")
        chosen = [x for x in self.stages() if x[0] == only] if only else self.stages()[names.index(start_from) if start_from else 0 :]
        summary: dict = {"index": self.index, "stages": [], "ok": True}
        for name, f in chosen:
            began = time.time()
            try:
                entry = {"ok": True, "result": f()}
            except Exception as e:
                entry = {"ok": False, "error": conf.scrub(str(e), self.s)[:2000]}
            summary["stages"].append({"name": name, "seconds": round(time.time() - began, 3)} | entry)
            if not entry["ok"]:
                summary["ok"] = False
                break
        extraction.write_text(self.spark, f"{self.root}/summary.json", json.dumps(summary, indent=1, default=str))
        return summary


#: group -> command -> the run's method
COMMANDS = {
    "ingest": {"test-connection": "test_connection", "run": "ingest"}, "discover": {"sources": "sources", "mapping": "mapping"}, "profile": {"run": "profile"},
    "window": {"index": "index_windows", "build": "windows"}, "pipeline": {"train": "train", "infer": "infer", "report": "report"},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronosift")
    groups = p.add_subparsers(dest="group", required=True)
    for group, commands in COMMANDS.items():
        g = groups.add_parser(group).add_subparsers(dest="command", required=True)
        for name in commands:
            g.add_parser(name).add_argument("--index", default="")
    r = groups.add_parser("run")
    r.add_argument("--index", required=True)
    r.add_argument("--start-from")
    r.add_argument("--only")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, s: conf.Settings | None = None) -> int:
    a = parser().parse_args(argv)
    s = s or conf.load()
    run = Run(spark or get_session(), s, a.index)
    if a.group == "run":
        out = run.all(a.start_from, a.only)
    else:
        out = {"ok": True} | getattr(run, COMMANDS[a.group][a.command])()
    print(json.dumps(out, default=str))
    return 0 if out["ok"] else 1


if __name__ == "__main__":
    raise SystemExit(main())
