"""Settings, extraction, reports, the detector interface and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from chronosift import cli, settings
from chronosift.operators import base, reports
from chronosift.sources import extraction


def test_settings_and_scrubbing(tmp_path):
    (tmp_path / ".env").write_text("# note\nexport CHRONOSIFT_PAGE_SIZE='7'\nCHRONOSIFT_PASSWORD=hunter2\nOTHER=1\n")
    s = settings.load(str(tmp_path / ".env"), {"CHRONOSIFT_LOG_LEVEL": "DEBUG"})
    assert (s.page_size, s.log_level, s.password.reveal()) == (7, "DEBUG", "hunter2")
    assert "hunter2" not in repr(s) and settings.scrub("at http://me:pw@host: hunter2", s) == "at http://me:**********@host: **********"
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "none"), {"CHRONOSIFT_PAGE_SIZE": "0"})


def test_retries():
    calls, waits = [], []

    @extraction.retried(4, base_s=1.0, sleep=waits.append)
    def f():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "x"

    assert f() == "x" and len(calls) == 3 and 0.8 <= waits[0] <= 1 and 1.6 <= waits[1] <= 2
    with pytest.raises(extraction.ReadOnlyViolation):
        extraction.allow("delete")


def test_extraction_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.range(100).withColumn("t", F.col("id") * 10)
    mark, seen = extraction.Checkpoint(spark, f"file://{tmp_path}"), []

    def write(part, n):
        got = [r.id for r in part.collect()]
        if n == 2 and not any(m == 2 for m, _ in seen):
            seen.append((n, got))
            raise RuntimeError("stopped after the write")
        seen.append((n, got))
        return len(got)

    with pytest.raises(RuntimeError):
        extraction.extract(rows, "t", 0, 1000, write, mark, "r", 4)
    assert mark.load("r") == {"next": 2, "written": 50}
    assert extraction.extract(rows, "t", 0, 1000, write, mark, "r", 4) == 100
    assert [n for n, _ in seen] == [0, 1, 2, 2, 3] and {i for _, g in seen for i in g} == set(range(100))
    mark.clear("r")
    assert mark.load("r") is None


def test_metadata_and_replace(spark, tmp_path):
    d = spark.sql("SELECT * FROM VALUES ('2025-07-01T00:00:00Z', named_struct('ip', 'a'), 1), ('2025-07-03T00:00:00Z', named_struct('ip', 'b'), 2) AS t(`@timestamp`, source, n)")
    m = extraction.source_metadata(d)
    assert (m["doc_count"], m["field_count"], m["date_fields"], m["min_timestamp"].day, m["max_timestamp"].day) == (2, 3, ["@timestamp"], 1, 3)
    assert extraction.count_events(d) == 2 and extraction.count_events(d, "n > 1") == 1
    assert extraction.numeric_and_text(d) == (["n"], ["@timestamp"])
    d.select("n").write.parquet(f"file://{tmp_path}/t1")
    d.selectExpr("n + 5 AS n", "'x' AS more").write.parquet(f"file://{tmp_path}/t2")
    assert sorted((r.n, r.more) for r in extraction.scan(spark, f"file://{tmp_path}/t*").collect()) == [(1, None), (2, None), (6, "x"), (7, "x")]


def windows(spark, n=400):
    return spark.range(n).selectExpr("id AS window_id", "id % 7 + if(id = 390, 90, 0) AS event_count", "id % 3 AS distinct_users", "id % 5 AS distinct_ips", "concat('h', id % 4) AS host")


@pytest.mark.parametrize("name", sorted(base.KINDS))
def test_detectors_survive_saving(spark, tmp_path, name):
    d, features = windows(spark), ["host"] if name == "rarity" else ["event_count", "distinct_users", "distinct_ips"]
    one = base.KINDS[name](features)
    with pytest.raises(base.NotFrozenError):
        one.score(d)
    one.fit(d.where("window_id < 300"))
    with pytest.raises(base.ImmutableBaselineError):
        one.fit(d)
    path = f"file://{tmp_path}/{name}"
    one.save(spark, path)
    two = base.Detector.load(spark, path)
    rows = lambda x: {r.window_id: (r.raw_score, r.evidence, r.flagged) for r in x.predict(d).collect()}
    a, b = rows(one), rows(two)
    assert len(a) == 400 and a == b and all(0 <= e <= 1 for _, e, _ in a.values())
    if name == "statistical":
        assert a[390][2] and "event_count" in two.explain(d.where("window_id = 390")).first().explanation
    assert set(base.sample_gate([two], d)) == {name}


def test_artifacts_are_verified():
    with pytest.raises(ValueError, match="format 9.*unknown detector zzz.*missing"):
        base.verify([{"format": 9, "name": "pca", "features": ["a"]}, {"format": 1, "name": "zzz", "features": ["b"]}], ["a"])


def test_report_parts(spark, tmp_path):
    d = windows(spark).withColumns({"evidence_a": F.col("event_count") / 100.0, "ensemble_evidence": F.col("event_count") / 100.0, "primary_category": F.lit("statistical"), "flag": F.col("event_count") > 90})
    assert reports.medians(d, ["event_count"]) == {"event_count": 3.0}
    r = reports.report_rows(d.where("window_id = 390"), {"a": "evidence_a"}, {"event_count": 3.0, "distinct_ips": 0.0}).first()
    assert r.agreeing_detectors == ["a"] and r.baseline_ratios == {"event_count": 95 / 3, "distinct_ips": 0.0} and r.model_only and r.window_start == "1970-01-01T00:32:30Z"
    near = reports.neighbours(d.where("window_id in (0, 390)"), d, ["event_count"]).orderBy("window_id").collect()
    assert [(x.previous_event_count, x.next_event_count) for x in near] == [(None, 1), (389 % 7, 391 % 7)]
    rate = reports.anomaly_rates(d, F.col("flag")).first()
    assert (rate.windows, rate.flagged, rate.pct, rate.sane) == (400, 1, 0.25, True)
    with pytest.raises(ValueError, match="experiment_id.*dataset.days"):
        reports.results_package("", {"windows": 1}, {}, [])
    package = reports.results_package("e", {"windows": 1, "days": 1}, {"m": {"mean_pct": 1.0, "std_pct": 0.0}}, [{"window_id": 1, "x": "a|b"}])
    reports.write_report(spark, f"file://{tmp_path}/r", package)
    assert reports.read_report(spark, f"file://{tmp_path}/r") == package and "a\\|b" in (tmp_path / "r.md").read_text()


def test_all_stages(spark, tmp_path, capsys):
    src = tmp_path / "src" / "logs"
    src.mkdir(parents=True)
    hits = [{"_id": str(i % 290), "_source": {"@timestamp": 1751328000 + 5 * (i % 290), "user": {"name": f"u{i % 5}"}, "host": {"name": f"h{i % 3}"}, "source": {"ip": f"10.0.0.{i % 9}"}}} for i in range(300)] + [{"_source": {}}]
    (src / "a.jsonl").write_text("\n".join(map(json.dumps, hits)))
    s = settings.Settings(source_root=f"file://{tmp_path}/src", store_root=f"file://{tmp_path}/out", training_end="2025-07-01T00:20:00Z")
    assert cli.main(["run", "--index", "logs"], spark, s) == 0, capsys.readouterr().out
    summary = json.loads((tmp_path / "out/logs/summary.json").read_text())
    assert len(summary["stages"]) == 13 and summary["stages"][2]["result"] == {"unique": 290}
    assert json.loads((tmp_path / "out/logs/report.json").read_text())["dataset"]["windows"] == 50
    assert cli.main(["run", "--index", "logs", "--only", "rank"], spark, s) == 0
    assert cli.main(["run", "--index", "none"], spark, s) == 1
    assert cli.main(["discover", "sources"], spark, s) == 0 and '"logs"' in capsys.readouterr().out
