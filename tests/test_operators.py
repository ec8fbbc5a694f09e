"""Hand-computed cases and invariants of the telemetry operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronosift.functions import scalar as S
from chronosift.operators import baselines as B
from chronosift.operators import detectors as D
from chronosift.operators import features as X
from chronosift.operators import investigation as G
from chronosift.operators import profile as P
from chronosift.operators import windowing as WN
from chronosift.sources import canonical as C
from chronosift.sources import stores
from chronosift.streaming import router


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr("x").alias("y")).first().y


@pytest.mark.parametrize(
    "text,want",
    [("10.0.0.1", True), ("256.1.1.1", False), ("::1", True), ("2001:db8::8a2e:370:7334", True), ("x", False), (None, False), ("1.2.3", False)],
)
def test_ip(spark, text, want):
    assert one(spark, text, "string", S.valid_ip) is want


def test_internal_and_cmdline(spark):
    assert one(spark, "172.31.255.255", "string", S.is_internal)
    assert not one(spark, "172.32.0.0", "string", S.is_internal)
    # the address is read once for all networks
    assert spark.sql("SELECT '10.0.0.1' AS x").select(S.is_internal("x").alias("y"))._jdf.queryExecution().analyzed().toString().count("RLIKE") == 1
    assert one(spark, "C:\\Win\\cmd.exe  /c 10.1.2.3 deadbeefcafe 42", "string", S.normalize_cmdline) == "<PATH> <PATH> <IP> <HEX> <NUM>"
    assert one(spark, "", "string", S.normalize_cmdline) == "unknown"


def test_window_boundaries(spark):
    df = spark.sql("SELECT explode(array(-1L, 0L, 4999999L, 5000000L)) AS us").withColumn("ts", F.timestamp_micros("us"))
    assert [r.w for r in df.orderBy("us").select(WN.window_id("ts").alias("w")).collect()] == [-1, 0, 0, 1]


def test_gap_fill_is_dense_and_idempotent(spark):
    s = spark.createDataFrame([(100, 3), (103, 1)], "window_id long, event_count long")
    d = WN.dense(s, ["event_count"])
    want = [(100, 3), (101, 0), (102, 0), (103, 1)]
    assert sorted(map(tuple, d.collect())) == want
    assert sorted(map(tuple, WN.dense(d, ["event_count"]).collect())) == want
    assert WN.contiguity_gaps(d).count() == 0
    assert WN.dense(s.where("false"), ["event_count"]).count() == 0


def test_rolling_partial_frames(spark):
    rows = [(i, v, 0, 0, 0, 0) for i, v in enumerate([10] * 6 + [100])]
    d = spark.createDataFrame(rows, "window_id long, event_count long, distinct_users long, distinct_ips long, distinct_hosts long, distinct_processes long")
    r = {x.window_id: x for x in X.rolling_features(d, ("event_count",), {"30s": 6}).collect()}
    assert r[0].rolling_event_count_mean_30s == 10 and r[0].rolling_event_count_std_30s == 0
    assert r[6].rolling_event_count_sum_30s == 150


def test_lateness_boundary(spark):
    us = [0, 65_000_000, 1, 65_000_001, 2]
    e = spark.createDataFrame([(i, u) for i, u in enumerate(us)], "n long, us long").withColumn("ts", F.timestamp_micros("us"))
    got = WN.lateness(e, [F.col("n")], F.floor(F.col("n") / 2)).orderBy("n").collect()
    assert [r.status for r in got] == ["ON_TIME", "ON_TIME", "ON_TIME", "ON_TIME", "LATE"]


def test_registry():
    assert len(X.REGISTRY.names()) == 126
    with pytest.raises(ValueError):
        X.REGISTRY.register(X.REGISTRY.get("event_count"))
    assert len(X.REGISTRY.by_group("rolling")) == 60 and not X.REGISTRY.non_causal_features()


def test_robust_stats_and_guard(spark):
    d = spark.createDataFrame([(10.0,)] * 4 + [(100.0,)], "event_count double")
    r = B.robust_stats(d, ["event_count"]).first()
    assert (r["mean"], r.p50, r.mad, r.calibration_method) == (28.0, 10.0, 0.0, "robust")
    e = spark.sql("SELECT timestamp'2025-08-01 00:00:00' AS ts")
    with pytest.raises(WN.TemporalLeakageError):
        WN.guard_bounds(e, "ts", "2025-08-01")


def test_suite_freezes(spark, tmp_path):
    e = spark.sql("SELECT timestamp'2025-07-01 00:00:00' AS ts, 'a' AS user_name")
    build = {"users": lambda d: B.distinct_values(d, "user_name")}
    B.BaselineSuite(spark, f"file://{tmp_path}", "v1").fit(e, build, "ts", "2025-08-01").save()
    again = B.BaselineSuite(spark, f"file://{tmp_path}", "v1")
    with pytest.raises(B.ImmutableBaselineError):
        again.fit(e, build, "ts", "2025-08-01")
    assert again.load(["users"]).tables["users"].count() == 1
    with pytest.raises(B.ImmutableBaselineError):
        B.BaselineSuite(spark, f"file://{tmp_path}", "v2").load(["users"])


def test_calibration_is_right_continuous(spark):
    base = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 4)], "raw_score double")
    new = spark.createDataFrame([(0.5,), (2.0,), (3.0,), (9.0,)], "raw_score double")
    got = {r.raw_score: r.evidence for r in D.calibrate(new, base).collect()}
    assert got == {0.5: 0.0, 2.0: 0.75, 3.0: 0.75, 9.0: 1.0}


def test_detectors_find_the_outlier(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(400)] + [(400, 90.0, -40.0)]
    d = spark.createDataFrame(rows, "window_id long, a double, b double")
    train = d.where("window_id < 400")
    for m in (D.Pca(["a", "b"], 0.5), D.IsolationForest(["a", "b"], trees=30), D.Autoencoder(["a", "b"], 8, 1, rounds=5), D.SequenceModel(["a", "b"], rounds=4)):
        fitted = m.fit(train) if isinstance(m, (D.Pca, D.SequenceModel)) else m.fit(d if isinstance(m, D.IsolationForest) else train, "window_id")
        s = fitted.score(d)
        assert s.orderBy(F.desc("raw_score")).first().window_id == 400, type(m)
        if isinstance(m, D.SequenceModel):
            assert s.where("window_id = 0").first().raw_score == 0.0


def _rows(spark, evid):
    return spark.createDataFrame(
        [(s, e, 1, "u", "h", "1.1.1.1", "", "p") for s, e in evid], "start_s long, ensemble_evidence double, detector_agreement int, user string, host string, source_ip string, destination_ip string, process string"
    )


def test_episode_gap(spark):
    e = G.episodes(_rows(spark, [(0, 0.96), (15, 0.91), (31, 0.97), (40, 0.5), (60, 0.92)]))
    assert sorted((r.episode_start_s, r.episode_end_s, r.window_count) for r in e.collect()) == [(0, 15, 2), (31, 31, 1)]
    # an island that spans two days
    e = G.episodes(_rows(spark, [(86_395, 0.96), (86_405, 0.99), (90_000, 0.99)]))
    assert sorted((r.episode_start_s, r.window_count) for r in e.collect()) == [(86_395, 2), (90_000, 1)]


def test_model_only(spark):
    e = G.episodes(_rows(spark, [(1000, 0.99), (5000, 0.99)]))
    a = spark.createDataFrame([("x", 1300, ["h"]), ("y", 5301, ["h"])], "alert_id string, ts_s long, entities array<string>")
    assert [r.episode_start_s for r in G.model_only(e, a).collect()] == [5000]


def test_model_only_long_episodes(spark):
    kind = "episode_id string, episode_start_s long, episode_end_s long, peak_evidence double, users array<string>, ips array<string>, hosts array<string>"
    rng, names = np.random.default_rng(3), [f"n{i}" for i in range(6)]
    starts = np.sort(rng.integers(0, 400_000, 60)).tolist()
    rows = [(f"e{i}", s, s + int(rng.integers(0, 9000)), 1.0, rng.choice(names, 2).tolist(), [], []) for i, s in enumerate(starts)]
    # more slots of the tolerance than an array holds
    rows += [("age", 10**7, 10**12, 1.0, ["u", "n1"], [], []), ("quiet", 10**13, 10**13 + 10**12, 1.0, ["u", "n1"], [], [])]
    alerts = [(str(i), int(t), [str(rng.choice(names)), None, ""]) for i, t in enumerate(rng.integers(0, 400_000, 150))] + [("u", 10**12 + 300, ["u"]), ("v", 10**13 - 301, ["n1"])]
    a = spark.createDataFrame(alerts, "alert_id string, ts_s long, entities array<string>")
    hit = lambda r: any(r[1] - 300 <= t <= r[2] + 300 and set(n) & set(r[4]) for _, t, n in alerts)
    want = sorted(r[0] for r in rows if not hit(r))
    assert "quiet" in want and "age" not in want and 5 < len(want) < 55
    assert sorted(r.episode_id for r in G.model_only(spark.createDataFrame(rows, kind), a).collect()) == want


def test_canonicalise(spark):
    hits = [
        {"_id": "1", "_source": {"@timestamp": "2025-07-01T00:00:00Z", "event": {"category": "auth", "outcome": "FAILURE"}, "source": {"ip": "1.2.3.4", "port": "80"}, "zzz": 1}},
        {"_id": "2", "_source": {"@timestamp": 1751328000000, "category": ["a", "b"]}},
        {"_id": "3", "_source": {"message": "no time"}},
        {"_id": "4", "_source": {"@timestamp": "nonsense"}},
        {"_id": "5", "_source": {"@timestamp": "1999-01-01T00:00:00"}},
        {"_id": "6", "_source": {"@timestamp": "2050-01-01T00:00:00"}},
        {"_id": "7", "_source": {"@timestamp": "2025-07-01", "src_ip": "999.1.1.1"}},
        {"_source": {"@timestamp": "2025-07-01", "message": "x"}},
    ]
    d = spark.createDataFrame([(json.dumps(h),) for h in hits], "value string")
    c = C.canonicalise(d, now=F.lit("2030-01-01").cast("timestamp"))
    r = {x["_id"]: x for x in c.collect()}
    assert r["1"].event_category == ["auth"] and r["1"].event_outcome == "failure" and r["1"].source_port == 80 and json.loads(r["1"].raw_extra) == {"zzz": 1}
    assert r["2"].event_category == ["a", "b"] and r["2"].reject_reason is None
    assert [r[k].reject_reason for k in "34567"] == ["MISSING_TIMESTAMP", "INVALID_TIMESTAMP", "OUT_OF_RANGE_TIMESTAMP", "FUTURE_TIMESTAMP", "SCHEMA_ERROR"]
    good, bad = C.split_rejects(c)
    assert good.count() == 3 and bad.count() == 5 and good.columns == [f.name for f in C.schema().fields]
    assert any(len(k) == 64 for k in r)


def test_stores(spark, tmp_path):
    hits = [(json.dumps({"_id": str(i), "_source": {"@timestamp": f"2025-07-01T00:00:0{i % 5}Z"}}),) for i in range(10)]
    c = C.canonicalise(spark.createDataFrame(hits, "value string"), now=F.lit("2030-01-01").cast("timestamp"))
    good, bad = C.split_rejects(c)
    st = stores.EventStore(spark, f"file://{tmp_path}", "july")
    st.write_batch(good, bad, "2025-07", "r1")
    st.write_batch(good.where("_id < '3'"), bad, "2025-07", "r2")
    with pytest.raises(FileNotFoundError):
        st.load("2025-07")
    st.finalize("2025-07", "r1", 10)
    assert st.load("2025-07").count() == 10
    pages = [[r["_id"] for r in p] for p, _ in stores.JsonlSource(spark, f"file://{tmp_path}").stream_events(good, "2025-07-01", "2025-07-02", 4)]
    assert [len(p) for p in pages] == [4, 4, 2] and len({x for p in pages for x in p}) == 10
    log = stores.ManifestLog(spark, f"file://{tmp_path}/log")
    run = log.initialize({"a": 1})
    log.close(run, True)
    with pytest.raises(RuntimeError):
        log.close(run, True)
    notes = stores.AnnotationLog(spark, f"file://{tmp_path}/notes")
    notes.append("t", "episode", "benign", "x", "2025-01-01")
    notes.append("t", "episode", "true_positive", "x", "2025-01-02")
    assert notes.current().first().label == "true_positive" and notes.history("t").count() == 2


def test_dedup_and_report(spark):
    d = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 3, "y")], "_id string, o int, v string")
    assert sorted(map(tuple, P.dedup_exact(d, "_id", [F.col("o")]).collect())) == [("a", 1, "x"), ("b", 3, "y")]
    r = P.mapping_report(["user.name", "x"], {"user": ["user", "user.name"], "ip": ["src_ip"]})
    assert r == {"mapped": {"user": "user.name"}, "missing": ["ip"], "unmapped": ["x"], "coverage_pct": 50.0}


def test_stream_router(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    rows = [("s", "a", 0, 0), ("s", "b", 65_000_000, 1), ("s", "c", 1, 2), ("s", "d", 65_000_001, 3), ("s", "e", 2, 4)]
    schema = "stream string, _id string, ts_us long, arrival long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = router.route_late(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("routed").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        assert {r["_id"]: r.status for r in spark.table("routed").collect()} == {"a": "ON_TIME", "b": "ON_TIME", "c": "ON_TIME", "d": "ON_TIME", "e": "LATE"}
    finally:
        q.stop()
