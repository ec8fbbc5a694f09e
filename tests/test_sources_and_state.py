"""Versioned tables, sorted hits, incremental counts, novelty and streaming state."""

import glob
import json
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronosift.operators import features as X
from chronosift.operators import frequencies as Q
from chronosift.operators import novelty as N
from chronosift.operators import windowing as WN
from chronosift.sources import extraction, hits, stores
from chronosift.sources.versions import NoVersionError, VersionedTable
from chronosift.streaming import rolling, router


# ---- versions ----
def test_a_stopped_writer_leaves_the_old_version(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(NoVersionError):
        t.read()
    t.write(spark.range(5), run="a")
    new = t.stage(t.read().where("id > 2"))  # the writer stops before the pointer moves
    assert t.read().count() == 5 and len(t.versions()) == 2
    with pytest.raises(NoVersionError):
        t.publish("v-none")
    t.publish(new)
    assert sorted(r.id for r in t.read().collect()) == [3, 4]
    assert t.read(t.versions()[0]).count() == 5 and t.manifest(t.versions()[0])["details"] == {"run": "a"}
    assert [t.write(t.read().selectExpr("id + 1 AS id")) for _ in range(3)] and sorted(r.id for r in t.read().collect()) == [6, 7]
    assert len(t.vacuum(keep=1)) == 4 and t.versions() == [t.current()] and t.read().count() == 2
    assert not [f for f in os.listdir(tmp_path / "t") if f.endswith(".tmp")]


def test_manifest_tells_changed_files(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.write(spark.range(40).repartition(3))
    m = t.manifest()
    assert (m["rows"], m["files"]) == (40, 3) and len(m["schema_hash"]) == 64 and t.verify() == []
    a, b, c = sorted(glob.glob(f"{tmp_path}/t/{t.current()}/data/part-*"))
    size = sum(map(os.path.getsize, (a, b, c)))
    assert m["bytes"] == size
    os.replace(a, a.replace("part-", "part-x"))
    os.remove(os.path.join(os.path.dirname(b), f".{os.path.basename(b)}.crc"))
    raw = open(c, "rb").read()
    open(b, "wb").write(raw)
    assert sorted(x.split()[0] for x in t.verify()) == ["changed", "missing", "new"]


def test_text_is_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    for v in ("one", "two"):
        extraction.write_text(spark, path, v)
        assert extraction.read_text(spark, path) == v
    assert [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["x.json"]


def test_sources_are_read_only(spark, tmp_path):
    (tmp_path / "logs").mkdir()

    class Loud(stores.JsonlSource):
        def delete_by_query(self):
            raise AssertionError("it was called")

        def refresh(self):
            raise AssertionError("it was called")

    source = extraction.ReadOnly(Loud(spark, f"file://{tmp_path}"), stores.OPERATIONS)
    assert source.discover_sources("l*") == ["logs"] and source.root.endswith(str(tmp_path))
    with pytest.raises(extraction.ReadOnlyViolation, match="would change"):
        source.delete_by_query()
    with pytest.raises(extraction.ReadOnlyViolation, match="refresh"):
        source.refresh()


def test_load_keeps_the_same_row_of_an_id(spark, tmp_path):
    st = stores.EventStore(spark, f"file://{tmp_path}", "july")
    rows = [("a", 5, "y"), ("a", 3, "z"), ("a", 3, "b"), ("b", 1, None)]
    for parts, run in ((1, "r1"), (3, "r2")):
        d = spark.createDataFrame(rows, "_id string, `@timestamp` long, v string").repartition(parts)
        st.write_batch(d, d.where("false"), "p", run)
    st.finalize("p", "r1", 4)
    assert sorted(map(tuple, st.load("p").collect())) == [("a", 3, "b"), ("b", 1, None)]


# ---- ordered output ----
def test_a_day_is_in_few_files(spark, tmp_path):
    d = spark.range(20 * 17_280).selectExpr("id AS window_id", "id % 7 AS n").repartition(6)
    WN.write_ordered(d, f"file://{tmp_path}/o", files=20)
    spans = []
    for f in glob.glob(f"{tmp_path}/o/part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        s = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
        spans.append((min(x.min for x in s), max(x.max for x in s)))
        ids = pq.read_table(f, columns=["window_id"]).column(0).to_numpy()
        assert (np.diff(ids) > 0).all()
    spans.sort()
    assert len(spans) == 20 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    day = (9 * 17_280, 10 * 17_280 - 1)
    assert sum(a <= day[1] and z >= day[0] for a, z in spans) <= 3
    assert spark.read.parquet(f"file://{tmp_path}/o").where(F.col("window_id").between(*day)).count() == 17_280


# ---- hits ----
def some_hits(spark, n=1000):
    return spark.range(n).selectExpr("concat('e', lpad(id * 7919 % 1000, 4, '0')) AS _id", "id div 3 * 1000000 AS ts_us", "concat('{\"n\": ', id, '}') AS value").repartition(5)


def test_hits_are_planned_by_page(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    d = some_hits(spark)
    odd = spark.createDataFrame([(None, 5, "x"), ("y", None, "x")], "_id string, ts_us long, value string")
    hits.write_hits(d.unionByName(odd), path, 8)
    hits.register(spark)
    read = lambda **o: spark.read.format("hits").options(path=path, **o).load()
    every = read()
    assert every.rdd.getNumPartitions() == 8 and sorted(map(tuple, every.collect())) == sorted(map(tuple, d.collect()))
    pages = every.withColumn("p", F.spark_partition_id()).collect()
    assert [(r.ts_us, r["_id"]) for r in pages] == sorted((r.ts_us, r["_id"]) for r in pages)
    some = read(start="1970-01-01T00:00:10", end="1970-01-01T00:00:20Z")
    assert some.rdd.getNumPartitions() <= 2
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, d.where("ts_us >= 10000000 AND ts_us < 20000000").collect()))
    assert read(start="1990-01-01").count() == 0
    with pytest.raises(ValueError, match="lie before"):
        hits.write_hits(d.limit(3), path, 1)


def test_stream_of_hits_goes_on_where_it_stopped(spark, tmp_path):
    path, out, mark = (f"file://{tmp_path}/{x}" for x in ("h", "out", "cp"))
    hits.register(spark)
    d = some_hits(spark)

    def run():
        s = spark.readStream.format("hits").option("path", path).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        s.awaitTermination(180)
        assert s.exception() is None
        return spark.read.schema(hits.SCHEMA).parquet(out)

    bounds = [0, 100, 101, 1000]
    for a, z in zip(bounds, bounds[1:]):  # between the parts of one second, too
        part = d.orderBy("ts_us", "_id").limit(z).exceptAll(d.orderBy("ts_us", "_id").limit(a)) if a else d.orderBy("ts_us", "_id").limit(z)
        hits.write_hits(part, path, 3)
        got = run()
        assert got.count() == z == got.distinct().count()
        last = d.orderBy("ts_us", "_id").limit(z).agg(F.max(F.struct("ts_us", "_id")).alias("k")).first().k
        assert hits.resume_token(spark, mark) == {"ts_us": last.ts_us, "_id": last["_id"]}
    assert run().count() == 1000


# ---- frequencies and duplicates ----
def test_replayed_batches_change_nothing(spark, tmp_path):
    rows = [(f"p{i % 3}" if i % 5 else None, f"c{i % 4}", f"u{i % 2}") for i in range(200)]
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, process_name string, process_command_line string, user_name string").withColumn("source_ip", F.lit("a")).withColumn("host_name", F.lit("h"))
    t = Q.FrequencyTables(spark, f"file://{tmp_path}/f")
    with pytest.raises(FileNotFoundError):
        t.totals("user_ip")
    batch = lambda n: e.where(f"i % 4 = {n}")

    def counts(upto):
        out = {}
        for i, (p, c, _) in enumerate(rows):
            if p and i % 4 < upto:
                out[p, c] = out.get((p, c), 0) + 1
        return out

    got = lambda: {(r.process_name, r.process_command_line): r.n for r in t.totals("process_command").collect()}
    for n in range(3):
        t.append(batch(n), f"b{n}")
        t.append(batch(n), f"b{n}")
        assert got() == counts(n + 1)
    t.compact("process_command")
    assert t.partials("process_command") == [] and got() == counts(3)
    for name in ("b0", "b2"):
        t.append(batch(0), name)
    t.append(batch(3).limit(1), "b3")
    t.append(batch(3), "b3")
    assert got() == counts(4)
    t.compact("process_command")
    t.compact("process_command")
    assert got() == counts(4) and sum(r.n for r in t.totals("user_ip").collect()) == 200


def test_duplicates_stay(spark):
    rows = [("a", 1, 0), ("a", 1, 1), ("a", 2, 2), (None, 1, 3), (None, 1, 4), ("b", None, 5), ("a", 1, 6), ("b", 1, 7)]
    d = spark.createDataFrame(rows, "_id string, raw int, n int")
    got = {r.n: r.duplicate for r in Q.duplicates(d, ["_id", "raw"], ["n"]).collect()}
    assert got == {n: n in (1, 6) for n in range(8)}
    assert tuple(Q.duplicate_counts(d, ["_id", "raw"]).first()) == (8, 2)
    assert tuple(Q.duplicate_counts(d.where("false"), ["_id", "raw"]).first()) == (0, 0)


# ---- novelty ----
def test_inventory_equals_a_tracker(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 1751328000 + 1800 * i, f"u{rng.integers(0, 3 + i // 20)}" if i % 9 else None, f"h{rng.integers(0, 2 + i // 30)}", float(rng.normal() + i / 40)) for i in range(120)]
    d = spark.createDataFrame(rows, "_id int, s long, u string, h string, cpu double").withColumn("ts", F.timestamp_seconds("s")).repartition(4)
    cut = 16
    users, hosts, pairs, hours, own, top, want = set(), set(), set(), set(), {}, -1e9, []
    for i, s, u, h, cpu in rows:
        hour, new = s % 86400 // 3600, i >= cut
        if new and u and u not in users:
            want.append(("new_user", u, i))
        if new and h not in hosts:
            want.append(("new_host", h, i))
        if new and u and (u, h) not in pairs:
            want.append(("new_relationship", f"{u} -> {h}", i))
        if new and hour not in hours:
            want.append(("new_hour", str(hour), i))
        if new and u in own and own[u][0] and hour not in own[u][1]:
            want.append(("new_user_hour", f"{u} @ {hour}", i))
        if new and cpu > top:
            want.append(("record_cpu", str(i), i))
        top = max(top, cpu)
        hosts.add(h)
        hours.add(hour)
        if u:
            users.add(u)
            pairs.add((u, h))
            own.setdefault(u, (not new, set()))[1].add(hour)
    got = N.inventory(d.where(f"_id < {cut}"), d.where(f"_id >= {cut}"), "u", "h", {"cpu": "cpu"}, "_id")
    assert sorted((r.kind, r.entity, int(r.first_id)) for r in got.collect()) == sorted(want)
    assert {k for k, *_ in want} == {"new_user", "new_host", "new_relationship", "new_hour", "new_user_hour", "record_cpu"}
    maps = {r.u: r.hours for r in N.hour_maps(d, "u").collect()}
    assert maps == {u: sum(1 << h for h in {s % 86400 // 3600 for _, s, x, _, _ in rows if x == u}) for u in {r[2] for r in rows} - {None}}


# ---- registry ----
def test_the_registry_makes_every_feature_or_says_which_not(spark):
    rows = [(i, 5 * (i // 3) + i % 3, f"u{i % 4}", f"h{i % 2}", "10.0.0.1" if i % 2 else "9.9.9.9") for i in range(60) if i // 3 not in (4, 5, 6)]
    e = spark.createDataFrame(rows, "_id int, s long, user_name string, host_name string, source_ip string").withColumn("ts", F.timestamp_seconds("s"))
    null = F.lit(None).cast("string")
    e = e.withColumns({c: null for c in ("destination_ip", "process_name", "process_parent_name", "process_command_line", "network_protocol")})
    e = e.withColumns({"destination_port": F.lit(80), "event_category": F.when(F.expr("_id % 2 = 0"), "network").otherwise("process"), "event_action": F.lit("x"), "event_outcome": F.lit("success"), "window_id": WN.window_id("ts")})
    d = X.REGISTRY.compute(e)
    assert d.columns == ["window_id", *X.REGISTRY.names()] and d.count() == 17
    full = X.REGISTRY.compute(e, ["rolling_event_count_sum_30s", "event_count", "hour_of_day", "category_count", "previous_window_event_count", "user_entropy"], dense=True)
    got = {r.window_id: r for r in full.collect()}
    assert sorted(got) == list(range(20)) and got[5].event_count == 0 and got[5].user_entropy == 0 and got[5].category_count == {}
    assert got[7].rolling_event_count_sum_30s == 9 and got[7].previous_window_event_count == 0 and got[0].category_count == {"network": 2, "process": 1}
    with pytest.raises(ValueError, match="not registered: nope"):
        X.REGISTRY.compute(e, ["event_count", "nope"])
    lost = X.Registry()
    lost.register(X.Feature("odd", "g", "elsewhere"))
    with pytest.raises(ValueError, match="no stage makes: odd"):
        lost.compute(e)


# ---- streams ----
def run_stream(df, name, mark, tmp_path, mode="append"):
    q = df.writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}").option("checkpointLocation", f"file://{tmp_path}/{mark}").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None, q.exception()


def test_rolling_state_equals_the_batch_frames_over_restarts(spark, tmp_path):
    rng = np.random.default_rng(2)
    horizons, metrics = {"30s": 6, "1m": 12, "15m": 180}, ("event_count", "distinct_users")
    rows = [(s, w, int(rng.integers(0, 50)), int(rng.integers(0, 9))) for s in ("a", "b") for w in range(400)]
    schema = "stream string, window_id long, event_count long, distinct_users long"
    d = spark.createDataFrame(rows, schema)
    bounds = (0, 3, 150, 151, 400)
    for lo, hi in zip(bounds, bounds[1:]):  # each part by a query that starts again
        d.where(f"window_id >= {lo} AND window_id < {hi}").repartition(2).write.mode("append").parquet(f"file://{tmp_path}/in")
        run_stream(rolling.rolling_context(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), metrics, horizons), "out", "cp", tmp_path)
    names = [f"rolling_{m}_{s}_{h}" for h in horizons for m in metrics for s in ("mean", "sum", "std")]
    got = {(r.stream, r.window_id): tuple(r[n] for n in names) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert len(got) == 800
    for s in ("a", "b"):
        for r in X.rolling_features(d.where(f"stream = '{s}'"), metrics, horizons).collect():
            assert np.allclose(got[s, r.window_id], [r[n] for n in names], rtol=0, atol=0), (s, r.window_id)


def test_duplicates_of_a_stream_over_restarts(spark, tmp_path):
    schema = "_id string, raw_timestamp long, n int, ts timestamp"
    parts = [[("a", 1, 0), ("b", 1, 1), ("a", 1, 2)], [("a", 1, 3), ("a", 2, 4)], [("c", 1, 5), ("b", 1, 6)]]
    for rows in parts:
        spark.createDataFrame(rows, "_id string, raw_timestamp long, n int").withColumn("ts", F.timestamp_seconds(F.lit(1_000_000) + F.col("n"))).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        run_stream(rolling.flag_duplicates(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")), "out", "cp", tmp_path)
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert len(got) == 7
    for key in (("a", 1), ("b", 1), ("a", 2), ("c", 1)):
        flags = sorted(r.duplicate for r in got if (r["_id"], r.raw_timestamp) == key)
        assert flags == [False] + [True] * (len(flags) - 1)
    assert {r.n for r in got if r.duplicate} >= {3, 6}
    # hours later the watermark moves, and the key after that is new again
    for n in (20_000, 40_000):
        spark.createDataFrame([("a", 1, n)], "_id string, raw_timestamp long, n int").withColumn("ts", F.timestamp_seconds(F.lit(1_000_000) + F.col("n"))).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        run_stream(rolling.flag_duplicates(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")), "out", "cp", tmp_path)
    assert {r.n: r.duplicate for r in spark.read.parquet(f"file://{tmp_path}/out").where("n >= 20000").collect()}[40_000] is False


def test_windowed_counts(spark, tmp_path):
    rows = [(0,), (4,), (5,), (200,), (3,), (400,)]
    for i, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, "s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        run_stream(router.windowed_counts(spark.readStream.schema("s long, ts timestamp").parquet(f"file://{tmp_path}/in")), "out", "cp", tmp_path)
    got = {r.window_start.timestamp(): r.event_count for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got[0] == 2 and got[5] == 1 and 400 not in got  # the event at 3 s came behind the watermark


def test_resume_token_without_batches(spark, tmp_path):
    (tmp_path / "offsets").mkdir()
    (tmp_path / "offsets" / "0").write_text("v1\n" + json.dumps({"batchWatermarkMs": 0}) + "\n")
    assert hits.resume_token(spark, f"file://{tmp_path}") is None


# ---- transforms, reports and candidates ----
def test_transforms_refuse_what_is_not_frozen(spark, tmp_path):
    from chronosift.operators import baselines as B
    from chronosift.operators import transforms as T
    from chronosift.operators.base import NotFrozenError

    rows = [(float(i), "u" if i < 9 else "v") for i in range(1, 11)]
    train = spark.createDataFrame(rows, "x double, user_name string").withColumn("ts", F.timestamp_seconds(F.lit(1751328000)))
    build = {"stats": lambda d: B.robust_stats(d, ["x"]), "users": lambda d: B.frequencies(d, "user_name")}
    suite = B.BaselineSuite(spark, f"file://{tmp_path}", "v1").fit(train, build, "ts", "2025-08-01")
    for make in (lambda: T.RobustZ(suite, "x"), lambda: T.FrequencyRarity(suite, "users", ("user_name",))):
        with pytest.raises(NotFrozenError):
            make()
    suite.save()
    suite.load(["stats", "users"])
    new = spark.createDataFrame([(15.5, "u"), (5.5, "w"), (None, None)], "x double, user_name string")
    for t in (T.RobustZ, T.IqrDistance, T.TailDistance, T.PercentileRank):
        new = t(suite, "x").transform(new)
    out = {r.x: r for r in T.FrequencyRarity(suite, "users", ("user_name",)).transform(new).collect()}
    assert new.columns == ["x", "user_name", "x_robust_z", "x_iqr_distance", "x_tail_distance", "x_percentile_rank"]
    assert out[15.5].x_robust_z == 4.0 and out[15.5].x_iqr_distance == pytest.approx((15.5 - (7.75 + 1.5 * 4.5)) / 4.5)
    assert out[15.5].x_tail_distance == pytest.approx((15.5 - 9.91) / 4.5) and out[15.5].x_percentile_rank > 0.999 and out[5.5].x_percentile_rank == 0.5
    assert out[15.5].user_name_rarity == pytest.approx(-np.log10(8 / 10.5)) and out[5.5].user_name_rarity == out[None].user_name_rarity == pytest.approx(-np.log10(0.5 / 10.5))
    assert T.RobustZ(suite, "y").transform(new.withColumn("y", F.lit(3.0))).first().y_robust_z == 0.0


def test_stored_top_windows_are_read_back(spark, tmp_path):
    from chronosift.operators import reports

    top = spark.createDataFrame([(7, 0.99, "novelty", 8.0), (9, 0.95, "statistical", 2.0)], "window_id long, e double, primary_category string, n double")
    events = spark.createDataFrame([(7, "u", "h"), (7, "u", "h"), (7, "a", "h"), (7, "old", "h"), (7, None, "h"), (8, "z", "h")], "window_id long, u string, h string")
    base = spark.createDataFrame([("old", "h"), ("u", None)], "u string, h string")
    relations = reports.novel_relations(events, base, ("u", "h"))
    rows = reports.report_rows(top, {"d": "e"}, {"n": 4.0}, relations=relations)
    rows.drop("agreeing_detectors", "baseline_ratios", "novel_relations").write.parquet(f"file://{tmp_path}/top")
    got = {r.window_id: r for r in reports.parsed(spark.read.parquet(f"file://{tmp_path}/top")).collect()}
    assert got[7].novel_relations == ["a -> h", "u -> h"] and got[9].novel_relations == []
    assert got[7].agreeing_detectors == ["d"] and got[7].baseline_ratios == {"n": 2.0}
    assert "novel_relations" not in reports.report_rows(top, {"d": "e"}, {}).columns


def test_candidates_and_labels(spark):
    from chronosift.operators import investigation as G

    kind = "episode_id string, episode_start_s long, episode_end_s long, duration_s long, peak_evidence double, users array<string>, ips array<string>, hosts array<string>, evidence_trend array<double>"
    ep = spark.createDataFrame([("a", 1000, 1100, 105, 0.99, ["u"], [], [], [0.9]), ("b", 9000, 9000, 5, 0.96, ["u"], [], [], [0.9])], kind)
    alerts = spark.createDataFrame([("x", 1200, ["u"])], "alert_id string, ts_s long, entities array<string>")
    drift = spark.createDataFrame([("f", "Population Drift"), ("g", "No Drift"), ("c", "Individual Anomaly")], "feature string, status string")
    got = G.candidates(ep, alerts, drift).collect()
    assert [(r.episode_id, r.temporal_context, r.drift_context) for r in got] == [("b", ["repeat"], ["c: Individual Anomaly", "f: Population Drift"])]
    assert G.candidates(ep, alerts, drift.where("false")).first().drift_context == []
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "w int")
    assert {r.side: r.n for r in G.alert_contingency(k(1, 2, 2, 3), k(3, 4), "w", k(1, 3, 5, 6, 6)).collect()} == {"both": 1, "model_only": 2, "alert_only": 1, "neither": 2}
    labels = spark.createDataFrame([(1, "benign", 5), (1, "suspicious", 6), (3, "benign", 1)], "w int, label string, at int")
    got = {(r.side, r.label): (r.n, r.confirmed) for r in G.label_breakdown(k(1, 2, 3), k(3, 4), "w", labels).collect()}
    assert got == {("model_only", "suspicious"): (1, True), ("model_only", "pending"): (1, False), ("both", "benign"): (1, False), ("alert_only", "pending"): (1, False)}


def test_detector_refuses_rows_behind_the_bound(spark):
    from chronosift.operators import base

    d = spark.range(20).selectExpr("id AS window_id", "id AS event_count").withColumn("ts", F.timestamp_seconds(F.col("window_id") * 5))
    with pytest.raises(WN.TemporalLeakageError):
        base.Statistical(["event_count"]).fit(d, "ts", "1970-01-01T00:01:00")
    m = base.Statistical(["event_count"])
    with pytest.raises(base.NotFrozenError):
        m.score(d)
    m.fit(d, "ts", "1970-01-01T00:02:00")
    with pytest.raises(Exception, match="statistical"):
        m.fit(d)


def test_ping_is_tried_again(spark):
    class Flaky:
        calls = 0

        def _fs(self):
            self.calls += 1
            if self.calls < 3:
                raise ConnectionError("away")

            class Fs:
                @staticmethod
                def exists(path):
                    return True

            return Fs, "p"

    waits = []
    f = Flaky()
    assert extraction.validate_connection(f, sleep=waits.append) and f.calls == 3 and len(waits) == 2
    f.calls = -9
    with pytest.raises(ConnectionError):
        extraction.validate_connection(f, attempts=2, sleep=waits.append)


def test_window_starts(spark):
    d = spark.createDataFrame([(-1,), (0,), (3,)], "w long")
    got = [r.s.timestamp() for r in d.orderBy("w").select(WN.window_start("w").alias("s")).collect()]
    assert got == [-5.0, 0.0, 15.0]
    zoned = spark.sql("SELECT timestamp'2025-07-01 02:00:03+02:00' AS a, timestamp'2025-07-01 00:00:03' AS b")
    assert zoned.select((WN.window_id("a") == WN.window_id("b")).alias("same")).first().same
