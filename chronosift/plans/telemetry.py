"""Queries over the driver's tables that apply the telemetry operators, each
with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.functions import scalar as S
from chronosift.operators import baselines as B
from chronosift.operators import detectors as D
from chronosift.operators import features as X
from chronosift.operators import investigation as G
from chronosift.operators import novelty as N
from chronosift.operators import profile as P
from chronosift.operators import reports as R
from chronosift.operators import sequence as Q
from chronosift.operators import windowing as WN
from chronosift.operators.frequencies import FrequencyTables, duplicates
from chronosift.plans.adapter import SPLIT, SPLIT_S, canonical_events, ev_sql
from chronosift.session import stored, table, work_path
from chronosift.sources import canonical as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR = 3600


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles rounded to six places, so that sums in another order compare equal."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = WN.window_dataset(canonical_events(spark, sf_dir))
    return d.orderBy(F.desc("event_count"), "window_id").limit(20)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = canonical_events(spark, sf_dir)
    return e.withColumn("window_id", WN.window_id("ts", HOUR)).withColumn("process_command_line", F.expr("concat('/usr/bin/run', k % 3, ' -n ', event_id, ' 10.0.0.', k % 50)"))


EV = "WITH " + ev_sql()
EH = "WITH " + ev_sql(HOUR)


# ---- canonical events, windows, grids ----
@query(EV + "SELECT id AS _id, t AS ts_us, user_name, source_ip, destination_ip, destination_port, host_name, process_name, event_category, event_action, event_outcome FROM ev")
def canonical_view(spark, sf_dir):
    e = canonical_events(spark, sf_dir)
    return e.select("_id", F.unix_micros("ts").alias("ts_us"), "user_name", "source_ip", "destination_ip", "destination_port", "host_name", "process_name", "event_category", "event_action", "event_outcome")


@query(
    EV + """, h AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'bad.ip' ELSE source_ip END AS sip, k % 11 = 0 AS untimed, k % 23 = 0 AS late, k % 19 = 0 AS numbered FROM ev)
    SELECT CASE WHEN k % 7 = 0 AND NOT untimed AND NOT late THEN sha256(concat_ws('|', strftime(make_timestamp(CASE WHEN numbered THEN t // 1000000 * 1000000 ELSE t END), '%Y-%m-%d %H:%M:%S')
      || CASE WHEN numbered OR t % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(t % 1000000 AS VARCHAR), 6, '0') END || '+00:00', host_name,
      '[' || chr(39) || event_category || chr(39) || CASE WHEN k % 2 = 0 THEN ', ' || chr(39) || 'all' || chr(39) ELSE '' END || ']',
      event_action, 'None', CASE WHEN k % 3 = 0 THEN '{"a": ' || k || '}' ELSE 'none' END)) WHEN k % 7 = 0 THEN '-' ELSE id END AS _id,
    CASE WHEN untimed OR late THEN NULL WHEN numbered THEN t // 1000000 * 1000000 ELSE t END AS ts_us, lower(event_outcome) AS event_outcome, sip AS source_ip, destination_port, host_name, user_name,
    CASE WHEN k % 3 = 0 THEN '{"a": ' || k || '}' END AS message, event_category || CASE WHEN k % 2 = 0 THEN ',all' ELSE '' END AS categories,
    '{"count":' || k || CASE WHEN k % 2 = 0 THEN ',"deep":{"x":[1,"y"]}' ELSE '' END || ',"src_ip":"9.9.9.9"' || CASE WHEN untimed THEN '' ELSE ',"timestamp":"x"' END || CASE WHEN user_name IS NULL THEN ',"user":{}' ELSE '' END || '}' AS raw_extra,
    CASE WHEN untimed THEN 'MISSING_TIMESTAMP' WHEN late THEN 'INVALID_TIMESTAMP' WHEN k % 10 = 0 THEN 'SCHEMA_ERROR' END AS reject_reason FROM h"""
)
def canonicalise_hits(spark, sf_dir):
    """Raw hits made of the events, canonicalised again: nested and flat keys, lists, text that looks like an object, times as text and numbers, missing ids, rejects."""
    e = canonical_events(spark, sf_dir)
    iso, seconds = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.floor(F.unix_micros("ts") / 1_000_000).cast("string")
    time = F.when(F.expr("k % 19 = 0"), seconds).otherwise(F.concat(F.lit('"'), iso, F.lit('"')))
    stamp = F.when(F.expr("k % 11 = 0"), "").when(F.expr("k % 23 = 0"), '"@timestamp":"no time","timestamp":"x",').otherwise(F.concat(F.lit('"@timestamp":'), time, F.lit(',"timestamp":"x",')))
    named = F.to_json(F.struct(
        F.struct(F.upper("event_outcome").alias("outcome"), F.col("event_action").alias("action"), F.when(F.expr("k % 2 = 0"), F.array("event_category", F.lit("all"))).otherwise(F.array("event_category")).alias("category")).alias("event"),
        F.struct(F.when(F.expr("k % 10 = 0"), "bad.ip").otherwise(F.col("source_ip")).alias("ip")).alias("source"), F.struct(F.col("destination_port").alias("port")).alias("destination"),
        F.struct(F.col("host_name").alias("name")).alias("host"), F.struct(F.col("user_name").alias("name")).alias("user"), F.lit("9.9.9.9").alias("src_ip"), F.col("k").alias("count"),
        F.when(F.expr("k % 2 = 0"), F.parse_json(F.lit('{"x":[1,"y"]}'))).alias("deep"), F.when(F.expr("k % 3 = 0"), F.concat(F.lit('{"a": '), F.col("k").cast("string"), F.lit("}"))).alias("message"),
    ))
    own = F.when(F.expr("k % 7 = 0"), "").otherwise(F.concat(F.lit('"_id":"'), F.col("_id"), F.lit('",')))
    hits = e.select(F.concat(F.lit("{"), own, F.lit('"_source":{'), stamp, F.substring(named, 2, 1 << 20), F.lit("}")).alias("value"))
    c = C.canonicalise(hits, now=F.lit("2030-01-01").cast("timestamp"))
    timed = ~F.coalesce(F.col("reject_reason").isin("MISSING_TIMESTAMP", "INVALID_TIMESTAMP"), F.lit(False))
    return c.select(
        F.when(timed | (F.length("_id") < 64), F.col("_id")).otherwise("-").alias("_id"), F.when(timed, F.unix_micros("@timestamp")).alias("ts_us"), "event_outcome", "source_ip", "destination_port", "host_name", "user_name",
        "message", F.array_join("event_category", ",").alias("categories"), "raw_extra", "reject_reason",
    )


@query(EV + "SELECT event_id, w AS window_id FROM ev")
def window_id_assign(spark, sf_dir):
    return canonical_events(spark, sf_dir).select("event_id", WN.window_id("ts").alias("window_id"))


@query(EV + "SELECT id AS _id, w AS window_id FROM ev")
def event_index(spark, sf_dir):
    return WN.event_index(canonical_events(spark, sf_dir))


@query(EV + "SELECT w AS window_id, count(*) AS event_count FROM ev GROUP BY w")
def window_summary(spark, sf_dir):
    return WN.window_summary(canonical_events(spark, sf_dir))


_DATASET = """g AS (SELECT w AS window_id, count(*) AS event_count, count(DISTINCT user_name) AS distinct_users, count(DISTINCT source_ip) AS distinct_ips,
    count(DISTINCT host_name) AS distinct_hosts, count(DISTINCT process_name) AS distinct_processes FROM ev GROUP BY w)"""
_CALENDAR = """CAST(extract('hour' FROM make_timestamp(window_id * 5000000)) AS INT) AS hour_of_day, CAST(extract('minute' FROM make_timestamp(window_id * 5000000)) AS INT) AS minute_of_hour,
    CAST(extract('dow' FROM make_timestamp(window_id * 5000000)) AS INT) AS day_of_week, CAST(extract('day' FROM make_timestamp(window_id * 5000000)) AS INT) AS day_of_month,
    CAST(window_id % 17280 AS INT) AS window_position_in_hour, extract('dow' FROM make_timestamp(window_id * 5000000)) IN (0, 6) AS is_weekend"""
_GRID = "grid AS (SELECT unnest(range((SELECT min(window_id) FROM g), (SELECT max(window_id) FROM g) + 1)) AS window_id)"
_COUNTS = ("event_count", "distinct_users", "distinct_ips", "distinct_hosts", "distinct_processes")
_DENSE = "d AS (SELECT window_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _COUNTS) + " FROM grid LEFT JOIN g USING (window_id))"


@query(EV + f", {_DATASET} SELECT *, {_CALENDAR} FROM g")
def window_dataset(spark, sf_dir):
    return WN.window_dataset(canonical_events(spark, sf_dir))


@query(EV + f", {_DATASET}, {_GRID} SELECT window_id, coalesce(event_count, 0) AS event_count FROM grid LEFT JOIN g USING (window_id)")
def dense_window_summary(spark, sf_dir):
    return WN.dense(WN.window_summary(canonical_events(spark, sf_dir)), ["event_count"])


def _dense(spark, sf_dir) -> DataFrame:
    return WN.dense(WN.window_dataset(canonical_events(spark, sf_dir)).select("window_id", *_COUNTS), list(_COUNTS))


@query(EV + f", {_DATASET}, {_GRID}, {_DENSE} SELECT *, {_CALENDAR} FROM d")
def dense_window_dataset(spark, sf_dir):
    return WN.calendar(_dense(spark, sf_dir))


@query(EV + f", {_DATASET} SELECT window_id FROM (SELECT window_id, lead(window_id) OVER (ORDER BY window_id) AS n FROM g) WHERE n IS NOT NULL AND n <> window_id + 1")
def contiguity_check(spark, sf_dir):
    return WN.contiguity_gaps(WN.window_summary(canonical_events(spark, sf_dir)).select("window_id"))


@query(EV + f"SELECT CASE WHEN t < {SPLIT_S}000000 THEN 'train' ELSE 'validation' END AS part, count(*) AS n FROM ev GROUP BY 1")
def temporal_split(spark, sf_dir):
    a, b = WN.temporal_split(canonical_events(spark, sf_dir), "ts", SPLIT)
    return a.select(F.lit("train").alias("part")).unionByName(b.select(F.lit("validation").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


@query(EV + """SELECT event_id, CASE WHEN max(t) OVER (ORDER BY (event_id * 7919) % 10007, event_id ROWS UNBOUNDED PRECEDING) > (w + 1) * 5000000 + 60000000
    THEN 'LATE' ELSE 'ON_TIME' END AS status FROM ev""")
def late_events(spark, sf_dir):
    a = F.expr("(event_id * 7919) % 10007")
    return WN.lateness(canonical_events(spark, sf_dir), [a, F.col("event_id")], F.floor(a / 100)).select("event_id", "status")


# ---- profile, dedup, generic ----
def _with_copies(spark, sf_dir) -> DataFrame:
    e = canonical_events(spark, sf_dir)
    return e.unionByName(e.where("event_id % 20 = 0"))


_COPIES = ", u AS (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE event_id % 20 = 0)"


@query(EV + "SELECT id AS _id, t AS ts_us, host_name FROM ev")
def dedup_exact(spark, sf_dir):
    d = P.dedup_exact(_with_copies(spark, sf_dir).select("_id", "ts", "host_name"), "_id", [F.col("ts")])
    return d.select("_id", F.unix_micros("ts").alias("ts_us"), "host_name")


@query(EV + _COPIES + """SELECT count(*) AS input_rows, count(*) - count(DISTINCT id) AS duplicate_rows, count(DISTINCT id) AS retained_rows,
    round((count(*) - count(DISTINCT id)) / count(*) * 100, 6) AS duplicate_pct FROM u""")
def dedup_metrics(spark, sf_dir):
    return r6(P.dedup_metrics(_with_copies(spark, sf_dir), "_id"))


_FILLED = ("user_name", "source_ip", "host_name", "process_name", "process_parent_name")


@query(EV + "SELECT count(*) AS rows, epoch_us(min(ts)) AS min_us, epoch_us(max(ts)) AS max_us, count(DISTINCT id) AS distinct_ids, " + ", ".join(f"count({c}) AS filled_{c}" for c in _FILLED) + " FROM ev")
def profile_counts(spark, sf_dir):
    p = P.profile(canonical_events(spark, sf_dir), list(_FILLED), ["user_name", "source_ip", "host_name"])
    return p.select("rows", F.unix_micros("min_ts").alias("min_us"), F.unix_micros("max_ts").alias("max_us"), "distinct_ids", *[f"filled_{c}" for c in _FILLED])


@query(
    EV + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 6) AS pct, (count(*) - count({c})) / count(*) * 100 > 5 AS flagged FROM ev" for c in _FILLED)
)
def profile_missingness(spark, sf_dir):
    return r6(P.missingness(canonical_events(spark, sf_dir), list(_FILLED), 5.0))


for _unit in ("hour", "day"):

    def _volume(spark, sf_dir, unit=_unit):
        return P.volume(canonical_events(spark, sf_dir), unit).select(F.unix_timestamp("bucket").alias("bucket_s"), "n")

    QUERIES[f"{_unit}ly_volume" if _unit == "hour" else "daily_volume"] = _volume
    SQL[f"{_unit}ly_volume" if _unit == "hour" else "daily_volume"] = EV + f"SELECT CAST(epoch(date_trunc('{_unit}', ts)) AS BIGINT) AS bucket_s, count(*) AS n FROM ev GROUP BY 1"


@query(EV + f", {_DATASET} SELECT count(*) AS rows, CAST(sum(event_count) AS BIGINT) AS total, min(event_count) AS least, max(event_count) AS largest FROM g")
def global_stats(spark, sf_dir):
    return WN.global_stats(WN.window_summary(canonical_events(spark, sf_dir)), "event_count")


@query(EV + _COPIES + "SELECT round((1 - count(DISTINCT id) / count(*)) * 100, 6) AS duplicate_rate_pct FROM u")
def duplicate_rate(spark, sf_dir):
    return r6(P.profile(_with_copies(spark, sf_dir), ["user_name"], ["user_name"]).select("duplicate_rate_pct"))


@query(EV + "SELECT event_category, event_outcome, count(*) AS n FROM ev GROUP BY ALL")
def profile_group_counts(spark, sf_dir):
    return canonical_events(spark, sf_dir).groupBy("event_category", "event_outcome").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def topk_filter_group(spark, sf_dir):
    t = P.top_groups(table(spark, sf_dir, "lineitem"), F.col("l_quantity") < 10, "l_suppkey", "l_extendedprice")
    return t.withColumn("total", F.round("total", 2))


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def upsert_latest(spark, sf_dir):
    return P.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT CAST(least(greatest(floor(value / 500 * 20), 0), 19) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def value_histogram(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "events"), "value", 0, 500)


# ---- scalar functions ----
@query(EV + "SELECT event_id, CASE WHEN k % 10 = 0 THEN 'bad.ip' ELSE source_ip END AS ip, k % 10 <> 0 AS valid, k % 10 <> 0 AND (source_ip LIKE '10.%') AS internal FROM ev")
def ip_predicates(spark, sf_dir):
    e = canonical_events(spark, sf_dir).withColumn("ip", F.when(F.expr("k % 10 = 0"), "bad.ip").otherwise(F.col("source_ip")))
    return e.select("event_id", "ip", S.valid_ip("ip").alias("valid"), S.is_internal("ip").alias("internal"))


_COMMANDS = (
    r"'/bin/run  -N ' || event_id || ' 10.0.0.' || k % 50", r"'C:~Tools~x.exe -a~b k:' || k || ' a:b c:~'", r"'sha 0xDEADBEEF' || k || ' deadbeef' || k % 10 || ' cafe'",
    r"'id_123e4567-e89b-12d3-a456-4266141740' || lpad(CAST(k % 90 + 10 AS STRING), 2, '0') || '  end '", r"''", r"'ping 1.2.3.4.5 10.1.1.' || k || ' 0x1f ' || event_id || 'ms'",
)
_COMMAND = "translate(CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_COMMANDS)) + " END, '~', chr(92))"
_MASKS = (("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"), (r"\b\d{1,3}(\.\d{1,3}){3}\b", "<IP>"), (r"\b[0-9a-f]{8,}\b", "<HEX>"), (r"\b\d+\b", "<NUM>"))


def _masked_sql() -> str:
    x = "lower(cmd)"
    for pattern, mask in _MASKS:
        x = f"regexp_replace({x}, '{pattern}', '{mask}', 'g')"
    token = r"CASE WHEN contains(w, '/') OR (contains(w, chr(92)) AND NOT starts_with(w, '-')) OR regexp_matches(w, '^[a-z]:\\') THEN '<PATH>' ELSE w END"
    return f"CASE WHEN cmd = '' THEN 'unknown' ELSE array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''), lambda w: {token}), ' ') END"


@query(EV + f", c AS (SELECT event_id, {_COMMAND} AS cmd FROM ev) SELECT event_id, {_masked_sql()} AS pattern FROM c")
def cmdline_patterns(spark, sf_dir):
    """Paths, switches, addresses, hashes, numbers and identifiers, with and without word boundaries."""
    e = canonical_events(spark, sf_dir)
    return e.select("event_id", S.normalize_cmdline(F.expr(_COMMAND)).alias("pattern"))


@query(
    EV + """SELECT event_id, sha256(concat_ws('|', strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S') || CASE WHEN t % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(t % 1000000 AS VARCHAR), 6, '0') END || '+00:00',
    host_name, '[' || chr(39) || event_category || chr(39) || ', ' || chr(39) || 'x"y' || chr(39) || ']', coalesce(event_action, 'None'), coalesce(process_parent_name, 'None'), coalesce(lower(trim(user_name)), 'none'))) AS made_id FROM ev"""
)
def deterministic_ids(spark, sf_dir):
    e = canonical_events(spark, sf_dir)
    return e.select("event_id", C.deterministic_id(F.col("ts"), F.col("host_name"), F.array("event_category", F.lit('x"y')), F.col("event_action"), F.col("process_parent_name"), F.upper("user_name")).alias("made_id"))


# ---- features on hourly windows ----
def _u(c: str) -> str:
    return f"coalesce(nullif({c}, ''), 'unknown')"


_CONN = f"concat_ws(':', {_u('source_ip')}, {_u('destination_ip')}, coalesce(CAST(nullif(destination_port, 0) AS VARCHAR), 'unknown'))"
_PORT = "coalesce(nullif(destination_port, 0), -1)"


def _div(a: str, b: str, name: str) -> str:
    return f"round(CAST(count(DISTINCT ({a}, {b})) AS DOUBLE) / count(DISTINCT {a}), 6) AS {name}"


def _n(x: str, name: str) -> str:
    return f"CAST(count(DISTINCT {x}) AS DOUBLE) AS {name}"


_LOGIN = "event_category = 'authentication' AND event_action IN ('logon', 'login')"
FLAT_SQL = {
    "event_count": "CAST(count(*) AS DOUBLE) AS event_count", "events_per_second": "round(count(*) / 5.0, 6) AS events_per_second",
    **{f"{n}": f"CAST(count(*) FILTER (event_category = '{c}') AS DOUBLE) AS {n}" for n, c in (("authentication_volume", "authentication"), ("network_volume", "network"), ("process_volume", "process"), ("file_activity_volume", "file"))},
    "distinct_users": "CAST(count(DISTINCT user_name) AS DOUBLE) AS distinct_users",
    "active_hosts": _n(_u("host_name"), "active_hosts"), "host_user_diversity": _div(_u("host_name"), _u("user_name"), "host_user_diversity"), "host_ip_diversity": _div(_u("host_name"), _u("source_ip"), "host_ip_diversity"),
    "host_process_diversity": _div(_u("host_name"), _u("process_name"), "host_process_diversity"), "host_category_diversity": _div(_u("host_name"), _u("event_category"), "host_category_diversity"),
    "unique_source_ips": _n(_u("source_ip"), "unique_source_ips"), "unique_destination_ips": _n(_u("destination_ip"), "unique_destination_ips"),
    "internal_source_ratio": "round(avg(CASE WHEN source_ip LIKE '10.%' THEN 1.0 ELSE 0.0 END), 6) AS internal_source_ratio",
    "ip_user_diversity": _div(_u("source_ip"), _u("user_name"), "ip_user_diversity"), "ip_host_diversity": _div(_u("source_ip"), _u("host_name"), "ip_host_diversity"),
    "network_unique_destinations": _n(_u("destination_ip"), "network_unique_destinations"), "unique_destination_ports": _n(_PORT, "unique_destination_ports"),
    "source_destination_diversity": _div(_u("source_ip"), _u("destination_ip"), "source_destination_diversity"), "host_network_relationships": _div(_u("host_name"), _CONN, "host_network_relationships"),
    "active_processes": _n(_u("process_name"), "active_processes"), "process_host_diversity": _div(_u("process_name"), _u("host_name"), "process_host_diversity"),
    "process_user_diversity": _div(_u("process_name"), _u("user_name"), "process_user_diversity"), "parent_child_diversity": _div(_u("process_name"), _u("process_parent_name"), "parent_child_diversity"),
    "active_users": _n(_u("user_name"), "active_users"), "login_volume": f"CAST(count(*) FILTER ({_LOGIN}) AS DOUBLE) AS login_volume",
    "failed_login_ratio": f"round(coalesce(count(*) FILTER ({_LOGIN} AND event_outcome = 'failure') / nullif(CAST(count(*) FILTER ({_LOGIN}) AS DOUBLE), 0), 0), 6) AS failed_login_ratio",
    "user_host_diversity": _div(_u("user_name"), _u("host_name"), "user_host_diversity"), "user_ip_diversity": _div(_u("user_name"), _u("source_ip"), "user_ip_diversity"),
    "user_process_diversity": _div(_u("user_name"), _u("process_name"), "user_process_diversity"),
}

for _group in ("volume", "users", "hosts", "ips", "processes", "network"):
    _names = [f.name for f in X.REGISTRY.by_group(_group) if f.stage == "flat"]

    def _features(spark, sf_dir, names=tuple(_names)):
        return r6(X.REGISTRY.compute(hourly(spark, sf_dir), list(names)))

    QUERIES[f"{_group}_features"] = _features
    SQL[f"{_group}_features"] = EH + "SELECT w AS window_id, " + ", ".join(FLAT_SQL[n] for n in _names) + " FROM ev GROUP BY w"

_MELT = {"user_name": _u("user_name"), "source_ip": _u("source_ip"), "host_name": _u("host_name"), "process_name": _u("process_name"), "destination_ip": _u("destination_ip"), "network_protocol": _u("network_protocol"), "event_category": _u("event_category"), "connection": _CONN, "cmdline": "'<PATH> -n <NUM> <IP>'"}


def _melt_sql(stat: str) -> str:
    picked = [f for f in X.REGISTRY.all_features() if f.stage == "melt" and f.spec[1] == stat]
    parts = " UNION ALL ".join(f"SELECT w, '{f}' AS field, {_MELT[f]} AS v FROM ev" for f in dict.fromkeys(x.spec[0] for x in picked))
    value = "CASE WHEN count(*) = 1 THEN 0.0 ELSE -sum(p * log2(p)) END" if stat == "entropy" else "sum(p * p)"
    cols = ", ".join(f"max(x) FILTER (field = '{f.spec[0]}') AS {f.name}" for f in picked)
    return EH + f", m AS ({parts}), c AS (SELECT w, field, v, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT w, field, n / sum(n) OVER (PARTITION BY w, field) AS p FROM c), s AS (SELECT w, field, round({value}, 6) + 0.0 AS x FROM p GROUP BY ALL) SELECT w AS window_id, {cols} FROM s GROUP BY w"


for _stat, _name in (("entropy", "entropy_features"), ("hhi", "hhi_features")):
    _names = [f.name for f in X.REGISTRY.all_features() if f.stage == "melt" and f.spec[1] == _stat]

    def _melt(spark, sf_dir, names=tuple(_names)):
        d = X.REGISTRY.compute(hourly(spark, sf_dir), list(names))
        return d.select("window_id", *[(F.round(n, 6) + 0.0).alias(n) for n in names])

    QUERIES[_name], SQL[_name] = _melt, _melt_sql(_stat)

for _col, _name in (("event_category", "category_counts"), ("event_action", "action_counts"), ("event_outcome", "outcome_counts")):

    def _counts(spark, sf_dir, col=_col):
        return X.category_counts(hourly(spark, sf_dir), col)

    QUERIES[_name] = _counts
    SQL[_name] = EH + f"SELECT w AS window_id, {_u(_col)} AS value, count(*) AS n FROM ev GROUP BY ALL"


@query(EH + """, d AS (SELECT w, (t - lag(t) OVER (PARTITION BY w ORDER BY t, id)) / 1e6 AS d FROM ev), a AS (SELECT w, avg(d) AS m, var_pop(d) AS v FROM d GROUP BY w)
    SELECT w AS window_id, round(coalesce(m, 0), 4) AS inter_event_mean, round(coalesce(v, 0), 2) AS inter_event_variance, round(coalesce(v / nullif(m, 0), 0), 3) AS burstiness FROM a""")
def inter_event_features(spark, sf_dir):
    d = X.REGISTRY.compute(hourly(spark, sf_dir), ["inter_event_mean", "inter_event_variance", "burstiness"])
    return d.select("window_id", F.round("inter_event_mean", 4).alias("inter_event_mean"), F.round("inter_event_variance", 2).alias("inter_event_variance"), F.round("burstiness", 3).alias("burstiness"))


_ACTIVE = {"active_users": "user_name", "active_ips": "source_ip", "active_hosts": "host_name", "active_processes": "process_name"}
_LAGGED = (
    ", h AS (SELECT w AS window_id, min(t) AS f, max(t) AS l, " + ", ".join(f"count(DISTINCT {_u(c)}) AS {n}" for n, c in _ACTIVE.items()) + " FROM ev GROUP BY w)"
    ", x AS (SELECT d.*, f, l, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in _ACTIVE) + " FROM d LEFT JOIN h USING (window_id))"
)
_CHANGES = {n: (b.replace("distinct_", "active_"), b) for n, b in X.LAGS.items()}


_LAG_SQL = (
    f", {_DATASET}, {_GRID}, {_DENSE}" + _LAGGED + """ SELECT window_id, CAST(coalesce(lag(event_count) OVER o, 0) AS DOUBLE) AS previous_window_event_count,
    CAST(coalesce(event_count - lag(event_count) OVER o, 0) AS DOUBLE) AS event_rate_change,
    round(CASE WHEN f IS NULL OR lag(l) OVER o IS NULL THEN 5.0 ELSE greatest(0, (f - lag(l) OVER o) / 1e6) END, 6) AS time_since_previous_activity, """
    + ", ".join(f"CAST(coalesce({a} - lag({b}) OVER o, 0) AS DOUBLE) AS {n}" for n, (a, b) in _CHANGES.items()) + " FROM x WINDOW o AS (ORDER BY window_id)"
)


@query(EV + _LAG_SQL)
def temporal_lag_features(spark, sf_dir):
    e = canonical_events(spark, sf_dir).withColumn("window_id", WN.window_id("ts"))
    g = e.groupBy("window_id").agg(
        F.count("*").alias("event_count"), *[F.size(F.collect_set(c)).cast("long").alias(n) for n, c in WN.DISTINCT.items()], *[F.size(F.collect_set(S.unk(c))).cast("long").alias(n) for n, c in _ACTIVE.items()],
        F.min(F.unix_micros("ts")).alias("first_us"), F.max(F.unix_micros("ts")).alias("last_us"),
    )
    d = X.lag_features(WN.dense(g, ["event_count", *WN.DISTINCT, *_ACTIVE]))
    return r6(d.select("window_id", "previous_window_event_count", "event_rate_change", "time_since_previous_activity", *X.LAGS))


_ROLL_SQL: dict[str, str] = {}
for _h, _size in X.ROLLING.items():

    def _rolling(spark, sf_dir, h=_h, n=_size):
        d = X.rolling_features(_dense(spark, sf_dir), horizons={h: n})
        return d.select("window_id", *[F.round(f"rolling_{m}_{s}_{h}", 5).alias(f"rolling_{m}_{s}_{h}") for m in X.METRICS for s in ("mean", "sum", "std")])

    QUERIES[f"rolling_{_h}"] = _rolling
    _ROLL_SQL[_h] = (
        f", {_DATASET}, {_GRID}, {_DENSE} SELECT window_id, "
        + ", ".join(f"round(CAST({fn}({m}) OVER o AS DOUBLE), 5) AS rolling_{m}_{s}_{_h}" for m in X.METRICS for s, fn in (("mean", "avg"), ("sum", "sum"), ("std", "stddev_pop")))
        + f" FROM d WINDOW o AS (ORDER BY window_id ROWS BETWEEN {_size - 1} PRECEDING AND CURRENT ROW)"
    )
    SQL[f"rolling_{_h}"] = EV + _ROLL_SQL[_h]

# ---- baselines ----
_NOVEL = {f.name: f.spec for f in X.REGISTRY.all_features() if f.stage == "novel"}
_BASE, _EVAL = f"t < {SPLIT_S}000000", f"t >= {SPLIT_S}000000"


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return WN.temporal_split(hourly(spark, sf_dir), "ts", SPLIT)


def _novel_sql(where: str = f" WHERE {_EVAL}") -> str:
    cols = []
    for n, f in _NOVEL.items():
        keys = ", ".join(f)
        known = f"({keys}) IN (SELECT ({keys}) FROM ev WHERE {_BASE} AND {' AND '.join(f'{c} IS NOT NULL' for c in f)})"
        cols.append(f"round(avg(CASE WHEN {' OR '.join(f'{c} IS NULL' for c in f)} THEN 1.0 WHEN {known} THEN 0.0 ELSE 1.0 END), 6) AS {n}")
    return EH + f"SELECT w AS window_id, {', '.join(cols)} FROM ev{where} GROUP BY w"


@query(_novel_sql())
def novelty_ratios(spark, sf_dir):
    base, new = _parts(spark, sf_dir)
    return r6(X.REGISTRY.compute(new, list(_NOVEL), {n: B.distinct_values(base, *f) for n, f in _NOVEL.items()}))


def _all_sql() -> str:
    """Every feature on hourly windows, from the SQL of its group."""
    parts = [SQL[f"{g}_features"] for g in ("volume", "users", "hosts", "ips", "processes", "network", "entropy", "hhi")]
    parts += [EH + "SELECT w AS window_id, " + FLAT_SQL["distinct_users"] + " FROM ev GROUP BY w", SQL["inter_event_features"], _novel_sql(""), EH + _LAG_SQL, *[EH + x for x in _ROLL_SQL.values()]]
    for name, column in X.MAPS.items():
        parts.append(EH + f"SELECT w AS window_id, string_agg(v || '=' || n, ',' ORDER BY v) AS {name} FROM (SELECT w, {_u(column)} AS v, count(*) AS n FROM ev GROUP BY ALL) GROUP BY w")
    joined = f"({parts[0]}) AS p0 " + " ".join(f"JOIN ({x}) AS p{i} USING (window_id)" for i, x in enumerate(parts[1:], 1))
    day = "make_timestamp(window_id * 3600000000)"
    return f"SELECT *, CAST(extract('hour' FROM {day}) AS DOUBLE) AS hour_of_day, CASE WHEN extract('dow' FROM {day}) IN (0, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend FROM {joined}"


@query(_all_sql())
def all_features(spark, sf_dir):
    """The whole registry in one plan; maps as text."""
    places = {"inter_event_mean": 4, "inter_event_variance": 2, "burstiness": 3} | {f.name: 5 for f in X.REGISTRY.by_group("rolling")}
    base = _parts(spark, sf_dir)[0]
    d = X.REGISTRY.compute(hourly(spark, sf_dir), None, {n: B.distinct_values(base, *f) for n, f in _NOVEL.items()}, HOUR)
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return d.select(*[text(c).alias(c) if c in X.MAPS else (F.round(c, places.get(c, 6)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


for _name, _keys in (("freq_user", ("user_name",)), ("freq_user_ip", ("user_name", "source_ip")), ("freq_host_process", ("host_name", "process_name")), ("freq_user_host", ("user_name", "host_name"))):

    def _freq(spark, sf_dir, keys=_keys):
        return B.frequencies(canonical_events(spark, sf_dir), *keys)

    QUERIES[_name] = _freq
    SQL[_name] = EV + f"SELECT {', '.join(_keys)}, count(*) AS n FROM ev WHERE {' AND '.join(f'{k} IS NOT NULL' for k in _keys)} GROUP BY ALL"


@query(EV + "SELECT process_name, '/usr/bin/run' || k % 3 || ' -n ' || k % 40 AS process_command_line, count(*) AS n FROM ev GROUP BY ALL")
def freq_incremental(spark, sf_dir):
    """Process and command line over batches by day of the week, some given twice, summed again after a compaction between them."""
    e = canonical_events(spark, sf_dir).withColumn("process_command_line", F.expr("concat('/usr/bin/run', k % 3, ' -n ', k % 40)"))
    t = FrequencyTables(spark, work_path(spark, "frequencies"), {"process_command": ("process_name", "process_command_line")})
    for day in (1, 2, 2, 3, 4, 1, 5, 6, 7, 7):
        t.append(e.where(F.dayofweek("ts") == day), f"day-{day}")
        if day == 4:
            t.compact("process_command")
    return t.totals("process_command")


@query(EV + """, c AS (SELECT id, t // 1000000 AS s, event_id, 0 AS again FROM ev UNION ALL SELECT id, t // 1000000, event_id, 1 FROM ev WHERE event_id % 6 = 0 UNION ALL SELECT id, t // 1000000 + 1, event_id, 2 FROM ev WHERE event_id % 9 = 0
    UNION ALL SELECT NULL, t // 1000000, event_id, 3 FROM ev WHERE event_id % 4 = 0)
    SELECT event_id, again, id IS NOT NULL AND row_number() OVER (PARTITION BY id, s ORDER BY again) > 1 AS duplicate FROM c""")
def duplicate_flags(spark, sf_dir):
    """All rows stay; those whose id and raw time came before are flagged."""
    e = canonical_events(spark, sf_dir).select("_id", F.floor(F.unix_micros("ts") / 1_000_000).alias("raw_timestamp"), "event_id")
    part = lambda d, n: d.withColumn("again", F.lit(n))
    rows = part(e, 0).unionByName(part(e.where("event_id % 6 = 0"), 1)).unionByName(part(e.where("event_id % 9 = 0").withColumn("raw_timestamp", F.col("raw_timestamp") + 1), 2))
    rows = rows.unionByName(part(e.where("event_id % 4 = 0").withColumn("_id", F.lit(None).cast("string")), 3))
    return duplicates(rows, ["_id", "raw_timestamp"], ["again"]).select("event_id", "again", "duplicate")


@query(EV + f", {_DATASET} SELECT *, {_CALENDAR} FROM g")
def ordered_windows(spark, sf_dir):
    """The window dataset written in order and read again."""
    path = work_path(spark, "ordered")
    WN.write_ordered(WN.window_dataset(canonical_events(spark, sf_dir)), path, files=8)
    return spark.read.parquet(path)


@query(EV + "SELECT h AS hour_of_day, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT CAST(extract('hour' FROM ts) AS BIGINT) AS h, count(*) AS n FROM ev GROUP BY 1) USING (h)")
def hour_histogram(spark, sf_dir):
    return B.hour_histogram(canonical_events(spark, sf_dir))


_STAT_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_Q = dict(zip(B.QUANTILES, S.KNOTS))


def _stats_sql(source: str, cols: tuple[str, ...]) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL" for c in cols)
    return (
        f"m AS ({long}), b AS (SELECT feature, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, " + ", ".join(f"quantile_cont(v, {k}) AS {q}" for q, k in _Q.items()) + " FROM m GROUP BY feature), "
        "dv AS (SELECT feature, quantile_cont(abs(v - p50), 0.5) AS mad FROM m JOIN b USING (feature) GROUP BY feature), st AS (SELECT *, p75 - p25 AS iqr FROM b JOIN dv USING (feature))"
    )


@query("WITH " + _stats_sql("lineitem", _STAT_COLS) + " SELECT feature, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "std", *B.QUANTILES, "mad", "iqr")) + ", CASE WHEN feature = 'l_tax' THEN 'standard' ELSE 'robust' END AS calibration_method FROM st")
def robust_stats(spark, sf_dir):
    return r6(B.robust_stats(table(spark, sf_dir, "lineitem"), list(_STAT_COLS), ("l_tax",)))


_TRANSFORM_SQL = EV + f", tr AS (SELECT value FROM ev WHERE t < {SPLIT_S}000000), " + _stats_sql("tr", ("value",)) + f", te AS (SELECT event_id, value * 1.7 AS v FROM ev WHERE {_EVAL}) "


def _with_stats(spark, sf_dir) -> DataFrame:
    a, b = WN.temporal_split(canonical_events(spark, sf_dir), "ts", SPLIT)
    st = B.robust_stats(a, ["value"])  # one row
    return b.select("event_id", (F.col("value") * 1.7).alias("v")).crossJoin(F.broadcast(st))


@query(_TRANSFORM_SQL + "SELECT event_id, round(CASE WHEN mad <> 0 THEN (v - p50) / mad WHEN std <> 0 THEN (v - p50) / std ELSE v - p50 END, 5) AS z FROM te, st")
def robust_z(spark, sf_dir):
    return _with_stats(spark, sf_dir).select("event_id", F.round(S.robust_z(F.col("v"), F.col("p50"), F.col("mad"), F.col("std")), 5).alias("z"))


@query(_TRANSFORM_SQL + "SELECT event_id, round(CASE WHEN v > p75 + 1.5 * iqr THEN (v - (p75 + 1.5 * iqr)) / iqr WHEN v < p25 - 1.5 * iqr THEN (p25 - 1.5 * iqr - v) / iqr ELSE 0.0 END, 5) AS x FROM te, st")
def iqr_distance(spark, sf_dir):
    return _with_stats(spark, sf_dir).select("event_id", F.round(S.iqr_distance(F.col("v"), F.col("p25"), F.col("p75")), 5).alias("x"))


@query(_TRANSFORM_SQL + "SELECT event_id, round(CASE WHEN v > p99 THEN (v - p99) / iqr ELSE 0.0 END, 5) AS x FROM te, st")
def tail_distance(spark, sf_dir):
    return _with_stats(spark, sf_dir).select("event_id", F.round(S.tail_distance(F.col("v"), F.col("p25"), F.col("p75"), F.col("p99")), 5).alias("x"))


def _rank_sql() -> str:
    q = list(_Q.items())
    arms = " ".join(f"WHEN v <= {b} THEN {pa} + ({pb} - {pa}) * (v - {a}) / ({b} - {a})" for (a, pa), (b, pb) in zip(q, q[1:]))
    return f"CASE WHEN v <= p25 THEN CASE WHEN v <= 0 THEN 0.0 ELSE 0.25 * v / p25 END {arms} ELSE 0.999 + 0.001 * (1 - exp(-(v - p999) / mad)) END"


@query(_TRANSFORM_SQL + f"SELECT event_id, round({_rank_sql()}, 5) AS x FROM te, st")
def percentile_rank(spark, sf_dir):
    return _with_stats(spark, sf_dir).select("event_id", F.round(S.percentile_rank(F.col("v"), [F.col(q) for q in B.QUANTILES], F.col("mad")), 5).alias("x"))


@query(
    EV + f", f AS (SELECT user_name, source_ip, count(*) AS n FROM ev WHERE {_BASE} AND user_name IS NOT NULL GROUP BY ALL), n AS (SELECT sum(n) AS total FROM f) "
    f"SELECT event_id, round(-log10(CASE WHEN f.n IS NULL THEN 0.5 ELSE f.n END / (total + 0.5)), 6) AS rarity FROM ev LEFT JOIN f USING (user_name, source_ip), n WHERE {_EVAL}"
)
def freq_rarity(spark, sf_dir):
    base, new = _parts(spark, sf_dir)
    f = B.frequencies(base, "user_name", "source_ip")
    total = f.agg(F.sum("n").cast("double").alias("total"))
    j = new.join(f, ["user_name", "source_ip"], "left").crossJoin(F.broadcast(total))
    return j.select("event_id", F.round(S.frequency_rarity(F.col("n"), F.col("total")), 6).alias("rarity"))


# ---- detectors, calibration, ensemble: events of the evaluation period against the baseline ----
_RARE = ("host_name", "process_name", "user_name")


def _scored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Baseline and evaluation events with stat_score and rare_score."""
    base, new = _parts(spark, sf_dir)
    params = D.stat_params(base, ["value", "k"])
    tables, n = D.rarity_tables(base, list(_RARE))
    out = []
    for d in (base, new):
        d = D.stat_score(d, params).withColumn("stat_score", F.round("raw_score", 9)).withColumnRenamed("top_feature", "stat_feature")
        d = D.rarity_score(d, tables, n).withColumn("rare_score", F.round("raw_score", 9))
        # scores are read several times below: for the distribution, its ranges and the rows
        out.append(stored(d.drop("raw_score"), "scored"))
    return out[0], out[1]


_SCORES = (
    EV + f", b AS (SELECT * FROM ev WHERE {_BASE}), sp AS (SELECT quantile_cont(value, 0.5) AS mv, quantile_cont(k, 0.5) AS mk FROM b), "
    "sd AS (SELECT quantile_cont(abs(value - mv), 0.5) AS dv, quantile_cont(abs(k - mk), 0.5) AS dk FROM b, sp), nn AS (SELECT count(*) AS total FROM b), "
    + ", ".join(f"r_{c} AS (SELECT coalesce({c}, 'None') AS v, count(*) AS n FROM b GROUP BY 1)" for c in _RARE)
    + ", sc AS (SELECT ev.*, round(greatest(abs(value - mv) / dv, abs(k - mk) / dk), 9) AS stat_score, CASE WHEN abs(value - mv) / dv >= abs(k - mk) / dk THEN 'value' ELSE 'k' END AS stat_feature, round(greatest(0.0, "
    + ", ".join(f"coalesce(-ln(r_{c}.n / total), ln(total))" for c in _RARE) + "), 9) AS rare_score FROM ev CROSS JOIN sp CROSS JOIN sd CROSS JOIN nn "
    + " ".join(f"LEFT JOIN r_{c} ON r_{c}.v = coalesce(ev.{c}, 'None')" for c in _RARE) + ")"
)


@query(_SCORES + f"SELECT event_id, round(stat_score, 6) AS stat_score, stat_feature FROM sc WHERE {_EVAL}")
def stat_detector(spark, sf_dir):
    return r6(_scored(spark, sf_dir)[1].select("event_id", "stat_score", "stat_feature"))


@query(_SCORES + f"SELECT event_id, round(rare_score, 6) AS rare_score FROM sc WHERE {_EVAL}")
def rarity_detector(spark, sf_dir):
    return r6(_scored(spark, sf_dir)[1].select("event_id", "rare_score"))


def _evidence(spark, sf_dir) -> DataFrame:
    base, new = _scored(spark, sf_dir)
    e = D.calibrate(new, base, "stat_score", "evidence_stat")
    return stored(D.calibrate(e, base, "rare_score", "evidence_rare"), "evidence")


_EVID = _SCORES + f""", eb AS (SELECT * FROM sc WHERE {_BASE}), es AS (SELECT stat_score, count(*) AS n FROM eb GROUP BY 1), er AS (SELECT rare_score, count(*) AS n FROM eb GROUP BY 1),
    ms AS (SELECT stat_score AS s, max(a) AS a FROM (SELECT stat_score, sum(k2) OVER (ORDER BY stat_score RANGE UNBOUNDED PRECEDING) AS a FROM (SELECT stat_score, n AS k2 FROM es UNION ALL SELECT stat_score, 0 FROM sc WHERE {_EVAL})) GROUP BY 1),
    mr AS (SELECT rare_score AS s, max(a) AS a FROM (SELECT rare_score, sum(k2) OVER (ORDER BY rare_score RANGE UNBOUNDED PRECEDING) AS a FROM (SELECT rare_score, n AS k2 FROM er UNION ALL SELECT rare_score, 0 FROM sc WHERE {_EVAL})) GROUP BY 1),
    evd AS (SELECT sc.*, CAST(ms.a AS DOUBLE) / total AS evidence_stat, CAST(mr.a AS DOUBLE) / total AS evidence_rare FROM sc JOIN ms ON ms.s = stat_score JOIN mr ON mr.s = rare_score CROSS JOIN nn WHERE {_EVAL})"""


@query(_EVID + "SELECT event_id, round(evidence_stat, 6) AS evidence_stat, round(evidence_rare, 6) AS evidence_rare FROM evd")
def ecdf_calibrate(spark, sf_dir):
    return r6(_evidence(spark, sf_dir).select("event_id", "evidence_stat", "evidence_rare"))


_DET = {"statistical": "evidence_stat", "rarity": "evidence_rare"}
_WEIGHTS = {"statistical": 3.0, "rarity": 2.0}
_STRATEGY = {"max": "greatest(evidence_stat, evidence_rare)", "mean": "(evidence_stat + evidence_rare) / 2", "weighted": "evidence_stat * 0.6 + evidence_rare * 0.4"}
_ENS = "en AS (SELECT *, greatest(evidence_stat, evidence_rare) AS ensemble_evidence, CAST((evidence_stat >= 0.95) AS INT) + CAST((evidence_rare >= 0.95) AS INT) AS detector_agreement FROM evd)"

for _s, _x in _STRATEGY.items():

    def _ensemble(spark, sf_dir, s=_s):
        e = D.ensemble(_evidence(spark, sf_dir), _DET, s, _WEIGHTS if s == "weighted" else None)
        return r6(e.select("event_id", "ensemble_evidence", "ensemble_flagged", "detector_agreement", "detector_disagreement", "top_detector", "primary_category"))

    QUERIES[f"ensemble_{_s}"] = _ensemble
    SQL[f"ensemble_{_s}"] = (
        _EVID + f", x AS (SELECT *, {_x} AS e FROM evd) SELECT event_id, round(e, 6) AS ensemble_evidence, e >= 0.95 AS ensemble_flagged, "
        "CAST((evidence_stat >= 0.95) AS INT) + CAST((evidence_rare >= 0.95) AS INT) AS detector_agreement, round(abs(evidence_stat - evidence_rare), 6) AS detector_disagreement, "
        "CASE WHEN evidence_stat >= evidence_rare THEN 'statistical' ELSE 'rarity' END AS top_detector, CASE WHEN evidence_stat >= evidence_rare THEN 'statistical' ELSE 'novelty' END AS primary_category FROM x"
    )


def _ensembled(spark, sf_dir) -> DataFrame:
    return D.ensemble(_evidence(spark, sf_dir), _DET)


for _n_top, _floor in ((100, 0.9), (5, None)):

    def _top(spark, sf_dir, n=_n_top, floor=_floor):
        e = _ensembled(spark, sf_dir).withColumn("window_id", F.col("event_id"))
        t = G.top_windows(e, list(_DET.values()), n, floor)
        return r6(t.select("event_id", "ensemble_evidence", "evidence_sum", "top_detector"))

    QUERIES[f"top{_n_top}"] = _top
    SQL[f"top{_n_top}"] = _EVID + f", {_ENS} SELECT event_id, round(ensemble_evidence, 6) AS ensemble_evidence, round(evidence_stat + evidence_rare, 6) AS evidence_sum, CASE WHEN evidence_stat >= evidence_rare THEN 'statistical' ELSE 'rarity' END AS top_detector FROM en" + (
        f" WHERE ensemble_evidence >= {_floor}" if _floor else ""
    ) + f" ORDER BY en.ensemble_evidence DESC, evidence_stat + evidence_rare DESC, event_id DESC LIMIT {_n_top}"


# ---- investigation: five-minute spacing makes islands of several rows ----
_GAP = 1800


def _episodes(spark, sf_dir) -> DataFrame:
    e = _ensembled(spark, sf_dir)
    rows = e.select(
        (F.floor(F.unix_micros("ts") / 5_000_000) * 5).alias("start_s"), "ensemble_evidence", "detector_agreement", F.col("user_name").alias("user"), F.col("host_name").alias("host"),
        "source_ip", "destination_ip", F.col("process_name").alias("process"),
    )
    return G.episodes(rows, gap_s=_GAP)


def _setsql(c: str) -> str:
    return f"coalesce(list_sort(list_distinct(list({c}) FILTER ({c} IS NOT NULL AND {c} <> ''))), [])"


_EPI = _EVID + f""", {_ENS}, fl AS (SELECT *, w * 5 AS start_s FROM en WHERE ensemble_evidence >= 0.9), la AS (SELECT *, lag(start_s) OVER (ORDER BY start_s) AS p FROM fl),
    isl AS (SELECT *, max(CASE WHEN p IS NULL OR start_s - p > {_GAP} THEN start_s END) OVER (ORDER BY start_s RANGE UNBOUNDED PRECEDING) AS episode_start_s FROM la),
    ep AS (SELECT episode_start_s, max(start_s) AS episode_end_s, count(*) AS window_count, max(ensemble_evidence) AS peak_evidence, avg(ensemble_evidence) AS mean_evidence, avg(detector_agreement) AS mean_agreement,
      {_setsql('user_name')} AS users, {_setsql('host_name')} AS hosts, {_setsql('process_name')} AS processes, list_sort(list_distinct(list_concat({_setsql('source_ip')}, {_setsql('destination_ip')}))) AS ips,
      list(ensemble_evidence ORDER BY start_s, ensemble_evidence) AS trend FROM isl GROUP BY episode_start_s HAVING max(ensemble_evidence) >= 0.95),
    epi AS (SELECT *, sha256(concat_ws('|', CAST(episode_start_s AS VARCHAR), CAST(episode_end_s AS VARCHAR))) AS episode_id, episode_end_s - episode_start_s + 5 AS duration_s FROM ep)"""


def _joined(c: str):
    return F.array_join(c, ",").alias(c)


@query(_EPI + """SELECT episode_start_s, episode_end_s, window_count, round(peak_evidence, 6) AS peak_evidence, round(mean_evidence, 6) AS mean_evidence, round(mean_agreement, 6) AS mean_agreement,
    array_to_string(users, ',') AS users, array_to_string(hosts, ',') AS hosts, array_to_string(processes, ',') AS processes, array_to_string(ips, ',') AS ips, episode_id, duration_s FROM epi""")
def episodes(spark, sf_dir):
    e = _episodes(spark, sf_dir)
    return r6(e.select("episode_start_s", "episode_end_s", "window_count", "peak_evidence", "mean_evidence", "mean_agreement", *[_joined(c) for c in ("users", "hosts", "processes", "ips")], "episode_id", "duration_s"))


_LABELS = _EPI + """, en2 AS (SELECT episode_id, episode_start_s, peak_evidence, unnest(list_distinct(list_concat(list_concat(users, ips), hosts))) AS entity FROM epi),
    sq AS (SELECT *, peak_evidence > lag(peak_evidence) OVER o AS rise, CAST(episode_start_s - lag(episode_start_s) OVER o AS DOUBLE) AS gap FROM en2 WINDOW o AS (PARTITION BY entity ORDER BY episode_start_s, episode_id)),
    pe AS (SELECT entity, count(*) > 1 AS repeats, count(*) >= 3 AND coalesce(bool_and(rise), false) AS escalates, count(*) >= 3 AND avg(gap) > 0 AND coalesce(stddev_pop(gap) / nullif(avg(gap), 0) <= 0.1, false) AS periodic FROM sq GROUP BY entity),
    be AS (SELECT episode_id, bool_or(repeats) AS repeats, bool_or(escalates) AS escalates, bool_or(periodic) AS periodic FROM en2 JOIN pe USING (entity) GROUP BY 1),
    tr AS (SELECT episode_id, count(*) >= 4 AND stddev_pop(v) > 1e-6 AND coalesce(corr(i, v) >= 0.8, false) AS trending FROM (SELECT episode_id, unnest(trend) AS v, generate_subscripts(trend, 1) AS i FROM epi) GROUP BY 1)
    SELECT episode_id, array_to_string(list_sort(list_filter([CASE WHEN NOT coalesce(repeats, false) THEN 'occur once' END, CASE WHEN repeats THEN 'repeat' END, CASE WHEN duration_s >= 60 THEN 'persist' END,
    CASE WHEN coalesce(trending, false) OR coalesce(escalates, false) THEN 'escalate' END, CASE WHEN periodic THEN 'recur periodically' END], lambda x: x IS NOT NULL)), ',') AS labels
    FROM epi LEFT JOIN be USING (episode_id) LEFT JOIN tr USING (episode_id)"""


@query(_LABELS)
def episode_labels(spark, sf_dir):
    e = stored(_episodes(spark, sf_dir), "episodes")
    return G.temporal_labels(e).select("episode_id", _joined("labels"))


def _alerts(spark, sf_dir) -> DataFrame:
    e = canonical_events(spark, sf_dir).where("event_id % 37 = 0")
    return e.select(F.col("_id").alias("alert_id"), F.floor(F.unix_micros("ts") / 1_000_000).alias("ts_s"), F.array("user_name", "source_ip").alias("entities"))


@query(_EPI + """, al AS (SELECT t // 1000000 AS ts_s, user_name AS a, source_ip AS b FROM ev WHERE event_id % 37 = 0)
    SELECT episode_id FROM epi WHERE NOT EXISTS (SELECT 1 FROM al WHERE ts_s BETWEEN episode_start_s - 300 AND episode_end_s + 300
    AND (list_contains(list_concat(list_concat(users, ips), hosts), a) OR list_contains(list_concat(list_concat(users, ips), hosts), b)))""")
def model_only_candidates(spark, sf_dir):
    # the trend, a value for each row of an episode, isn't needed here
    return G.model_only(stored(_episodes(spark, sf_dir).drop("evidence_trend"), "episodes"), _alerts(spark, sf_dir)).select("episode_id")


_FLAGGED = ("user_name='user_3'", "login_volume", "event_count")


@query(_EVID + f""", {_ENS}, fw AS (SELECT DISTINCT w FROM en WHERE ensemble_evidence >= 0.95), o AS (SELECT ev.*, row_number() OVER (PARTITION BY w ORDER BY t, id) AS place FROM ev SEMI JOIN fw USING (w)),
    h AS (SELECT w, id, 'user_name=' || chr(39) || 'user_3' || chr(39) AS feature, 'exact_match' AS method FROM o WHERE user_name = 'user_3' UNION ALL SELECT w, id, 'login_volume', 'subset_filter' FROM o WHERE event_category = 'authentication'
    UNION ALL SELECT w, id, 'event_count', 'global_distribution' FROM o WHERE place <= 100)
    SELECT w AS window_id, id AS _id, array_to_string(list_sort(list_distinct(list(feature))), ',') AS features, array_to_string(list_sort(list_distinct(list(method))), '+') AS methods,
    CASE WHEN bool_or(method = 'global_distribution') THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM h GROUP BY w, id""")
def event_attribution(spark, sf_dir):
    """All windows that the ensemble flags."""
    e = canonical_events(spark, sf_dir).withColumn("window_id", WN.window_id("ts"))
    hot = _ensembled(spark, sf_dir).where("ensemble_flagged").select(WN.window_id("ts").alias("window_id")).distinct()
    flagged = hot.select("window_id", F.explode(F.array(*[F.lit(f) for f in _FLAGGED])).alias("feature"))
    return G.attribute(e, flagged).select("window_id", "_id", _joined("features"), "methods", "confidence")


@query("""WITH a AS (SELECT l_extendedprice AS v, 1 AS a, 0 AS b FROM lineitem WHERE l_shipdate < DATE '1995-06-17' UNION ALL SELECT l_extendedprice * 1.1, 0, 1 FROM lineitem WHERE l_shipdate >= DATE '1995-06-17'),
    c AS (SELECT v, sum(a) AS a, sum(b) AS b FROM a GROUP BY v), r AS (SELECT sum(a) OVER (ORDER BY v) AS ra, sum(b) OVER (ORDER BY v) AS rb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c)
    SELECT round(max(abs(ra / na - rb / nb)), 6) AS d, CAST(max(na) AS BIGINT) AS na, CAST(max(nb) AS BIGINT) AS nb FROM r""")
def drift_ks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    old, new = li.where("l_shipdate < DATE '1995-06-17'"), li.where("l_shipdate >= DATE '1995-06-17'").withColumn("l_extendedprice", F.col("l_extendedprice") * 1.1)
    return r6(G.ks_statistic(old, new, "l_extendedprice"))


def _drift_sql() -> str:
    """Distance, Kolmogorov's series, medians and status of value and k."""

    def one(f: str) -> str:
        n = "sqrt(na * nb / (na + nb))"
        return f"""c_{f} AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT CAST({f} AS DOUBLE) AS v, CAST(t < {SPLIT_S}000000 AS INT) AS a, CAST(t >= {SPLIT_S}000000 AS INT) AS b FROM ev WHERE {f} IS NOT NULL) GROUP BY v),
        k_{f} AS (SELECT max(abs(ra / na - rb / nb)) AS ks, CAST(max(na) AS DOUBLE) AS na, CAST(max(nb) AS DOUBLE) AS nb FROM (SELECT sum(a) OVER (ORDER BY v) AS ra, sum(b) OVER (ORDER BY v) AS rb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c_{f})),
        x_{f} AS (SELECT ks, ks * ({n} + 0.12 + 0.11 / {n}) AS x FROM k_{f}),
        p_{f} AS (SELECT any_value(ks) AS ks, CASE WHEN any_value(x) < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, sum(2 * CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * x * x)))) END AS pv FROM x_{f}, range(1, 101) r(j)),
        m_{f} AS (SELECT quantile_cont(CAST({f} AS DOUBLE), 0.5) FILTER (t < {SPLIT_S}000000) AS bm, quantile_cont(CAST({f} AS DOUBLE), 0.5) FILTER (t >= {SPLIT_S}000000) AS nm,
          max(CAST({f} AS DOUBLE)) FILTER (t < {SPLIT_S}000000) AS bx, max(CAST({f} AS DOUBLE)) FILTER (t >= {SPLIT_S}000000) AS nx FROM ev),
        d_{f} AS (SELECT '{f}' AS feature, ks, pv, CASE WHEN bm <> 0 THEN abs(nm - bm) / abs(bm) ELSE CAST(nm <> bm AS DOUBLE) END AS shift, nx, bx FROM p_{f}, m_{f})"""

    return EV + ", " + ", ".join(map(one, ("value", "k"))) + """ SELECT feature, round(ks, 6) AS ks, round(pv, 6) AS p_value, round(shift, 6) AS median_shift,
        CASE WHEN pv < 0.01 AND shift >= 0.1 THEN 'Population Drift' WHEN nx > 2 * bx THEN 'Individual Anomaly' ELSE 'No Drift' END AS status FROM (SELECT * FROM d_value UNION ALL SELECT * FROM d_k)"""


@query(_drift_sql())
def drift_continuous(spark, sf_dir):
    base, new = _parts(spark, sf_dir)
    return r6(G.continuous_drift(base, new, ["value", "k"]))


def _candidates_sql() -> str:
    """Episodes without an alert, their labels, and the drift of features of which one is tripled after the split."""
    tripled = f"e3 AS (SELECT * REPLACE (CASE WHEN t >= {SPLIT_S}000000 THEN value * 3 ELSE value END AS value) FROM ev)"
    drift = EV + f", {tripled}" + _drift_sql()[len(EV):].replace("FROM ev WHERE", "FROM e3 WHERE").replace("FROM ev),", "FROM e3),")
    return f"""SELECT m.episode_id, round(p.peak_evidence, 6) AS peak_evidence, l.labels AS temporal_context, coalesce(d.lines, '') AS drift_context
    FROM ({SQL['model_only_candidates']}) m JOIN ({SQL['episodes']}) p USING (episode_id) JOIN ({SQL['episode_labels']}) l USING (episode_id),
    (SELECT string_agg(feature || ': ' || status, ',' ORDER BY feature) AS lines FROM ({drift}) WHERE NOT contains(status, 'No Drift')) d"""


@query(_candidates_sql())
def candidate_report(spark, sf_dir):
    base, new = _parts(spark, sf_dir)
    drift = G.continuous_drift(base, new.withColumn("value", F.col("value") * 3), ["value", "k"])
    c = G.candidates(stored(_episodes(spark, sf_dir), "episodes"), _alerts(spark, sf_dir), drift)
    return r6(c.select("episode_id", "peak_evidence", _joined("temporal_context"), _joined("drift_context")))


@query(EV + f""", b AS (SELECT DISTINCT event_category FROM ev WHERE t < {SPLIT_S}000000 AND event_category <> 'file'), n AS (SELECT * FROM ev WHERE {_EVAL})
    SELECT event_category AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM n), 6) AS share, 'Operational Change' AS status FROM n WHERE event_category NOT IN (SELECT * FROM b) GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM n) >= 0.05""")
def drift_categorical(spark, sf_dir):
    a, b = WN.temporal_split(canonical_events(spark, sf_dir), "ts", SPLIT)
    return r6(G.categorical_drift(a.where("event_category <> 'file'"), b, "event_category"))


@query(EV + f""", b AS (SELECT DISTINCT user_name, host_name FROM ev WHERE {_BASE} AND user_name IS NOT NULL)
    SELECT user_name, host_name, min(t) AS first_us FROM ev WHERE {_EVAL} AND user_name IS NOT NULL AND (user_name, host_name) NOT IN (SELECT (user_name, host_name) FROM b) GROUP BY ALL""")
def novelty_inventory(spark, sf_dir):
    base, new = _parts(spark, sf_dir)
    f = G.first_occurrences(base, new, ["user_name", "host_name"])
    return f.select("user_name", "host_name", F.unix_micros("first_seen").alias("first_us"))


#: Six hours are the baseline of the inventory, so that users, hosts, pairs and hours are left to be new.
_EARLY, _EARLY_US = "2024-01-01 06:00:00", 1704088800000000


@query(EV + f""", b AS (SELECT DISTINCT user_name, source_ip FROM ev WHERE t < {_EARLY_US} AND user_name IS NOT NULL)
    SELECT w AS window_id, array_to_string(list_sort(list_distinct(list(user_name || ' -> ' || source_ip))), ',') AS novel_relations FROM ev
    WHERE t >= {_EARLY_US} AND user_name IS NOT NULL AND (user_name, source_ip) NOT IN (SELECT (user_name, source_ip) FROM b) GROUP BY w""")
def novel_relations(spark, sf_dir):
    base, new = WN.temporal_split(canonical_events(spark, sf_dir).withColumn("window_id", WN.window_id("ts")), "ts", _EARLY)
    return R.novel_relations(new, base, ("user_name", "source_ip")).select("window_id", F.array_join("novel_relations", ",").alias("novel_relations"))


_INVENTORY = (
    EV + f""", x AS (SELECT *, 'h' || (user_id_ * 31 + k) % 400 AS node, CAST(extract('hour' FROM ts) AS INT) AS hour FROM (SELECT *, CAST(coalesce(nullif(regexp_extract(user_name, '[0-9]+'), ''), '7') AS INT) AS user_id_ FROM ev)),
    b AS (SELECT * FROM x WHERE t < {_EARLY_US}), n AS (SELECT * FROM x WHERE t >= {_EARLY_US}), top AS (SELECT max(value) AS v, max(k) AS k FROM b),
    r AS (SELECT *, greatest((SELECT v FROM top), max(value) OVER o) AS pv, greatest((SELECT k FROM top), max(k) OVER o) AS pk FROM n WINDOW o AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT kind, entity, f.t AS first_us, f.id AS first_id, NULL::DOUBLE AS value, NULL::DOUBLE AS previous_max FROM (
      SELECT 'new_user' AS kind, user_name AS entity, min({{t: t, id: id}}) AS f FROM n WHERE user_name IS NOT NULL AND user_name NOT IN (SELECT user_name FROM b WHERE user_name IS NOT NULL) GROUP BY ALL
      UNION ALL SELECT 'new_host', node, min({{t: t, id: id}}) FROM n WHERE node NOT IN (SELECT node FROM b) GROUP BY ALL
      UNION ALL SELECT 'new_relationship', user_name || ' -> ' || node, min({{t: t, id: id}}) FROM n WHERE user_name IS NOT NULL AND (user_name, node) NOT IN (SELECT (user_name, node) FROM b WHERE user_name IS NOT NULL) GROUP BY ALL
      UNION ALL SELECT 'new_hour', CAST(hour AS VARCHAR), min({{t: t, id: id}}) FROM n WHERE hour NOT IN (SELECT hour FROM b) GROUP BY ALL
      UNION ALL SELECT 'new_user_hour', user_name || ' @ ' || hour, min({{t: t, id: id}}) FROM n WHERE user_name IN (SELECT user_name FROM b) AND (user_name, hour) NOT IN (SELECT (user_name, hour) FROM b WHERE user_name IS NOT NULL) GROUP BY ALL)
    UNION ALL SELECT 'record_value', CAST(event_id AS VARCHAR), t, id, round(value, 6), round(pv, 6) FROM r WHERE value > pv
    UNION ALL SELECT 'record_k', CAST(event_id AS VARCHAR), t, id, k, pk FROM r WHERE k > pk"""
)


@query(_INVENTORY)
def novelty_report(spark, sf_dir):
    """Users, hosts, pairs, hours, hours of users, and records that the first hours don't have."""
    number = F.coalesce(F.nullif(F.regexp_extract("user_name", "[0-9]+", 0), F.lit("")), F.lit("7")).cast("int")
    e = canonical_events(spark, sf_dir).withColumn("node", F.concat(F.lit("h"), (number * 31 + F.col("k")) % 400))
    base, new = WN.temporal_split(e, "ts", _EARLY)
    found = N.inventory(base, new, "user_name", "node", {"value": "value", "k": "k"}, "event_id")
    return r6(found.select("kind", "entity", F.unix_micros("first_seen").alias("first_us"), "first_id", "value", "previous_max"))


@query(EV + f""", b AS (SELECT max(value) * 0.6 AS m FROM ev WHERE t < {SPLIT_S}000000), n AS (SELECT event_id, value, greatest(m, coalesce(max(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m)) AS p FROM ev, b WHERE {_EVAL})
    SELECT event_id, round(value, 6) AS value, round(p, 6) AS previous_max FROM n WHERE value > p""")
def record_breakers(spark, sf_dir):
    a, b = WN.temporal_split(canonical_events(spark, sf_dir).select("event_id", "ts", "value"), "ts", SPLIT)
    r = G.record_breakers(a.withColumn("value", F.col("value") * 0.6), b, "value", "event_id")
    return r6(r.select("event_id", "value", "previous_max"))


@query(_EVID + f""", {_ENS}, m AS (SELECT DISTINCT w FROM en WHERE ensemble_evidence >= 0.95), a AS (SELECT DISTINCT w FROM ev WHERE {_EVAL} AND event_id % 37 = 0)
    SELECT CASE WHEN m.w IS NOT NULL AND a.w IS NOT NULL THEN 'both' WHEN m.w IS NOT NULL THEN 'model_only' ELSE 'alert_only' END AS side, count(*) AS n FROM m FULL JOIN a ON m.w = a.w GROUP BY 1""")
def alert_contingency(spark, sf_dir):
    e = _ensembled(spark, sf_dir).withColumn("window_id", WN.window_id("ts"))
    a = WN.temporal_split(canonical_events(spark, sf_dir), "ts", SPLIT)[1].where("event_id % 37 = 0").withColumn("window_id", WN.window_id("ts"))
    return G.alert_contingency(e.where("ensemble_flagged"), a, "window_id")


_SIDES = """m AS (SELECT DISTINCT w FROM en WHERE ensemble_evidence >= 0.95), a AS (SELECT DISTINCT w FROM ev WHERE t >= %d000000 AND event_id %% 37 = 0),
    sides AS (SELECT coalesce(m.w, a.w) AS w, CASE WHEN m.w IS NOT NULL AND a.w IS NOT NULL THEN 'both' WHEN m.w IS NOT NULL THEN 'model_only' ELSE 'alert_only' END AS side FROM m FULL JOIN a ON m.w = a.w)""" % SPLIT_S


def _by_side(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flagged windows, windows with alerts, and all events after the split."""
    events = WN.temporal_split(canonical_events(spark, sf_dir), "ts", SPLIT)[1].withColumn("window_id", WN.window_id("ts"))
    e = _ensembled(spark, sf_dir).withColumn("window_id", WN.window_id("ts"))
    return e.where("ensemble_flagged"), events.where("event_id % 37 = 0"), events


@query(_EVID + f", {_ENS}, {_SIDES} SELECT side, count(*) AS n FROM sides GROUP BY 1 UNION ALL SELECT 'neither', count(*) FROM (SELECT DISTINCT w FROM ev WHERE {_EVAL} EXCEPT SELECT w FROM sides) HAVING count(*) > 0")
def contingency_of_all(spark, sf_dir):
    model, alerts, events = _by_side(spark, sf_dir)
    return G.alert_contingency(model, alerts, "window_id", events)


@query(_EVID + f""", {_ENS}, {_SIDES}, lb AS (SELECT w, CASE k % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'security_relevant' ELSE 'unknown' END AS label, t FROM ev WHERE {_EVAL} AND event_id % 3 = 0),
    nl AS (SELECT w, max({{t: t, label: label}}).label AS label FROM lb GROUP BY w)
    SELECT side, coalesce(label, 'pending') AS label, count(*) AS n, coalesce(label, 'pending') IN ('security_relevant', 'suspicious', 'true_positive') AS confirmed FROM sides LEFT JOIN nl USING (w) GROUP BY ALL""")
def contingency_labels(spark, sf_dir):
    """Analysts' newest labels by side; every third event stands for a label of its window."""
    model, alerts, events = _by_side(spark, sf_dir)
    label = F.expr("CASE k % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'security_relevant' ELSE 'unknown' END")
    labels = events.where("event_id % 3 = 0").select("window_id", label.alias("label"), F.unix_micros("ts").alias("at"))
    return G.label_breakdown(model, alerts, "window_id", labels)


@query(_EVID + f""", {_ENS}, d AS (SELECT w * 5 // 86400 AS day, avg(CAST(ensemble_evidence >= 0.95 AS DOUBLE)) AS r FROM en GROUP BY 1)
    SELECT round(avg(r) * 100, 5) AS mean_pct, round(stddev_pop(r) * 100, 5) AS std_pct, CASE WHEN stddev_pop(r) * 100 < 1 THEN 'STABLE' WHEN stddev_pop(r) * 100 < 5 THEN 'MODERATE' ELSE 'POOR' END AS stability FROM d""")
def daily_flag_rate(spark, sf_dir):
    e = _ensembled(spark, sf_dir).withColumn("window_id", WN.window_id("ts"))
    d = G.daily_flag_rate(e, F.col("ensemble_flagged"))
    return d.select(F.round("mean_pct", 5).alias("mean_pct"), F.round("std_pct", 5).alias("std_pct"), "stability")


# ---- models in numpy: SQL forms where weights are fixed or have a closed form ----
_MODEL_FEATURES = ["event_count", "distinct_users", "distinct_ips", "distinct_hosts", "distinct_processes"]


def _hour_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    h = WN.dense(WN.window_dataset(canonical_events(spark, sf_dir), HOUR).select("window_id", *_COUNTS), list(_COUNTS))
    bound = SPLIT_S // HOUR
    return h.where(F.col("window_id") < bound), h


@query()
def pca_detector(spark, sf_dir):
    train, rows = _hour_rows(spark, sf_dir)
    return D.Pca(_MODEL_FEATURES).fit(train).score(rows).select("window_id", "raw_score")


@query(
    "WITH " + ev_sql(HOUR) + f""", {_DATASET}, {_GRID}, {_DENSE}, tr AS (SELECT * FROM d WHERE window_id < {SPLIT_S // HOUR}),
    st AS (SELECT avg(event_count) AS m1, stddev_pop(event_count) AS s1, avg(distinct_users) AS m2, stddev_pop(distinct_users) AS s2, sign(corr(event_count, distinct_users)) AS sg FROM tr)
    SELECT window_id, round(pow((event_count - m1) / s1 - sg * (distinct_users - m2) / s2, 2) / 4, 6) AS raw_score FROM d, st"""
)
def pca_two_features(spark, sf_dir):
    """One of two components: what is left of two standardised features is their difference, or sum where they oppose."""
    train, rows = _hour_rows(spark, sf_dir)
    return r6(D.Pca(_MODEL_FEATURES[:2], 0.5).fit(train).score(rows).select("window_id", "raw_score"))


@query()
def isolation_forest(spark, sf_dir):
    train, rows = _hour_rows(spark, sf_dir)
    return D.IsolationForest(_MODEL_FEATURES).fit(train, "window_id").score(rows).select("window_id", "raw_score")


@query()
def autoencoder(spark, sf_dir):
    train, rows = _hour_rows(spark, sf_dir)
    return D.Autoencoder(_MODEL_FEATURES).fit(train, "window_id").score(rows).select("window_id", "raw_score")


@query()
def sequence_model(spark, sf_dir):
    train, rows = _hour_rows(spark, sf_dir)
    return D.SequenceModel(_MODEL_FEATURES).fit(train).score(rows).select("window_id", "raw_score")


#: A network of one unit over one feature (event_count / 50): gates' weights of the feature, of the state, biases; readout.
_UNIT = {"w": (0.9, -0.4, 0.7, 0.5), "u": (-0.3, 0.2, 0.6, 0.1), "b": (0.1, 0.8, -0.2, 0.3), "v": 1.3, "c": 0.25}
_OVERLAP = 3


def _unit_sql() -> str:
    gate = lambda k, t: f"({_UNIT['w'][k]} * x{t} + {_UNIT['b'][k]}" + (f" + {_UNIT['u'][k]} * h{t - 1})" if t else ")")
    sig = lambda x: f"1 / (1 + exp(-{x}))"
    steps = "q AS (SELECT window_id AS i, " + ", ".join(f"lead(x, {t}) OVER (ORDER BY window_id) AS x{t}" for t in range(_OVERLAP + 1)) + " FROM z)"
    before = "q"
    for t in range(_OVERLAP):
        steps += f", c{t}_ AS (SELECT *, " + (f"{sig(gate(1, t))} * c{t - 1} + " if t else "") + f"{sig(gate(0, t))} * tanh({gate(2, t)}) AS c{t} FROM {before}), h{t}_ AS (SELECT *, {sig(gate(3, t))} * tanh(c{t}) AS h{t} FROM c{t}_)"
        before = f"h{t}_"
    errors = " UNION ALL ".join(f"SELECT i + {t + 1} AS window_id, pow({_UNIT['v']} * h{t} + {_UNIT['c']} - x{t + 1}, 2) AS e FROM {before} WHERE x{_OVERLAP} IS NOT NULL" for t in range(_OVERLAP))
    return f"z AS (SELECT window_id, event_count / 50.0 AS x FROM d), {steps}, e AS ({errors}), a AS (SELECT window_id, avg(e) AS e FROM e GROUP BY window_id) SELECT window_id, round(coalesce(e, 0), 6) AS raw_score FROM d LEFT JOIN a USING (window_id)"


@query(EH + f", {_DATASET}, {_GRID}, {_DENSE}, {_unit_sql()}")
def sequence_overlap(spark, sf_dir):
    """Errors of overlapping sequences, averaged by the window they are of."""
    net = Q.Lstm(1, 1, _OVERLAP)
    theta = np.array([*_UNIT["w"], *_UNIT["u"], *_UNIT["b"], _UNIT["v"], _UNIT["c"]])
    rows = _hour_rows(spark, sf_dir)[1].withColumn("x", F.col("event_count") / 50.0)
    return r6(Q.overlapping_scores(rows, "window_id", ["x"], _OVERLAP, lambda s: net.errors(theta, s)).select("window_id", "raw_score"))
