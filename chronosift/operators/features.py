"""The feature registry, compiled into few plans.

Features are declared by name, group and stage; `compute` turns any selection, or
all of them, into: one aggregation per window for counts and pair diversities, one melted
two-level aggregation for single-field distributions, one ordered pass for
inter-event times, joins to baselines for novelty, and ordered frames over the
dense grid for lags and rolling statistics. Inputs are canonical events with
`window_id`; without events a feature is 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronosift.functions.scalar import connection_key, is_internal, normalize_cmdline, port_unk, unk, valid_ip
from chronosift.operators.windowing import DISTINCT, bucketed_frames
from chronosift.operators.windowing import dense as full
from chronosift.session import stored

KEY = "window_id"


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    stage: str
    build: Callable | None = None
    spec: tuple = ()
    causal: bool = True


class Registry:
    """Names are unique; groups and causality can be listed."""

    def __init__(self) -> None:
        self._features: dict[str, Feature] = {}

    def register(self, f: Feature) -> Feature:
        if f.name in self._features:
            raise ValueError(f"feature {f.name} is registered")
        self._features[f.name] = f
        return f

    def get(self, name: str) -> Feature:
        return self._features[name]

    def all_features(self) -> list[Feature]:
        return list(self._features.values())

    def names(self) -> list[str]:
        return list(self._features)

    def by_group(self, group: str) -> list[Feature]:
        return [f for f in self._features.values() if f.group == group]

    def causal_features(self) -> list[Feature]:
        return [f for f in self._features.values() if f.causal]

    def non_causal_features(self) -> list[Feature]:
        return [f for f in self._features.values() if not f.causal]

    def stages(self, names: list[str] | None = None) -> dict[str, list[Feature]]:
        """The features asked for by the stage that makes them, in stage order; a
        name that is not registered, or has a stage that nothing makes, is an error."""
        unknown = [n for n in names or [] if n not in self._features]
        picked = list(self._features.values()) if names is None else [self._features[n] for n in names if n in self._features]
        lost = [f.name for f in picked if f.stage not in STAGES]
        if unknown or lost:
            raise ValueError("; ".join([f"not registered: {', '.join(unknown)}"] * bool(unknown) + [f"no stage makes: {', '.join(lost)}"] * bool(lost)))
        return {s: own for s in STAGES if (own := [f for f in picked if f.stage == s])}

    def compute(self, events: DataFrame, names: list[str] | None = None, baselines: dict[str, DataFrame] | None = None, seconds: int = 5, dense: bool = False) -> DataFrame:
        """One row per window that has events, or with `dense` per window between
        the first and the last, with the features asked for (all without names).

        The stages form a graph: one aggregation per window gives the flat
        features and what lags and frames are made of; distributions, maps,
        inter-event times and novelty are aggregations beside it, joined by
        window; lags and rolling frames run over the dense grid of the first
        one's result, which is stored where both sides of the graph need it;
        calendar features are functions of the window's number."""
        by = self.stages(names)
        need = {s for s in by for s in (s, *STAGES[s])}
        per_window = [F.coalesce(f.build(), F.lit(0.0)).alias(f.name) for f in by.get("flat", [])]
        own = events.groupBy(KEY).agg(F.lit(1).alias("__some"), *per_window, *(_grid_columns() if "dense" in need else []))
        if "dense" in need:
            own = stored(own, "windows")
        out = own.select(KEY, *[f.name for f in by.get("flat", [])])
        for stage, make in (("melt", _melted), ("map", _maps)):
            if stage in by:
                out = out.join(make(events, by[stage]), KEY)
        if "iet" in by:
            out = out.join(_inter_event(events), KEY)
        if "novel" in by:
            out = out.join(_novelty(events, by["novel"], baselines or {}), KEY)
        if "dense" in need or dense:
            columns = _GRID if "dense" in need else []
            grid = full(own.select(KEY, *[F.col(f"__g_{c}").alias(c) for c in columns]), [c for c in columns if c not in _TIMES])
            grid = lag_features(grid) if "grid" in by else grid
            grid = rolling_features(grid) if "rolling" in by else grid
            kept = [f.name for s in ("grid", "rolling") for f in by.get(s, [])]
            out = grid.select(KEY, *kept).join(out, KEY, "left" if dense else "inner")
            zero = {"double": F.lit(0.0), "map<string,bigint>": F.map_from_entries(F.array().cast("array<struct<k:string,v:bigint>>"))}
            out = out.select(*[F.coalesce(c, zero[t]).alias(c) if t in zero else c for c, t in out.dtypes])
        if "calendar" in by:
            at = F.timestamp_seconds(F.col(KEY) * seconds)
            out = out.withColumns({"hour_of_day": _double(F.hour(at)), "is_weekend": _double(F.dayofweek(at).isin(1, 7).cast("int"))})
        return out.select(KEY, *(names or [f.name for f in self._features.values()]))


#: Stages, and what else each needs of a window.
STAGES: dict[str, tuple[str, ...]] = {"flat": (), "melt": (), "map": (), "iet": (), "novel": (), "grid": ("dense",), "rolling": ("dense",), "calendar": ()}
_ACTIVE = {"active_users": "user_name", "active_ips": "source_ip", "active_hosts": "host_name", "active_processes": "process_name"}
_TIMES = ("first_us", "last_us")
_GRID = ["event_count", *DISTINCT, *_ACTIVE, *_TIMES]


def _grid_columns() -> list[Column]:
    """What lags and frames are made of, per window."""
    made = {"event_count": F.count("*"), "first_us": F.min(F.unix_micros("ts")), "last_us": F.max(F.unix_micros("ts"))}
    made |= {n: F.size(F.collect_set(c)).cast("long") for n, c in DISTINCT.items()} | {n: F.size(F.collect_set(unk(c))).cast("long") for n, c in _ACTIVE.items()}
    return [x.alias(f"__g_{n}") for n, x in made.items()]


REGISTRY = Registry()


def _double(x: Column) -> Column:
    return x.cast("double")


def _distinct(*cols: Column) -> Column:
    """Exact distinct count within a window; windows' sets are small."""
    return _double(F.size(F.collect_set(F.struct(*[x.alias(f"c{i}") for i, x in enumerate(cols)]) if len(cols) > 1 else cols[0])))


def flat(name: str, group: str, build: Callable[[], Column]) -> None:
    REGISTRY.register(Feature(name, group, "flat", build))


def count_if(cond: Column) -> Column:
    return _double(F.count(F.when(cond, 1)))


def diversity(entity: Callable[[], Column], target: Callable[[], Column]) -> Callable[[], Column]:
    """Average number of distinct targets per entity."""
    return lambda: _distinct(entity(), target()) / _distinct(entity())


U = {f: (lambda f=f: unk(f)) for f in ("user_name", "host_name", "source_ip", "destination_ip", "process_name", "process_parent_name", "network_protocol", "event_category")}
CONNECTION = lambda: connection_key("source_ip", "destination_ip", "destination_port")
LOGIN = lambda: (F.col("event_category") == "authentication") & F.col("event_action").isin("logon", "login")

# volume
flat("event_count", "volume", lambda: _double(F.count("*")))
REGISTRY.register(Feature("events_per_second", "volume", "flat", lambda: _double(F.count("*")) / 5.0))
for _name, _cat in (("authentication_volume", "authentication"), ("network_volume", "network"), ("process_volume", "process"), ("file_activity_volume", "file")):
    flat(_name, "volume", lambda c=_cat: count_if(F.col("event_category") == c))
# pass-through
flat("distinct_users", "builtin", lambda: _double(F.size(F.collect_set("user_name"))))
# hosts
flat("active_hosts", "hosts", lambda: _distinct(unk("host_name")))
for _n, _t in (("host_user_diversity", "user_name"), ("host_ip_diversity", "source_ip"), ("host_process_diversity", "process_name"), ("host_category_diversity", "event_category")):
    flat(_n, "hosts", diversity(U["host_name"], U[_t]))
# addresses
flat("unique_source_ips", "ips", lambda: _distinct(unk("source_ip")))
flat("unique_destination_ips", "ips", lambda: _distinct(unk("destination_ip")))
flat("internal_source_ratio", "ips", lambda: F.avg(F.when(valid_ip("source_ip"), _double(is_internal("source_ip").cast("int")))))
flat("ip_user_diversity", "ips", diversity(U["source_ip"], U["user_name"]))
flat("ip_host_diversity", "ips", diversity(U["source_ip"], U["host_name"]))
# network
flat("network_unique_destinations", "network", lambda: _distinct(unk("destination_ip")))
flat("unique_destination_ports", "network", lambda: _distinct(port_unk("destination_port")))
flat("source_destination_diversity", "network", diversity(U["source_ip"], U["destination_ip"]))
flat("host_network_relationships", "network", diversity(U["host_name"], CONNECTION))
# processes
flat("active_processes", "processes", lambda: _distinct(unk("process_name")))
for _n, _t in (("process_host_diversity", "host_name"), ("process_user_diversity", "user_name"), ("parent_child_diversity", "process_parent_name")):
    flat(_n, "processes", diversity(U["process_name"], U[_t]))
# users
flat("active_users", "users", lambda: _distinct(unk("user_name")))
flat("login_volume", "users", lambda: count_if(LOGIN()))
flat("failed_login_ratio", "users", lambda: F.try_divide(count_if(LOGIN() & (F.col("event_outcome") == "failure")), count_if(LOGIN())))
for _n, _t in (("user_host_diversity", "host_name"), ("user_ip_diversity", "source_ip"), ("user_process_diversity", "process_name")):
    flat(_n, "users", diversity(U["user_name"], U[_t]))

# single-field distributions: (field, statistic)
_FIELDS: dict[str, Callable[[], Column]] = {**U, "connection": CONNECTION, "cmdline": lambda: normalize_cmdline("process_command_line")}
for _n, _g, _f, _s in (
    ("user_entropy", "entropy", "user_name", "entropy"), ("source_ip_entropy", "entropy", "source_ip", "entropy"), ("host_entropy", "entropy", "host_name", "entropy"),
    ("process_entropy", "entropy", "process_name", "entropy"), ("destination_entropy", "entropy", "destination_ip", "entropy"), ("protocol_entropy", "entropy", "network_protocol", "entropy"),
    ("event_category_entropy", "entropy", "event_category", "entropy"), ("host_event_concentration", "hosts", "host_name", "hhi"), ("source_ip_concentration", "ips", "source_ip", "hhi"),
    ("connection_concentration", "network", "connection", "hhi"), ("network_entropy", "network", "connection", "entropy"), ("process_event_concentration", "processes", "process_name", "hhi"),
    ("cmdline_pattern_diversity", "processes", "cmdline", "entropy"), ("user_event_concentration", "users", "user_name", "hhi"),
):
    REGISTRY.register(Feature(_n, _g, "melt", None, (_f, _s)))


def distributions(events: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """window, field, n, categories, entropy (bits), hhi; two levels of aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), x.alias("value")) for n, x in fields.items()]))
    counts = events.select(KEY, pairs.alias("p")).groupBy(KEY, "p.field", "p.value").agg(F.count("*").alias("c"))
    g = counts.groupBy(KEY, "field").agg(F.sum("c").alias("n"), F.count("*").alias("categories"), F.sum(F.col("c") * F.log2("c")).alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    entropy = F.when(F.col("categories") == 1, 0.0).otherwise(F.log2("n") - F.col("s") / F.col("n"))
    return g.select(KEY, "field", "n", "categories", entropy.alias("entropy"), (F.col("q") / (F.col("n") * F.col("n"))).alias("hhi"))


def _melted(events: DataFrame, picked: list[Feature]) -> DataFrame:
    d = distributions(events, {f: _FIELDS[f]() for f in dict.fromkeys(x.spec[0] for x in picked)})
    return d.groupBy(KEY).agg(*[F.max(F.when(F.col("field") == f.spec[0], F.col(f.spec[1]))).alias(f.name) for f in picked])


def category_counts(events: DataFrame, column: str) -> DataFrame:
    """window, value, n: the dynamic keys of the frequency maps."""
    return events.groupBy(KEY, unk(column).alias("value")).agg(F.count("*").alias("n"))


MAPS = {"category_count": "event_category", "action_count": "event_action", "outcome_count": "event_outcome"}


def _maps(events: DataFrame, picked: list[Feature]) -> DataFrame:
    """Value -> number of events for each map feature, by one melted aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), unk(MAPS[f.name]).alias("value")) for f in picked]))
    counts = events.select(KEY, pairs.alias("p")).groupBy(KEY, "p.field", "p.value").agg(F.count("*").alias("n"))
    entries = counts.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("field", "value", "n"))).alias("e"))
    own = lambda f: F.transform(F.filter("e", lambda x: x["field"] == f.name), lambda x: F.struct(x["value"], x["n"]))
    return entries.select(KEY, *[F.map_from_entries(own(f)).alias(f.name) for f in picked])


def category_map(events: DataFrame, column: str) -> DataFrame:
    """The same as a map per window."""
    c = category_counts(events, column)
    return c.groupBy(KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(f"{column}_counts"))


# inter-event times
for _n in ("inter_event_mean", "inter_event_variance", "burstiness"):
    REGISTRY.register(Feature(_n, "temporal", "iet"))


def _inter_event(events: DataFrame) -> DataFrame:
    t = F.unix_micros("ts") / 1e6
    w = W.partitionBy(KEY).orderBy("ts", "_id")
    d = events.select(KEY, ((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6).alias("d"), t.alias("t"))
    g = d.groupBy(KEY).agg(F.avg("d").alias("m"), F.var_pop("d").alias("v"))
    return g.select(
        KEY, F.coalesce("m", F.lit(0.0)).alias("inter_event_mean"), F.coalesce("v", F.lit(0.0)).alias("inter_event_variance"),
        F.coalesce(F.try_divide("v", F.nullif(F.col("m"), F.lit(0.0))), F.lit(0.0)).alias("burstiness"),
    )


# novelty against frozen sets: ratio of the window's events whose entity or pair the baseline lacks
for _n, _g, _f in (
    ("historical_host_deviation", "hosts", ("host_name",)), ("relationship_novelty_host_user", "hosts", ("host_name", "user_name")),
    ("historical_ip_deviation", "ips", ("source_ip",)), ("relationship_novelty_ip_user", "ips", ("source_ip", "user_name")),
    ("historical_process_deviation", "processes", ("process_name",)), ("historical_user_deviation", "users", ("user_name",)),
):
    REGISTRY.register(Feature(_n, _g, "novel", None, _f))


def _novelty(events: DataFrame, picked: list[Feature], baselines: dict[str, DataFrame]) -> DataFrame:
    """baselines: by feature name, distinct rows of the feature's fields. Without
    a baseline every event is novel; a null entity is novel too."""
    e = events
    for f in picked:
        flag = f"__{f.name}"
        if f.name in baselines:
            known = baselines[f.name].select(*[F.col(x).alias(f"__k{i}") for i, x in enumerate(f.spec)], F.lit(0.0).alias(flag))
            e = e.join(known, reduce(lambda a, b: a & b, [F.col(x) == F.col(f"__k{i}") for i, x in enumerate(f.spec)]), "left").drop(*[f"__k{i}" for i in range(len(f.spec))])
        else:
            e = e.withColumn(flag, F.lit(1.0))
    return e.groupBy(KEY).agg(*[F.avg(F.coalesce(f"__{f.name}", F.lit(1.0))).alias(f.name) for f in picked])


# calendar pass-through, lags and rolling frames work on window rows
LAGS = {"user_count_change": "distinct_users", "ip_count_change": "distinct_ips", "host_count_change": "distinct_hosts", "process_count_change": "distinct_processes"}
for _n in ("previous_window_event_count", "event_rate_change", *LAGS, "time_since_previous_activity"):
    REGISTRY.register(Feature(_n, "temporal", "grid"))
for _n in ("hour_of_day", "is_weekend"):
    REGISTRY.register(Feature(_n, "builtin", "calendar"))
for _n in MAPS:
    REGISTRY.register(Feature(_n, "volume", "map"))
ROLLING = {"30s": 6, "1m": 12, "5m": 60, "15m": 180}
METRICS = ("event_count", "distinct_users", "distinct_ips", "distinct_hosts", "distinct_processes")
for _m in METRICS:
    for _s in ("mean", "sum", "std"):
        for _h in ROLLING:
            REGISTRY.register(Feature(f"rolling_{_m}_{_s}_{_h}", "rolling", "rolling"))


def lag_features(windows: DataFrame) -> DataFrame:
    """Changes against the window before; windows: a dense grid with
    event_count, the four distinct columns, active_* counts (null counts as a
    value there), first_us and last_us (event times, null where empty)."""

    def add(df: DataFrame, w) -> DataFrame:
        prev = F.lag("event_count").over(w)
        gap = (F.col("first_us") - F.lag("last_us").over(w)) / 1e6
        missing = F.col("first_us").isNull() | F.lag("last_us").over(w).isNull()
        cols = {
            "previous_window_event_count": F.coalesce(prev, F.lit(0)).cast("double"),
            "event_rate_change": F.coalesce(F.col("event_count") - prev, F.lit(0)).cast("double"),
            "time_since_previous_activity": F.when(missing, 5.0).otherwise(F.greatest(F.lit(0.0), gap)),
        }
        for name, base in LAGS.items():
            own = base.replace("distinct_", "active_")
            cols[name] = F.coalesce(F.col(own) - F.lag(base).over(w), F.lit(0)).cast("double")
        return df.withColumns(cols)

    return bucketed_frames(windows, add, 1)


def rolling_features(windows: DataFrame, metrics: tuple[str, ...] = METRICS, horizons: dict[str, int] = ROLLING) -> DataFrame:
    """Trailing mean, sum and population deviation per metric and horizon, the
    current row included, shorter at the start. Metrics are integers, so running
    sums are exact and a frame is a difference of two of them."""
    first = windows.agg(F.min("window_id").alias("__first"))

    def add(df: DataFrame, w) -> DataFrame:
        run = w.rowsBetween(W.unboundedPreceding, 0)
        df = df.withColumns({f"__s_{m}": F.sum(F.col(m).cast("long")).over(run) for m in metrics} | {f"__q_{m}": F.sum(F.col(m).cast("long") * F.col(m).cast("long")).over(run) for m in metrics})
        out = {}
        for h, n in horizons.items():
            size = F.least(F.col("window_id") - F.col("__first") + 1, F.lit(n)).cast("double")
            for m in metrics:
                s = (F.col(f"__s_{m}") - F.coalesce(F.lag(f"__s_{m}", n).over(w), F.lit(0))).cast("double")
                q = (F.col(f"__q_{m}") - F.coalesce(F.lag(f"__q_{m}", n).over(w), F.lit(0))).cast("double")
                out[f"rolling_{m}_sum_{h}"] = s
                out[f"rolling_{m}_mean_{h}"] = s / size
                out[f"rolling_{m}_std_{h}"] = F.sqrt(F.greatest(F.lit(0.0), size * q - s * s)) / size
        df = df.withColumns(out)
        return df.drop(*[f"__{k}_{m}" for m in metrics for k in "sq"])

    return bucketed_frames(windows.crossJoin(F.broadcast(first)), add, max(horizons.values())).drop("__first")
