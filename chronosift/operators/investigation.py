"""Episodes, temporal labels, candidates, attribution, drift, novelty, reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronosift.operators.baselines import exact_quantiles, melt
from chronosift.operators.ranges import running_counts

FLOOR, PEAK, GAP_S = 0.90, 0.95, 15


def top_windows(scored: DataFrame, evidence: list[str], n: int = 100, floor: float | None = FLOOR) -> DataFrame:
    """The n windows of highest ensemble evidence, then highest sum, then latest."""
    d = scored.withColumn("evidence_sum", sum((F.col(c) for c in evidence), F.lit(0.0)))
    if floor is not None:
        d = d.where(F.col("ensemble_evidence") >= floor)
    return d.orderBy(F.desc("ensemble_evidence"), F.desc("evidence_sum"), F.desc("window_id")).limit(n)


def _set(c: str) -> Column:
    return F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))


def episodes(rows: DataFrame, floor: float = FLOOR, peak: float = PEAK, gap_s: int = GAP_S, day_s: int = 86_400) -> DataFrame:
    """Islands of rows with evidence at or above the floor. A gap of more than
    gap_s seconds starts a new island; islands whose peak reaches `peak` stay.

    rows: start_s (seconds), ensemble_evidence, detector_agreement, user, host,
    source_ip, destination_ip, process. Islands are numbered in two levels: a
    row is a head if the latest row before it, within its day or in the last of
    earlier days, is too far; a head's time names the island.
    """
    d = rows.where(F.col("ensemble_evidence") >= floor).withColumn("__d", F.floor(F.col("start_s") / day_s))
    w = W.partitionBy("__d").orderBy("start_s")
    ends = d.groupBy("__d").agg(F.max("start_s").alias("__end"))
    # one row per day
    days = ends.select("__d", F.max("__end").over(W.orderBy("__d").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    d = d.join(F.broadcast(days), "__d")
    prev = F.coalesce(F.lag("start_s").over(w), F.col("__before"))
    d = d.withColumn("__head", F.when(prev.isNull() | (F.col("start_s") - prev > gap_s), F.col("start_s")))
    d = d.withColumn("__h", F.max("__head").over(w.rowsBetween(W.unboundedPreceding, 0)))
    heads = d.groupBy("__d").agg(F.max("__head").alias("__last"))
    carried = heads.select("__d", F.max("__last").over(W.orderBy("__d").rowsBetween(W.unboundedPreceding, -1)).alias("__carry"))
    d = d.join(F.broadcast(carried), "__d").withColumn("episode_start_s", F.coalesce("__h", "__carry"))
    g = d.groupBy("episode_start_s").agg(
        F.max("start_s").alias("episode_end_s"), F.count("*").alias("window_count"), F.max("ensemble_evidence").alias("peak_evidence"), F.avg("ensemble_evidence").alias("mean_evidence"),
        F.avg("detector_agreement").alias("mean_agreement"), _set("user").alias("users"), _set("host").alias("hosts"), _set("process").alias("processes"),
        F.array_sort(F.array_union(_set("source_ip"), _set("destination_ip"))).alias("ips"),
        F.transform(F.array_sort(F.collect_list(F.struct("start_s", "ensemble_evidence"))), lambda x: x["ensemble_evidence"]).alias("evidence_trend"),
    )
    g = g.where(F.col("peak_evidence") >= peak)
    return g.withColumn("episode_id", F.sha2(F.concat_ws("|", F.col("episode_start_s").cast("string"), F.col("episode_end_s").cast("string")), 256)).withColumn(
        "duration_s", F.col("episode_end_s") - F.col("episode_start_s") + 5
    )


def entities(ep: DataFrame) -> DataFrame:
    """episode, entity: users, addresses and hosts."""
    return ep.select("episode_id", "episode_start_s", "episode_end_s", "peak_evidence", F.explode(F.array_union(F.array_union("users", "ips"), "hosts")).alias("entity"))


def temporal_labels(ep: DataFrame, persist_s: int = 60) -> DataFrame:
    """episode_id, labels (sorted): occur once, repeat, persist, escalate, recur
    periodically. Escalation is within the episode (rank-free correlation of the
    trend with its index of at least 0.8) or over an entity's episodes."""
    e = entities(ep)
    w = W.partitionBy("entity").orderBy("episode_start_s", "episode_id")
    s = e.withColumns({"rise": F.col("peak_evidence") > F.lag("peak_evidence").over(w), "gap": (F.col("episode_start_s") - F.lag("episode_start_s").over(w)).cast("double")})
    per = s.groupBy("entity").agg(F.count("*").alias("n"), F.min("rise").alias("rising"), F.stddev_pop("gap").alias("dev"), F.avg("gap").alias("gap"))
    flags = per.select(
        "entity", (F.col("n") > 1).alias("repeats"), (F.col("n").__ge__(3) & F.coalesce("rising", F.lit(False))).alias("escalates"),
        ((F.col("n") >= 3) & (F.col("gap") > 0) & (F.col("dev") / F.nullif(F.col("gap"), F.lit(0.0)) <= 0.1)).alias("periodic"),
    )
    by_entity = e.join(flags, "entity").groupBy("episode_id").agg(F.max("repeats").alias("repeats"), F.max("escalates").alias("escalates"), F.max(F.coalesce("periodic", F.lit(False))).alias("periodic"))
    t = ep.select("episode_id", F.posexplode("evidence_trend").alias("i", "v")).groupBy("episode_id").agg(
        F.count("*").alias("m"), F.stddev_pop("v").alias("sv"), F.avg("v").alias("av"), F.avg("i").alias("ai"), F.avg(F.col("i") * F.col("v")).alias("aiv"), F.stddev_pop("i").alias("si")
    )
    r = t.select("episode_id", ((F.col("m") >= 4) & (F.col("sv") > 1e-6) & (F.try_divide(F.col("aiv") - F.col("ai") * F.col("av"), F.col("si") * F.col("sv")) >= 0.8)).alias("trend"))
    out = ep.join(by_entity, "episode_id", "left").join(r, "episode_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    label = lambda cond, s: F.when(cond, F.lit(s))
    labels = F.array(
        label(~flag("repeats"), "occur once"), label(flag("repeats"), "repeat"), label(F.col("duration_s") >= persist_s, "persist"),
        label(flag("trend") | flag("escalates"), "escalate"), label(flag("periodic"), "recur periodically"),
    )
    return out.select("episode_id", F.array_sort(F.filter(labels, lambda x: x.isNotNull())).alias("labels"))


def model_only(ep: DataFrame, alerts: DataFrame, tolerance_s: int = 300, day_s: int = 86_400) -> DataFrame:
    """Episodes that no alert explains: none within the tolerance shares an
    entity. alerts: alert_id, ts_s, entities. An alert explains an episode if
    an entity's latest alert up to the end isn't before the start. Latest alerts
    are running maxima within an entity's days and over the days' maxima: a row
    for each alert's entity and each episode's, however long the episode is."""
    e = entities(ep).select("entity", "episode_id", (F.col("episode_start_s") - tolerance_s).alias("lo"), (F.col("episode_end_s") + tolerance_s).alias("at"), F.lit(None).alias("alert"))
    a = alerts.select(F.explode("entities").alias("entity"), F.col("ts_s").alias("at")).where("entity IS NOT NULL").distinct()
    both = e.unionByName(a.select("entity", F.lit(None).alias("episode_id"), F.lit(None).alias("lo"), "at", F.col("at").alias("alert"))).withColumn("__d", F.floor(F.col("at") / day_s))
    within = W.partitionBy("entity", "__d").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    asked = both.withColumn("latest", F.max("alert").over(within)).where("episode_id IS NOT NULL")
    days = both.groupBy("entity", "__d").agg(F.max("alert").alias("last"))
    before = days.select("entity", "__d", F.max("last").over(W.partitionBy("entity").orderBy("__d").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    hit = asked.join(before.hint("merge"), ["entity", "__d"]).where(F.greatest("latest", "carried") >= F.col("lo")).select("episode_id").distinct()
    return ep.join(hit, "episode_id", "left_anti")


def attribute(events: DataFrame, flagged: DataFrame, cap: int = 100) -> DataFrame:
    """Events of flagged windows with the features they explain.

    flagged: window_id, feature (text). `field='value'` matches exactly (HIGH);
    authentication and network features match their events (HIGH); any other
    feature is attributed to the window's first `cap` events (MEDIUM; the cap is
    the report's). An event with several keeps the lowest confidence and all methods."""
    f = flagged.withColumns({"field": F.regexp_extract("feature", "^(\\w+)='", 1), "wanted": F.regexp_extract("feature", "^\\w+='(.*)'$", 1)})
    kind = F.when(F.col("field") != "", "exact").when(F.col("feature").rlike("login|auth"), "authentication").when(F.col("feature").rlike("^network_volume|connection"), "network").otherwise("global")
    f = f.withColumn("kind", kind)
    names = ("user_name", "source_ip", "destination_ip", "host_name", "process_name", "event_category", "event_action", "event_outcome")
    value = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    w = W.partitionBy("window_id").orderBy("ts", "_id")
    # events of flagged windows only are ordered
    hot = events.join(f.select("window_id").distinct().hint("merge"), "window_id", "left_semi")
    e = hot.withColumn("value_of", value).withColumn("place", F.row_number().over(w))
    j = e.join(f, "window_id")
    keep = (
        ((F.col("kind") == "exact") & (F.col("value_of")[F.col("field")] == F.col("wanted")))
        | ((F.col("kind") == "authentication") & (F.col("event_category") == "authentication"))
        | ((F.col("kind") == "network") & (F.col("event_category") == "network"))
        | ((F.col("kind") == "global") & (F.col("place") <= cap))
    )
    method = F.when(F.col("kind") == "exact", "exact_match").when(F.col("kind") == "global", "global_distribution").otherwise("subset_filter")
    hit = j.where(keep).withColumns({"method": method, "medium": F.col("kind") == "global"})
    g = hit.groupBy("window_id", "_id").agg(F.min("ts").alias("ts"), F.array_sort(F.collect_set("feature")).alias("features"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"), F.max("medium").alias("m"))
    return g.select("window_id", "_id", "ts", "features", "methods", F.when(F.col("m"), "MEDIUM").otherwise("HIGH").alias("confidence"))


def ks_statistic(base: DataFrame, new: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Two-sample distance of the empirical distributions. Distinct values are
    counted first, and running counts go by ranges of them."""
    keys = [group] if group else []
    tag = lambda d, k: d.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("v"), F.lit(1 - k).alias("a"), F.lit(k).alias("b"))
    c = tag(base, 0).unionByName(tag(new, 1)).groupBy(*keys, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = running_counts(c, keys, "v", {"a": "ra", "b": "rb"})
    apart = F.abs(F.col("ra") / F.nullif(F.col("a_total"), F.lit(0)) - F.col("rb") / F.nullif(F.col("b_total"), F.lit(0)))
    return run.groupBy(*keys).agg(F.max(apart).alias("d"), F.max("a_total").alias("na"), F.max("b_total").alias("nb"))


def kolmogorov_p(d: float, na: int, nb: int) -> float:
    """Asymptotic p-value of the distance."""
    n = math.sqrt(na * nb / (na + nb))
    x = (n + 0.12 + 0.11 / n) * d
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def continuous_drift(base: DataFrame, new: DataFrame, features: list[str], p: float = 0.01, shift: float = 0.10) -> DataFrame:
    """feature, ks, p_value, median_shift, status; all features in the same passes."""
    b, n = melt(base, features), melt(new, features)
    ks = ks_statistic(b, n, "value", "feature")
    middle = lambda d, side: exact_quantiles(d, [0.5]).select("feature", F.col("q")[0].alias(f"{side}m")).join(d.groupBy("feature").agg(F.max("value").alias(f"{side}x")), "feature")
    rows = {r.feature: r for r in ks.join(middle(b, "b"), "feature", "left").join(middle(n, "n"), "feature", "left").collect()}  # one row per feature
    out = []
    for f in features:
        r = rows.get(f)
        if r is None or not r.na or not r.nb:  # one side has no value
            out.append((f, None, 1.0, None, "No Drift"))
            continue
        pv = kolmogorov_p(r.d, r.na, r.nb)
        moved = abs(r.nm - r.bm) / abs(r.bm) if r.bm else float(r.nm != r.bm)
        status = "Population Drift" if pv < p and moved >= shift else "Individual Anomaly" if r.nx > 2 * r.bx else "No Drift"
        out.append((f, float(r.d), pv, float(moved), status))
    return base.sparkSession.createDataFrame(out, "feature string, ks double, p_value double, median_shift double, status string")


def categorical_drift(base: DataFrame, new: DataFrame, column: str, share: float = 0.05) -> DataFrame:
    """Categories unseen in the baseline with at least this share of the new rows."""
    known = base.select(column).dropna().distinct()
    total = new.agg(F.count("*").alias("total"))
    c = new.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).join(known, column, "left_anti")
    out = c.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= share)
    return out.select(F.col(column).alias("category"), "n", "share", F.lit("Operational Change").alias("status"))


def first_occurrences(base: DataFrame, new: DataFrame, keys: list[str], ts: str = "ts", tie: str = "_id") -> DataFrame:
    """First event of every key that the baseline lacks."""
    known = base.select(*keys).dropna().distinct()
    fresh = new.dropna(subset=keys).groupBy(*keys).agg(F.min(F.struct(ts, tie)).alias("f"))
    return fresh.join(known, keys, "left_anti").select(*keys, F.col(f"f.{ts}").alias("first_seen"), F.col(f"f.{tie}").alias("first_id"))


def record_breakers(base: DataFrame, new: DataFrame, column: str, order: str, shards: int = 1024) -> DataFrame:
    """Rows that exceed the baseline's maximum and everything before them. The
    order is cut into a fixed number of stretches, whatever the rows, whose
    maxima (one row each) are what passes from stretch to stretch."""
    top = base.agg(F.max(column).alias("__top"))
    w = W.partitionBy("__p").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    cuts = new.agg(F.percentile_approx(order, [i / shards for i in range(1, shards)], 20 * shards).alias("__cuts"))
    d = new.crossJoin(F.broadcast(cuts)).withColumn("__p", F.coalesce(F.size(F.filter("__cuts", lambda x: x < F.col(order))), F.lit(0))).drop("__cuts")
    tops = d.groupBy("__p").agg(F.max(column).alias("__m"))
    before = tops.select("__p", F.max("__m").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)).alias("__b"))
    d = d.withColumn("__in", F.max(column).over(w)).join(F.broadcast(before), "__p").crossJoin(F.broadcast(top))
    d = d.withColumn("previous_max", F.greatest("__in", "__b", "__top"))
    return d.where(F.col(column) > F.col("previous_max")).drop("__p", "__in", "__b", "__top")


def _sides(model: DataFrame, alerts: DataFrame, key: str) -> DataFrame:
    m = model.select(key).distinct().withColumn("m", F.lit(True))
    a = alerts.select(key).distinct().withColumn("a", F.lit(True))
    side = F.when(F.col("m").isNotNull() & F.col("a").isNotNull(), "both").when(F.col("m").isNotNull(), "model_only").otherwise("alert_only")
    return m.join(a, key, "full").select(key, side.alias("side"))


def alert_contingency(model: DataFrame, alerts: DataFrame, key: str, population: DataFrame | None = None) -> DataFrame:
    """Counts of keys flagged by the model, by alerts, by both, and of those of
    `population` (where given) flagged by neither."""
    sides = _sides(model, alerts, key)
    if population is not None:
        rest = population.select(key).distinct().join(sides.select(key), key, "left_anti").withColumn("side", F.lit("neither"))
        sides = sides.unionByName(rest)
    return sides.groupBy("side").agg(F.count("*").alias("n"))


#: Labels by which an analyst confirms a candidate.
CONFIRMED = ("security_relevant", "suspicious", "true_positive")


def label_breakdown(model: DataFrame, alerts: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """side, label (`pending` without one), n, confirmed: keys of each side by
    their newest label. labels: key, label, at; of labels at one time the largest counts."""
    newest = labels.groupBy(key).agg(F.max(F.struct("at", "label")).alias("l")).select(key, F.col("l.label").alias("label"))
    out = _sides(model, alerts, key).join(newest, key, "left").groupBy("side", F.coalesce("label", F.lit("pending")).alias("label")).agg(F.count("*").alias("n"))
    return out.withColumn("confirmed", F.col("label").isin(*CONFIRMED))


def candidates(ep: DataFrame, alerts: DataFrame, drift: DataFrame, tolerance_s: int = 300) -> DataFrame:
    """Episodes that no alert explains, with what an analyst needs: episode_id,
    peak_evidence, temporal_context (labels over all episodes), drift_context
    (`feature: status` of the features that drifted; drift: feature, status, one
    row per feature) and the statement of clearance."""
    moved = F.when(~F.col("status").contains("No Drift"), F.concat("feature", F.lit(": "), "status"))
    lines = drift.agg(F.array_sort(F.collect_list(moved)).alias("drift_context"))  # one row, an entry per feature
    found = model_only(ep, alerts, tolerance_s).select("episode_id", "peak_evidence")
    out = found.join(temporal_labels(ep).withColumnRenamed("labels", "temporal_context"), "episode_id").crossJoin(F.broadcast(lines))
    return out.withColumn("clearance", F.lit(f"no alert on one of its entities within {tolerance_s} seconds"))


def daily_flag_rate(scored: DataFrame, flag: Column) -> DataFrame:
    """Mean and deviation of the daily flag rate in percent, with a label."""
    d = scored.groupBy(F.floor(F.col("window_id") * 5 / 86400).alias("day")).agg(F.avg(flag.cast("double")).alias("rate"))
    out = d.agg((F.avg("rate") * 100).alias("mean_pct"), (F.stddev_pop("rate") * 100).alias("std_pct"))
    return out.withColumn("stability", F.when(F.col("std_pct") < 1.0, "STABLE").when(F.col("std_pct") < 5.0, "MODERATE").otherwise("POOR"))
