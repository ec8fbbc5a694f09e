"""Reports over ranked windows: context, ratios to the baseline, explanations,
rates with a gate, and their files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.operators.baselines import exact_quantiles, melt
from chronosift.sources.extraction import write_text

#: Flag rates in percent between which a result counts as sane.
SANE = (0.01, 15.0)
MODEL_ONLY = ("behavioural", "statistical")


def medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact median of each feature; NaN and null don't count."""
    long = melt(df, features).where(~F.isnan("value"))
    return {r.feature: r.m for r in exact_quantiles(long, [0.5]).select("feature", F.col("q")[0].alias("m")).collect()}


def ratio(value: Column, median: float) -> Column:
    """Value over the baseline's median; 0 where that isn't positive."""
    return (value / F.lit(float(median))) if median > 0 else F.lit(0.0)


def neighbours(top: DataFrame, scored: DataFrame, columns: list[str]) -> DataFrame:
    """The windows before and after each top window, as previous_* and next_*; null where there is none."""
    out = top
    for name, by in (("previous", -1), ("next", 1)):
        side = scored.select((F.col("window_id") - by).alias("window_id"), *[F.col(c).alias(f"{name}_{c}") for c in columns])
        out = out.join(side, "window_id", "left")
    return out


def explanation(feature: Column, score: Column, kind: str = "Robust Z-Score") -> Column:
    return F.concat(F.lit("Driven by "), feature, F.lit(f" ({kind}: "), F.format_string("%.2f", score), F.lit(")"))


def novel_relations(events: DataFrame, base: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """window_id, novel_relations: the window's pairs that the baseline lacks, as
    sorted `a -> b`. Pairs with a null don't count; a window's set is small."""
    known = base.select(*keys).dropna().distinct()
    fresh = events.select("window_id", *keys).dropna().distinct().join(known, list(keys), "left_anti")
    return fresh.groupBy("window_id").agg(F.array_sort(F.collect_set(F.concat(keys[0], F.lit(" -> "), keys[1]))).alias("novel_relations"))


def report_rows(top: DataFrame, evidence: dict[str, str], baseline: dict[str, float], agree: float = 0.90, window_s: int = 5, relations: DataFrame | None = None) -> DataFrame:
    """Top windows (see investigation.top_windows) with what a report shows: ISO
    times, detectors that agree, ratios to the baseline's medians, new relations
    (where given, see novel_relations) and a flag for windows that only models
    see; nested columns also as JSON."""
    if relations is not None:
        top = top.join(relations, "window_id", "left").withColumn("novel_relations", F.coalesce("novel_relations", F.array().cast("array<string>")))
    names = F.array(*[F.when(F.col(c) >= agree, F.lit(n)) for n, c in evidence.items()])
    ratios = F.create_map(*[x for f, m in baseline.items() for x in (F.lit(f), ratio(F.col(f).cast("double"), m))]) if baseline else F.lit(None).cast("map<string,double>")
    iso = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = top.withColumns({
        "window_start": iso(F.col("window_id") * window_s), "window_end": iso((F.col("window_id") + 1) * window_s), "agreeing_detectors": F.filter(names, lambda x: x.isNotNull()),
        "baseline_ratios": ratios, "model_only": F.col("primary_category").isin(*MODEL_ONLY),
    })
    nested = {"agreeing_json": "agreeing_detectors", "ratios_json": "baseline_ratios"} | ({"relations_json": "novel_relations"} if relations is not None else {})
    return out.withColumns({k: F.to_json(v) for k, v in nested.items()})


#: Columns of a stored top table that hold JSON, the columns they are read back as, and their types.
NESTED = {"agreeing_json": ("agreeing_detectors", "array<string>"), "ratios_json": ("baseline_ratios", "map<string,double>"), "relations_json": ("novel_relations", "array<string>")}


def parsed(top: DataFrame) -> DataFrame:
    """A stored top table with its JSON columns parsed back; those it lacks are left out."""
    return top.withColumns({name: F.from_json(c, kind) for c, (name, kind) in NESTED.items() if c in top.columns})


def anomaly_rates(scored: DataFrame, flag: Column, window_s: int = 5) -> DataFrame:
    """One row: windows, flagged ones, their share in percent, flags per day and hour, and whether the share is sane."""
    r = scored.agg(F.count("*").alias("windows"), F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias("flagged"), ((F.max("window_id") - F.min("window_id") + 1) * window_s).alias("span_s"))
    share = F.coalesce(F.try_divide(F.col("flagged") * 100.0, F.col("windows")), F.lit(0.0))
    return r.select("windows", "flagged", share.alias("pct"), (F.col("flagged") * 86400.0 / F.col("span_s")).alias("per_day"), (F.col("flagged") * 3600.0 / F.col("span_s")).alias("per_hour"), share.between(*SANE).alias("sane"))


def ordered_events(attributed: DataFrame) -> DataFrame:
    """Attributed events in the order of their times."""
    return attributed.orderBy("ts", "_id")


def results_package(experiment: str, dataset: dict, rates: dict[str, dict], top: list[dict]) -> dict:
    """What an experiment leaves behind, checked before it is returned."""
    out = {"experiment_id": experiment, "dataset": dataset, "detectors": rates, "top_windows": top}
    problems = []
    if not experiment:
        problems.append("experiment_id is empty")
    problems += [f"dataset.{k} is missing" for k in ("windows", "days") if not isinstance(dataset.get(k), (int, float))]
    problems += [f"detectors.{n}.{k} is no number" for n, r in rates.items() for k in ("mean_pct", "std_pct") if not isinstance(r.get(k), (int, float))]
    problems += [f"top_windows[{i}].window_id is missing" for i, r in enumerate(top) if "window_id" not in r]
    if problems:
        raise ValueError("; ".join(problems))
    return out


def write_report(spark: SparkSession, path: str, package: dict, title: str = "Top windows") -> None:
    """`path`.json, and `path`.md with one line per top window. The rows are the report's, at most a hundred."""
    rows = package["top_windows"]
    columns = list(rows[0]) if rows else []
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    table = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *["| " + " | ".join(cell(r.get(c, "")) for c in columns) + " |" for r in rows]] if rows else ["No windows."]
    write_text(spark, f"{path}.json", json.dumps(package, sort_keys=True, default=str, indent=1))
    write_text(spark, f"{path}.md", "\n".join([f"# {title}", "", *table, ""]))


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}.json", wholetext=True).first().value)
