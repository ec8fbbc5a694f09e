"""Canonical event schema: raw hits (JSON text) to typed columns, in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronosift.functions.scalar import valid_ip

VERSION = 1


@dataclass(frozen=True)
class Field:
    name: str
    paths: tuple[str, ...]
    kind: str = "string"  # string, lower, upper, list, ip, port


#: Canonical fields with their source paths by priority (fixed values of the schema).
FIELDS = (
    Field("event_id", ("event.id", "id")), Field("event_action", ("event.action", "action")), Field("event_category", ("event.category", "category"), "list"),
    Field("event_type", ("event.type", "type"), "list"), Field("event_outcome", ("event.outcome", "outcome"), "lower"), Field("user_name", ("user.name", "user")),
    Field("user_id", ("user.id",)), Field("source_ip", ("source.ip", "src_ip"), "ip"), Field("source_port", ("source.port", "src_port"), "port"),
    Field("destination_ip", ("destination.ip", "dest_ip", "dst_ip"), "ip"), Field("destination_port", ("destination.port", "dest_port", "dst_port"), "port"),
    Field("host_name", ("host.name", "hostname")), Field("host_ip", ("host.ip",), "ip"), Field("process_name", ("process.name", "proc_name")),
    Field("process_command_line", ("process.command_line", "command_line")), Field("process_parent_name", ("process.parent.name", "parent_process_name")),
    Field("network_protocol", ("network.protocol", "protocol")), Field("file_path", ("file.path",)), Field("log_level", ("log.level", "level"), "upper"),
    Field("message", ("message", "msg")), Field("agent_id", ("agent.id",)),
)
TIME_PATHS = ("@timestamp", "timestamp")


def schema() -> T.StructType:
    kinds = {"list": T.ArrayType(T.StringType()), "port": T.LongType()}
    head = [T.StructField("_id", T.StringType(), False), T.StructField("@timestamp", T.TimestampType(), False), T.StructField("raw_timestamp", T.StringType())]
    return T.StructType([*head, *[T.StructField(f.name, kinds.get(f.kind, T.StringType())) for f in FIELDS], T.StructField("raw_extra", T.StringType())])


def _path(doc: Column, path: str) -> Column:
    """A nested value of a variant. A key with a dot in it is not a path."""
    return F.try_variant_get(doc, "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")


def _apart(d: DataFrame, keep: list[str], more: dict[str, Column]) -> DataFrame:
    """Columns computed once per row: a generator of one row stands between them
    and what uses them, through which no expression is copied by the optimizer."""
    one = F.explode(F.array(F.struct(*[x.alias(n) for n, x in more.items()]))).alias("__one")
    return d.select(*[f"`{c}`" for c in keep], one).select(*[f"`{c}`" for c in keep], *[F.col(f"__one.`{n}`").alias(n) for n in more])


def _texts(hits: DataFrame, column: str) -> DataFrame:
    """Per path its value as text (`t_path`, null for objects and missing
    values), step by step so that nothing is computed twice: strings as they
    are, arrays as JSON, other scalars as text, whatever strings look like."""
    paths = [*TIME_PATHS, *dict.fromkeys(p for f in FIELDS for p in f.paths)]
    d = hits.select(F.col(column).alias("__hit"), F.try_parse_json(F.col(column)).alias("__v"))
    d = d.select("__hit", F.try_variant_get("__v", "$._id", "string").alias("__id"), F.try_variant_get("__v", "$._source", "variant").alias("__doc"))
    d = _apart(d, ["__hit", "__id", "__doc"], {f"v_{p}": _path(F.col("__doc"), p) for p in paths})
    d = _apart(d, [c for c in d.columns], {f"k_{p}": F.schema_of_variant(f"`v_{p}`") for p in paths})
    kind = lambda p: F.col(f"`k_{p}`")
    text = lambda p: F.when(kind(p).startswith("ARRAY"), F.to_json(f"`v_{p}`")).when(~kind(p).startswith("OBJECT"), F.try_variant_get(f"`v_{p}`", "$", "string"))
    return _apart(d, ["__hit", "__id", "__doc", *[f"k_{p}" for p in TIME_PATHS]], {f"t_{p}": text(p) for p in paths})


def _text(path: str) -> Column:
    return F.col(f"`t_{path}`")


def _key(f: Field) -> Column:
    """The top-level key that gave a field its value."""
    return F.coalesce(*[F.when(_text(p).isNotNull(), F.lit(p.split(".")[0])) for p in f.paths])


def timestamp_of(raw: Column, numeric: Column, now: Column | None = None) -> tuple[Column, Column]:
    """Time and reject reason of a raw value as text. JSON numbers (`numeric`)
    above 1e11 are milliseconds, other numbers seconds; strings are dates, also
    where they consist of digits: ISO 8601 with or without zone (UTC), and some
    free forms."""
    now = F.current_timestamp() if now is None else now
    number = raw.try_cast("double")
    micros = F.when(number > 1e11, number * 1e3).otherwise(number * 1e6).try_cast("long")
    forms = [
        "yyyyMMdd", "yyyyMMddHHmm", "yyyyMMddHHmmss", "yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmmssX", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd MMM yyyy HH:mm:ss", "MMM d, yyyy HH:mm:ss",
        "dd MMM yyyy HH:mm:ss Z", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy",
    ]
    bare = F.regexp_replace(raw, "^[A-Za-z]{3}, ", "")  # without the day's name
    digits = raw.rlike("^[0-9]+$")
    text = F.coalesce(F.when(~digits, raw.try_cast("timestamp")), *[F.try_to_timestamp(bare, F.lit(f)) for f in forms])
    ts = F.when(numeric, F.timestamp_micros(micros)).otherwise(text)
    missing = raw.isNull() | (raw == "") | (numeric & (number == 0))
    reason = (
        F.when(missing, "MISSING_TIMESTAMP").when(ts.isNull(), "INVALID_TIMESTAMP")
        .when(ts > now + F.expr("INTERVAL 1 HOUR"), "FUTURE_TIMESTAMP").when(ts < F.lit("2000-01-01").cast("timestamp"), "OUT_OF_RANGE_TIMESTAMP")
    )
    return ts, reason


def _normalised(raw: Column, f: Field) -> tuple[Column, Column | None]:
    if f.kind == "lower":
        return F.lower(raw), None
    if f.kind == "upper":
        return F.upper(raw), None
    if f.kind == "list":
        return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw)), None
    if f.kind == "ip":
        return raw, raw.isNotNull() & ~valid_ip(raw)
    if f.kind == "port":
        n = raw.try_cast("long")
        return n, n.isNotNull() & ~n.between(0, 65535)
    return raw, None


def python_text(ts: Column) -> Column:
    """A time as its ISO text in UTC with a space and an offset; microseconds only where there are some."""
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))


def list_text(items: Column) -> Column:
    """A list of strings with quotes, in brackets."""
    quoted = F.transform(items, lambda x: F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), x, F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def deterministic_id(ts: Column, host: Column, category: Column, action: Column, process: Column, message: Column) -> Column:
    """SHA-256 of the joined parts: the parsed time, host, list of categories,
    action, process, and the trimmed message in lower case. A missing part is
    the word None, a missing message none."""
    part = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    return F.sha2(F.concat_ws("|", part(python_text(ts)), part(host), part(list_text(category)), part(action), part(process), F.lower(F.trim(part(message)))), 256)


def canonicalise(hits: DataFrame, column: str = "value", now: Column | None = None) -> DataFrame:
    """hits: a text column with {"_id", "_source"}. Canonical columns plus
    `reject_reason` (null for good rows). raw_extra keeps, with their JSON types,
    the top-level keys of `_source` that gave no field its value."""
    d = _texts(hits, column)
    times = [F.nullif(_text(p), F.lit("")) for p in TIME_PATHS]
    number = lambda p: F.col(f"`k_{p}`").rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    numeric = F.coalesce(*[F.when(x.isNotNull(), number(p)) for p, x in zip(TIME_PATHS, times)], F.lit(False))
    values = {f.name: _normalised(F.coalesce(*[_text(p) for p in f.paths]), f) for f in FIELDS}
    bad = F.lit(False)
    for _, b in values.values():
        bad = bad if b is None else bad | F.coalesce(b, F.lit(False))
    used = F.array(F.lit(TIME_PATHS[0]), *[F.coalesce(_key(f), F.lit(TIME_PATHS[0])) for f in FIELDS])
    d = _apart(d, ["__hit", "__id", "__doc"], {"__raw": F.coalesce(*times), "__numeric": numeric, "__bad": bad, "__used": used, **{n: x for n, (x, _) in values.items()}})
    ts, reason = timestamp_of(F.col("__raw"), F.col("__numeric"), now)
    d = _apart(d, d.columns, {"__ts": ts, "__reason": reason, "__all": F.try_variant_get("__doc", "$", "map<string,variant>")})
    made = deterministic_id(F.col("__ts"), F.coalesce(F.nullif(F.col("host_name"), F.lit("")), F.col("host_ip")), F.col("event_category"), F.col("event_action"), F.col("process_name"), F.col("message"))
    d = d.withColumn("__extra", F.map_filter("__all", lambda k, _: ~F.array_contains("__used", k)))
    return d.select(
        F.coalesce(F.nullif(F.col("__id"), F.lit("")), made).alias("_id"), F.col("__ts").alias("@timestamp"), F.col("__raw").alias("raw_timestamp"), *[f.name for f in FIELDS],
        F.when(F.size("__extra") > 0, F.to_json("__extra")).alias("raw_extra"),
        F.coalesce("__reason", F.when(F.col("__doc").isNull() | F.col("__bad"), "SCHEMA_ERROR")).alias("reject_reason"), F.col("__hit").alias("raw_hit"),
    )


def split_rejects(canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows in the canonical schema; rejected hits with their reason."""
    good = canonical.where("reject_reason IS NULL").drop("reject_reason", "raw_hit")
    return good, canonical.where("reject_reason IS NOT NULL").select("reject_reason", "raw_hit")
