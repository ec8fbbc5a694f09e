"""Scalar column functions of the telemetry engine (JVM-side expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unk(x: Column | str) -> Column:
    """Null and empty become the category "unknown", which counts as a value."""
    return F.coalesce(F.nullif(c(x), F.lit("")), F.lit("unknown"))


def port_unk(x: Column | str) -> Column:
    """Null and port 0 become -1, which counts as a value."""
    return F.coalesce(F.nullif(c(x).cast("long"), F.lit(0).cast("long")), F.lit(-1).cast("long"))


def connection_key(source: Column | str, destination: Column | str, port: Column | str) -> Column:
    p = F.coalesce(F.nullif(c(port).cast("long"), F.lit(0).cast("long")).cast("string"), F.lit("unknown"))
    return F.concat_ws(":", unk(source), unk(destination), p)


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = f"^{_OCTET}(\\.{_OCTET}){{3}}$"
_HEX4 = "[0-9a-fA-F]{1,4}"
IPV6 = (
    f"^(({_HEX4}:){{7}}{_HEX4}|({_HEX4}:){{1,7}}:|:(:{_HEX4}){{1,7}}|::|"
    + "|".join(f"({_HEX4}:){{1,{i}}}(:{_HEX4}){{1,{7 - i}}}" for i in range(1, 7))
    + ")$"
)


def valid_ip(x: Column | str) -> Column:
    """IPv4 or IPv6 in text form."""
    return F.coalesce(c(x).rlike(IPV4) | c(x).rlike(IPV6), F.lit(False))


def ipv4_number(x: Column | str) -> Column:
    """IPv4 text as a number, null for anything else."""
    n = F.aggregate(F.split(c(x), "\\."), F.lit(0).cast("long"), lambda a, part: a * 256 + part.try_cast("long"))
    return F.when(c(x).rlike(IPV4), n)


#: Networks that count as internal.
INTERNAL = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")


def is_internal(x: Column | str, networks: tuple[str, ...] = INTERNAL) -> Column:
    """Whether an address is in one of the networks; false for what is no IPv4."""
    import ipaddress

    bounds = [(int(net.network_address), int(net.broadcast_address)) for net in map(ipaddress.ip_network, networks)]
    # a lambda's argument is computed once, however many networks look at it
    inside = F.exists(F.array(ipv4_number(x)), lambda n: reduce(lambda a, b: a | b, [n.between(lo, hi) for lo, hi in bounds], F.lit(False)))
    return F.coalesce(inside, F.lit(False))


def normalize_cmdline(x: Column | str) -> Column:
    """Lower case; UUIDs, addresses, long hexadecimal and decimal numbers are
    masked in this order; tokens that are paths become <PATH>; spaces collapse;
    null and empty become unknown."""
    t = F.lower(c(x))
    for pattern, mask in (
        ("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
        ("(?U)\\b\\d{1,3}(\\.\\d{1,3}){3}\\b", "<IP>"),
        ("(?U)\\b[0-9a-f]{8,}\\b", "<HEX>"),
        ("(?U)\\b\\d+\\b", "<NUM>"),
    ):
        t = F.regexp_replace(t, pattern, mask)
    path = lambda w: w.contains("/") | (w.contains("\\") & ~w.startswith("-")) | w.rlike(r"^[a-z]:\\")
    words = F.filter(F.split(t, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    out = F.array_join(F.transform(words, lambda w: F.when(path(w), F.lit("<PATH>")).otherwise(w)), " ")
    return F.when(F.coalesce(c(x), F.lit("")) == "", F.lit("unknown")).otherwise(out)


# ---- transforms over frozen statistics (columns of a broadcast one-row or per-feature table) ----
def robust_z(v: Column, median: Column, mad: Column, std: Column) -> Column:
    return F.when(median.isNull(), 0.0).when(mad != 0, (v - median) / mad).when(std != 0, (v - median) / std).otherwise(v - median)


def iqr_distance(v: Column, p25: Column, p75: Column, k: float = 1.5) -> Column:
    iqr = p75 - p25
    scale = F.when(iqr != 0, iqr).otherwise(F.lit(1.0))
    return F.when(v > p75 + k * iqr, (v - (p75 + k * iqr)) / scale).when(v < p25 - k * iqr, ((p25 - k * iqr) - v) / scale).otherwise(0.0)


def tail_distance(v: Column, p25: Column, p75: Column, p99: Column) -> Column:
    iqr = p75 - p25
    return F.when(v > p99, (v - p99) / F.when(iqr != 0, iqr).otherwise(F.lit(1.0))).otherwise(0.0)


KNOTS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def percentile_rank(v: Column, knots: list[Column], mad: Column) -> Column:
    """Piecewise linear over the quantiles KNOTS, asymptotic above the last."""
    low = F.when(v <= 0, 0.0).when(knots[0] > 0, 0.25 * v / knots[0]).otherwise(0.25)
    out = F.when(v.isNull() | knots[0].isNull(), 0.5).when(v <= knots[0], low)
    for a, b, x, y in zip(KNOTS, KNOTS[1:], knots, knots[1:]):
        out = out.when(v <= y, F.when(y == x, F.lit(b)).otherwise(a + (b - a) * (v - x) / (y - x)))
    d = (v - knots[-1]) / F.when(mad > 0, mad).otherwise(F.lit(1.0))
    return out.otherwise(0.999 + 0.001 * (1 - F.exp(-d)))


def frequency_rarity(count: Column, total: Column, unseen: float = 0.5) -> Column:
    """-log10 of the share; an unseen value counts as `unseen`."""
    n = F.coalesce(count, F.lit(0)).cast("double")
    pseudo = F.when(n == 0, F.lit(unseen)).otherwise(n)
    return F.when(total == 0, 0.0).otherwise(-F.log10(pseudo / (total + unseen)))
