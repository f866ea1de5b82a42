"""Per (host, day, window) features of each raw log.

Each log is described once, by the numbers a single raw row adds to its window. Batch
features, the fused master table, daily increments and the stream all sum these numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.functions.scalars import (
    day_id, flag, flag_contains, flag_other, port_flags, safe_ratio, to_floor, to_int, to_num,
    window_floor)
from hostwin.schemas import (
    AUTH_FEATURES, DAY_SECONDS, DNS_FEATURES, DOUBLE_FEATURES, FLOW_FEATURES, KEYS,
    PROC_FEATURES, WINDOW_SECONDS)

FEATURES = {
    "auth": AUTH_FEATURES, "proc": PROC_FEATURES, "flows": FLOW_FEATURES, "dns": DNS_FEATURES,
}

# Logon types with a counter of their own.
LOGON_COUNTERS = {
    "auth_interactive": "Interactive",
    "auth_remote": "RemoteInteractive",
    "auth_service": "Service",
    "auth_batch": "Batch",
    "auth_network": "Network",
    "auth_unlock": "Unlock",
}
TCP, UDP = 6, 17
SERVICE_MARK = "$@"


def check_width(width: int) -> None:
    """Windows must tile a day, so that a window start fixes its day."""
    if width <= 0 or DAY_SECONDS % width:
        raise ValueError(f"window of {width} s does not divide a day")


def row_measures(kind: str) -> dict[str, Column]:
    """What one raw row of a log adds to its window."""
    if kind == "auth":
        logon, result = F.col("logon_type"), F.col("result")
        return {
            "auth_total": F.lit(1),
            "auth_success": flag(result, "Success"),
            "auth_failure": flag(result, "Failure"),
            **{name: flag(logon, value) for name, value in LOGON_COUNTERS.items()},
            "auth_other": flag_other(logon, list(LOGON_COUNTERS.values())),
        }
    if kind == "proc":
        return {
            "proc_events": F.lit(1),
            "proc_start": flag(F.col("event"), "Start"),
            "proc_end": flag(F.col("event"), "End"),
            "proc_service_events": flag_contains(F.col("user"), SERVICE_MARK),
        }
    if kind == "flows":
        protocol = to_num(F.col("protocol"))
        return {
            "flows_count": F.lit(1),
            "flows_bytes": to_num(F.col("bytes")),
            "flows_packets": to_num(F.col("packets")),
            "flows_duration_sum": to_num(F.col("duration")),
            "tcp_flows": flag(protocol, TCP),
            "udp_flows": flag(protocol, UDP),
            **port_flags(F.col("dst_port")),
        }
    if kind == "dns":
        return {"dns_queries": F.lit(1)}
    raise ValueError(f"unknown log '{kind}'")


def derived_features(kind: str) -> dict[str, Column]:
    """Features computed from the sums of a log."""
    if kind == "auth":
        return {"auth_fail_rate": safe_ratio(F.col("auth_failure"), F.col("auth_total"))}
    if kind == "proc":
        return {"proc_user_events": F.col("proc_events") - F.col("proc_service_events")}
    if kind == "flows":
        count = F.col("flows_count")
        return {
            "bytes_per_flow": safe_ratio(F.col("flows_bytes"), count),
            "packets_per_flow": safe_ratio(F.col("flows_packets"), count),
            "tcp_fraction": safe_ratio(F.col("tcp_flows"), count),
            "wellknown_fraction": safe_ratio(F.col("wellknown_dst_flows"), count),
        }
    return {}


# The number of usable rows of each log.
ROW_COUNTS = {
    "auth": "auth_total", "proc": "proc_events", "flows": "flows_count", "dns": "dns_queries",
}


def measured_rows(df: DataFrame, kind: str, *extra: Column) -> DataFrame:
    """(src_comp, time, measures) of every raw row, usable or not.

    Flow times may carry a fraction; the other logs accept whole numbers only.
    """
    host = F.col("computer" if kind == "proc" else "src_comp")
    time = (to_floor if kind == "flows" else to_int)(F.col("time"))
    return df.select(host.alias("src_comp"), time.alias("time"), *extra,
                     *[c.alias(n) for n, c in row_measures(kind).items()])


def keyed_rows(df: DataFrame, kind: str, width: int, *extra: Column) -> DataFrame:
    """(src_comp, day, win) and the measures of every raw row.

    A row without a time or host is not usable and adds 0 to the row count of its log.
    Dropping such groups by their count after the aggregation, not the rows before it,
    saves parsing every time twice.
    """
    check_width(width)
    rows = with_window(measured_rows(df, kind, *extra), width)
    usable = F.col("src_comp").isNotNull() & F.col("win").isNotNull()
    return rows.withColumn(ROW_COUNTS[kind], F.when(usable, 1).otherwise(0))


def with_window(df: DataFrame, width: int, time: str = "time") -> DataFrame:
    """Replace a BIGINT time by its day and window start."""
    t = F.col(time)
    return df.select(
        "src_comp", day_id(t).alias("day"), window_floor(t, width).alias("win"),
        *[c for c in df.columns if c not in ("src_comp", time)])


def sum_of(name: str) -> Column:
    """Sum of a measure; 0 when no row had a value."""
    zero = F.lit(0.0) if name in DOUBLE_FEATURES else F.lit(0)
    return F.coalesce(F.sum(name), zero).alias(name)


def sums(df: DataFrame, kind: str, width: int) -> DataFrame:
    """Additive features of a log: no ratios, so that increments can be added up."""
    rows = keyed_rows(df, kind, width)
    summed = rows.groupBy(*KEYS).agg(*[sum_of(n) for n in rows.columns if n not in KEYS])
    return summed.filter(F.col(ROW_COUNTS[kind]) > 0)


def finish(df: DataFrame, kind: str) -> DataFrame:
    """Add the derived features to the sums of a log, in output order."""
    return df.withColumns(derived_features(kind)).select(*KEYS, *FEATURES[kind])


def auth_features(df: DataFrame, width: int = WINDOW_SECONDS) -> DataFrame:
    """Logon counts by outcome and type, and the failure rate."""
    return finish(sums(df, "auth", width), "auth")


def proc_features(df: DataFrame, width: int = WINDOW_SECONDS) -> DataFrame:
    """Process starts, ends, service-account and user events."""
    return finish(sums(df, "proc", width), "proc")


def flow_features(df: DataFrame, width: int = WINDOW_SECONDS) -> DataFrame:
    """Flow counts, volumes, protocol and port counts, and ratios per flow."""
    return finish(sums(df, "flows", width), "flows")


def dns_features(df: DataFrame, width: int = WINDOW_SECONDS, distinct: bool = False) -> DataFrame:
    """Query count; ``distinct`` adds the number of different names asked for."""
    if not distinct:
        return finish(sums(df, "dns", width), "dns")
    rows = keyed_rows(df, "dns", width, F.col("resolved"))
    # Count per name first: a hot window is then spread over its names.
    names = rows.groupBy(*KEYS, "resolved").agg(F.sum("dns_queries").alias("dns_queries"))
    return names.groupBy(*KEYS).agg(
        sum_of("dns_queries"), F.count("resolved").alias("dns_distinct")).filter(
        "dns_queries > 0")


#: Accuracy of distinct-count sketches: 2**SKETCH_BITS registers, a relative error of about 1 %.
SKETCH_BITS = 14


def dns_partials(df: DataFrame, width: int = WINDOW_SECONDS) -> DataFrame:
    """Query count and a sketch of the names asked for, per window; :func:`merge_partials` adds them up."""
    rows = keyed_rows(df, "dns", width, F.col("resolved"))
    usable = F.when(F.col("dns_queries") > 0, F.col("resolved"))
    return rows.groupBy(*KEYS).agg(sum_of("dns_queries"), F.hll_sketch_agg(usable, SKETCH_BITS).alias(
        "resolved_sketch")).filter("dns_queries > 0")


def finish_dns(df: DataFrame) -> DataFrame:
    """The features of merged :func:`dns_partials`; ``dns_distinct`` is off by about 1 % in large windows."""
    return df.select(*KEYS, "dns_queries", F.hll_sketch_estimate("resolved_sketch").alias("dns_distinct"))


def merge_partials(frames: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Add up partial feature tables, such as one per day of delivery; sketches (BINARY) are united."""
    keys = keys or KEYS
    every = reduce(DataFrame.unionByName, frames)
    values = [(c, t) for c, t in every.dtypes if c not in keys]
    return every.groupBy(*keys).agg(*[
        (F.hll_union_agg(c) if t == "binary" else F.sum(c)).alias(c) for c, t in values])


def redteam_keys(df: DataFrame, width: int = WINDOW_SECONDS) -> DataFrame:
    """Distinct (src_comp, day, win) touched by a red-team action, with label 1.

    A row counts only if both computers are known; each then contributes a key.
    """
    return redteam_rows(df, width).distinct().withColumn("label", F.lit(1))


def redteam_rows(df: DataFrame, width: int) -> DataFrame:
    """The keys of :func:`redteam_keys` before duplicates are removed."""
    check_width(width)
    rows = df.select(to_int(F.col("time")).alias("time"), "src_comp", "dst_comp").na.drop()
    hosts = rows.select(F.explode(F.array("src_comp", "dst_comp")).alias("src_comp"), "time")
    return with_window(hosts, width)
