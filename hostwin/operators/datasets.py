"""Endpoint (EDR) and endpoint-plus-network (XDR) tables, with labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwin.operators.features import (
    FEATURES, derived_features, keyed_rows, redteam_rows, sum_of)
from hostwin.schemas import EDR_COLUMNS, KEYS, WINDOW_SECONDS, XDR_COLUMNS


def build_edr(auth: DataFrame, proc: DataFrame) -> DataFrame:
    """Full outer join of two feature tables; features of the absent side are 0."""
    return auth.join(proc, KEYS, "full_outer").na.fill(0)


def attach_label(df: DataFrame, bad: DataFrame) -> DataFrame:
    """Label 1 for the listed windows, 0 otherwise.

    A window start fixes its day, so joining on all three keys gives what (host, window)
    gives, and keeps the partitioning of the feature joins. The size of ``bad`` grows with
    the logs, so the planner decides whether it is small enough to broadcast.
    """
    keys = [k for k in KEYS if k in bad.columns]
    return (df.join(bad.select(*keys, "label"), keys, "left")
            .withColumn("label", F.coalesce("label", F.lit(0)).cast("int")))


def build_xdr(edr: DataFrame, flows: DataFrame, dns: DataFrame,
              keep_network_only: bool = False) -> DataFrame:
    """Add network features to endpoint windows, label last.

    Windows seen only by the network logs are dropped, unless ``keep_network_only``. Their
    label is then 0 until :func:`attach_label` is applied again.
    """
    how = "full_outer" if keep_network_only else "left"
    joined = edr.join(flows, KEYS, how).join(dns, KEYS, how).na.fill(0)
    return joined.select(*[c for c in joined.columns if c != "label"], "label")


def build_master(logs: dict[str, DataFrame], width: int = WINDOW_SECONDS,
                 keep_network_only: bool = False) -> DataFrame:
    """The XDR table straight from the five raw logs, with a single shuffle.

    Every log is keyed alike, so the rows of all logs are united and aggregated once:
    partial sums per task, one exchange, no joins and no sorts. Label rows take part like
    any other log. Unusable rows fall into groups that no log counts, which are dropped.
    """
    return finish_master(add_up(master_rows(logs, width)), keep_network_only)


def master_rows(logs: dict[str, DataFrame], width: int = WINDOW_SECONDS) -> DataFrame:
    """(src_comp, day, win), measures and label of every raw row of the five logs, batch or streaming."""
    parts = [keyed_rows(logs[kind], kind, width) for kind in FEATURES]
    parts.append(redteam_rows(logs["redteam"], width).withColumn("label", F.lit(1)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def add_up(rows: DataFrame) -> DataFrame:
    """Measures added up per window, of raw rows or of earlier sums; a label stays if any row has it."""
    label = [F.coalesce(F.max("label"), F.lit(0)).alias("label")] if "label" in rows.columns else []
    return rows.groupBy(*KEYS).agg(*[sum_of(n) for n in rows.columns if n not in (*KEYS, "label")], *label)


def finish_master(table: DataFrame, keep_network_only: bool = False) -> DataFrame:
    """The XDR table of the windows of :func:`add_up`: derived features, and only windows that a log has."""
    seen = F.col("auth_total") + F.col("proc_events")
    if keep_network_only:
        seen = seen + F.col("flows_count") + F.col("dns_queries")
    for kind in FEATURES:
        table = table.withColumns(derived_features(kind))
    return table.filter(seen > 0).select(*XDR_COLUMNS)


def edr_of(master: DataFrame) -> DataFrame:
    """The endpoint columns of an XDR table: the two tables hold the same windows."""
    return master.select(*EDR_COLUMNS)


def semi_keys(df: DataFrame, keys: DataFrame, anti: bool = False) -> DataFrame:
    """Rows whose composite key is listed, or with ``anti`` those whose key is not."""
    return df.join(keys, keys.columns, "left_anti" if anti else "left_semi")


def dataset_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, malicious rows, distinct days and last day of each table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows"),
               F.coalesce(F.sum(F.col("label").cast("bigint")), F.lit(0)).alias("malicious"),
               F.count_distinct("day").alias("days"), F.max("day").alias("last_day"))
        .select(F.lit(name).alias("dataset"), "n_rows", "malicious", "days", "last_day")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
