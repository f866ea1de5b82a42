"""Column names and types of the raw logs and the feature tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of each headerless raw log, in file order.
LOG_COLUMNS = {
    "auth": ["time", "src_user", "dst_user", "src_comp", "dst_comp", "auth_type",
             "logon_type", "orientation", "result"],
    "proc": ["time", "user", "computer", "process", "event"],
    "flows": ["time", "duration", "src_comp", "src_port", "dst_comp", "dst_port",
              "protocol", "packets", "bytes"],
    "dns": ["time", "src_comp", "resolved"],
    "redteam": ["time", "user", "src_comp", "dst_comp"],
}

# Texts that mean "missing" in a raw log ("?" and the usual CSV tokens).
NULL_TOKENS = [
    "?", "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

KEYS = ["src_comp", "day", "win"]

# Feature columns of each log, in output order.
AUTH_FEATURES = [
    "auth_total", "auth_success", "auth_failure", "auth_interactive", "auth_remote",
    "auth_service", "auth_batch", "auth_network", "auth_unlock", "auth_other", "auth_fail_rate",
]
PROC_FEATURES = [
    "proc_events", "proc_start", "proc_end", "proc_service_events", "proc_user_events",
]
FLOW_FEATURES = [
    "flows_count", "flows_bytes", "flows_packets", "flows_duration_sum", "tcp_flows", "udp_flows",
    "wellknown_dst_flows", "http80_flows", "https443_flows", "bytes_per_flow", "packets_per_flow",
    "tcp_fraction", "wellknown_fraction",
]
DNS_FEATURES = ["dns_queries"]

# Features kept as DOUBLE; all others are counts.
DOUBLE_FEATURES = {
    "auth_fail_rate", "flows_bytes", "flows_packets", "flows_duration_sum", "bytes_per_flow",
    "packets_per_flow", "tcp_fraction", "wellknown_fraction",
}

EDR_COLUMNS = [*KEYS, *AUTH_FEATURES, *PROC_FEATURES, "label"]
XDR_COLUMNS = [*KEYS, *AUTH_FEATURES, *PROC_FEATURES, *FLOW_FEATURES, *DNS_FEATURES, "label"]

# Days kept for the study, and their train and test parts.
TRAIN_DAYS = [1, 2, 5, 6, 7, 8, 9, 12, 13, 14, 15, 20, 21, 22]
TEST_DAYS = [26, 27, 28, 29]
KEPT_DAYS = TRAIN_DAYS + TEST_DAYS

WINDOW_SECONDS = 300
DAY_SECONDS = 86_400


def log_schema(kind: str) -> T.StructType:
    """All-string schema of one raw log."""
    return T.StructType([T.StructField(c, T.StringType()) for c in LOG_COLUMNS[kind]])


def master_schema(columns: list[str]) -> T.StructType:
    """Typed schema of a feature table with the given columns."""
    def kind(name: str) -> T.DataType:
        if name == "src_comp":
            return T.StringType()
        if name == "label":
            return T.IntegerType()
        return T.DoubleType() if name in DOUBLE_FEATURES else T.LongType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns])
