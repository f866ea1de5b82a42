import pytest
from pyspark.sql import functions as F

from hostwin.functions.scalars import null_tokens
from hostwin.operators import datasets, features
from hostwin.schemas import EDR_COLUMNS, KEYS, LOG_COLUMNS, XDR_COLUMNS, log_schema
from hostwin.sources import fixtures


def log(spark, kind, *rows):
    names = LOG_COLUMNS[kind]
    data = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, log_schema(kind))


def test_width_must_divide_a_day(spark):
    with pytest.raises(ValueError, match="divide"):
        features.auth_features(log(spark, "auth"), 7000)


@pytest.mark.parametrize("kind", ["auth", "proc", "flows", "dns"])
def test_empty_log_keeps_columns(spark, kind):
    fn = {"auth": features.auth_features, "proc": features.proc_features,
          "flows": features.flow_features, "dns": features.dns_features}[kind]
    df = fn(log(spark, kind))
    assert df.columns == [*KEYS, *features.FEATURES[kind]] and df.count() == 0


def test_unusable_rows_are_dropped(spark):
    df = log(spark, "auth", {"time": "1.5", "src_comp": "A"}, {"time": "10"},
             {"src_comp": "A"}, {"time": "10", "src_comp": "A", "result": "Failure"})
    rows = features.auth_features(df).collect()
    assert [(r.src_comp, r.win, r.auth_total, r.auth_fail_rate) for r in rows] == [("A", 0, 1, 1.0)]


def test_missing_volumes_sum_to_zero(spark):
    df = log(spark, "flows", {"time": "10.9", "src_comp": "A"},
             {"time": "299", "src_comp": "A", "protocol": "6", "dst_port": "N1"})
    row = features.flow_features(df).first()
    assert (row.flows_count, row.flows_bytes, row.bytes_per_flow, row.tcp_flows) == (2, 0.0, 0.0, 1)
    assert row.tcp_fraction == 0.5


def test_logon_type_other_needs_a_value(spark):
    df = log(spark, "auth", *[{"time": "1", "src_comp": "A", "logon_type": t}
                              for t in ("Batch", "NewCredentials", None)])
    row = features.auth_features(df).first()
    assert (row.auth_total, row.auth_batch, row.auth_other) == (3, 1, 1)


def test_redteam_row_needs_both_hosts(spark):
    df = log(spark, "redteam", {"time": "10", "src_comp": "A", "dst_comp": "B"},
             {"time": "20", "src_comp": "A", "dst_comp": "B"},
             {"time": "900", "src_comp": "A"}, {"time": "x", "src_comp": "A", "dst_comp": "B"})
    keys = features.redteam_keys(df).collect()
    assert sorted((r.src_comp, r.day, r.win, r.label) for r in keys) == [
        ("A", 0, 0, 1), ("B", 0, 0, 1)]


@pytest.fixture(scope="module")
def logs(spark, sf):
    b = fixtures.base(spark, sf)
    return {k: null_tokens(fixtures.view_of(b, k)) for k in fixtures.LOGS}


@pytest.mark.parametrize("width", [300, 21_600])
def test_one_shuffle_and_joins_agree(spark, logs, width):
    fused = datasets.build_master(logs, width)
    edr = datasets.attach_label(
        datasets.build_edr(features.auth_features(logs["auth"], width),
                           features.proc_features(logs["proc"], width)),
        features.redteam_keys(logs["redteam"], width))
    xdr = datasets.build_xdr(edr, features.flow_features(logs["flows"], width),
                             features.dns_features(logs["dns"], width))
    assert fused.columns == XDR_COLUMNS == xdr.columns and edr.columns == EDR_COLUMNS
    assert fused.exceptAll(xdr).count() == 0 and xdr.exceptAll(fused).count() == 0
    assert datasets.edr_of(fused).exceptAll(edr).count() == 0


def test_master_needs_one_exchange(logs):
    plan = datasets.build_master(logs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Sort" not in plan


def test_sums_hold(logs):
    row = datasets.build_master(logs).agg(
        F.sum("auth_total"), F.sum(F.col("proc_service_events") + F.col("proc_user_events")
                                   - F.col("proc_events")),
        F.max(F.col("proc_start") + F.col("proc_end") - F.col("proc_events"))).first()
    kept = logs["auth"].filter("time is not null and src_comp is not null").count()
    assert tuple(row) == (kept, 0, 0)


def test_hot_host_is_counted_whole(spark):
    rows = spark.range(30_000).select(
        (F.col("id") % 600).cast("string").alias("time"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(
            F.concat(F.lit("C"), (F.col("id") % 97).cast("string"))).alias("src_comp"),
        F.lit("x").alias("resolved"))
    got = features.dns_features(rows, distinct=True)
    assert got.filter("src_comp = 'HOT'").agg(F.sum("dns_queries")).first()[0] == 10_000
    assert got.agg(F.sum("dns_queries")).first()[0] == 30_000


def test_merge_partials_equals_whole(spark, logs):
    auth = logs["auth"]
    early = F.col("time").cast("double") < 900_000
    parts = [features.sums(auth.filter(c), "auth", 21_600) for c in (early, ~early)]
    merged = features.finish(features.merge_partials(parts), "auth")
    whole = features.auth_features(auth, 21_600)
    assert merged.exceptAll(whole).count() == 0 and merged.count() == whole.count()
