import math

import pytest
from pyspark.sql import functions as F

from hostwin.functions.scalars import (
    clean_inf, day_id, drop_unparseable, flag, flag_contains, flag_other, hash_long, hash_unit,
    null_tokens, port_flags, safe_ratio, to_floor, to_int, to_num, window_floor)


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    return [r["v"] for r in df.select("i", fn(F.col("c")).alias("v")).orderBy("i").collect()]


TEXTS = ["1.5", "1e3", " 7 ", "7.0", "NA", "?", "", None, "1d", "0x10", "NaN", "-3.5", "inf"]


def test_to_int(spark):
    assert column(spark, TEXTS, to_int) == [
        None, 1000, 7, 7, None, None, None, None, None, None, None, None, None]


def test_to_num(spark):
    assert column(spark, TEXTS, to_num) == [
        1.5, 1000.0, 7.0, 7.0, None, None, None, None, None, None, None, -3.5, math.inf]


def test_to_floor(spark):
    assert column(spark, TEXTS, to_floor) == [
        1, 1000, 7, 7, None, None, None, None, None, None, None, -4, None]


def test_large_integers_keep_every_digit(spark):
    big = "9007199254740993"
    assert column(spark, [big, "99999999999999999999"], to_int) == [int(big), None]


def test_window_edges(spark):
    times = [0, 299, 300, 86399, 86400, -1]
    assert column(spark, times, lambda c: window_floor(c, 300), "bigint") == [
        0, 0, 300, 86100, 86400, -300]
    assert column(spark, times, day_id, "bigint") == [0, 0, 0, 0, 1, -1]


def test_flags(spark):
    assert column(spark, ["a", "b", None], lambda c: flag(c, "a")) == [1, 0, 0]
    assert column(spark, ["a", "z", None], lambda c: flag_other(c, ["a", "b"])) == [0, 1, 0]
    users = ["C1$@DOM1", "U1@DOM1", "a$@b", None]
    assert column(spark, users, lambda c: flag_contains(c, "$@")) == [1, 0, 1, 0]


@pytest.mark.parametrize("name, expected", [
    ("wellknown_dst_flows", [1, 0, 1, 1, 0, 0]),
    ("http80_flows", [0, 0, 1, 0, 0, 0]),
    ("https443_flows", [0, 0, 0, 1, 0, 0])])
def test_ports(spark, name, expected):
    ports = ["1024", "1025", "80", "443", "N123", None]
    assert column(spark, ports, lambda c: port_flags(c)[name]) == expected


def test_safe_ratio(spark):
    assert column(spark, [0, 4, None], lambda c: safe_ratio(F.lit(1), c), "int") == [0.0, 0.25, 0.0]


def test_null_tokens_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "?", "x"), (2, "NA", "None"), (3, "na", "?x")],
                               "i bigint, a string, b string")
    assert [tuple(r) for r in null_tokens(df).collect()] == [
        (1, None, "x"), (2, None, None), (3, "na", "?x")]
    assert [tuple(r) for r in null_tokens(df, ["a"]).collect()][1] == (2, None, "None")


def test_clean_inf(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (-math.inf,), (math.nan,), (None,)], "x double")
    assert [r.x for r in clean_inf(df, ["x"]).collect()] == [1.0, None, None, None, None]


def test_drop_unparseable(spark):
    df = spark.createDataFrame([("1", "5"), ("x", "5"), ("2", "y"), (" 3", "6")],
                               "day string, win string")
    assert [tuple(r) for r in drop_unparseable(df, "day", "win").collect()] == [(1, 5), (3, 6)]


def test_hashes_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = df.repartition(7).select("id", hash_long(1, "a", F.col("id")).alias("h"))
    b = df.coalesce(1).select("id", hash_long(1, "a", F.col("id")).alias("h"))
    assert a.exceptAll(b).count() == 0
    low, high, mean = df.select(hash_unit(3, F.col("id")).alias("u")).agg(
        F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.05
