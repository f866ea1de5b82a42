import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostwin.operators import prep
from hostwin.operators.sampling import class_counts, two_classes


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def listed(codes):
    return [r[0] for r in codes.orderBy("code").collect()]


def test_target_and_features(spark):
    df = frame(spark, [("a", 1, 2, 3.0, 0)], "src_comp string, day int, win int, x double, y int")
    assert prep.find_target(df) == "y"
    assert prep.find_target(df.withColumn("label", F.lit(1))) == "label"
    assert prep.feature_columns(df) == ["day", "win", "x"]
    assert prep.feature_columns(df, include_time=False) == ["x"]
    with pytest.raises(ValueError, match="no target"):
        prep.find_target(df.drop("y"))


def test_prepare(spark):
    train = frame(spark, [
        (1, 1.0, 5, "bad"), (2, math.inf, 5, "good"), (3, 2.0, 5, "good"), (4, None, 5, "good"),
        (5, 4.0, 5, "good"), (6, 7.0, 5, "bad")], "row_id int, x double, c int, label string")
    test = frame(spark, [(7, None, "bad", 9.0), (8, 8.0, "good", 9.0)],
                 "row_id int, x double, label string, extra double")
    done = prep.prepare(train, test, keep=["row_id"])
    assert listed(done.codes) == ["bad", "good"] and done.features == ["x", "c"]
    assert done.medians == {"x": 3.0, "c": 5.0} and done.binary
    filled = np.array([1, 3, 2, 3, 4, 7], float)
    got = done.train.orderBy("row_id").toPandas()
    assert got["x"].to_numpy() == pytest.approx((filled - filled.mean()) / filled.std())
    assert got["c"].tolist() == [0.0] * 6 and got["y"].tolist() == [0, 1, 1, 1, 1, 0]
    rows = done.test.orderBy("row_id").collect()
    assert rows[0].x == pytest.approx((3 - filled.mean()) / filled.std())
    # The absent column is 0 before scaling; a constant column keeps deviation 1.
    assert [r.c for r in rows] == [-5.0, -5.0] and [r.y for r in rows] == [0, 1]


def test_test_without_target(spark):
    train = frame(spark, [(1.0, 0), (2.0, 1)], "x double, label int")
    done = prep.prepare(train, frame(spark, [(3.0,)], "x double"))
    assert done.test.first().y is None


def test_unseen_label_is_an_error(spark):
    df = frame(spark, [("c",)], "label string")
    with pytest.raises(Exception, match="unseen label: c"):
        prep.encode_labels(df, "label", prep.label_codes(frame(spark, [("a",), ("b",)], "label string"), "label")).collect()


def test_any_number_of_classes(spark):
    df = spark.range(12_000).select(F.concat(F.lit("c"), F.lpad("id", 6, "0")).alias("label"), "id")
    codes = prep.label_codes(df, "label")
    assert prep.encode_labels(df, "label", codes).filter("y <> id").count() == 0
    assert len(class_counts(df, "label")) == 12_000
    with pytest.raises(ValueError, match="exactly two"):
        two_classes(df, "label")


def test_numbers_sort_as_numbers(spark):
    assert listed(prep.label_codes(frame(spark, [(10,), (9,), (2,)], "label int"), "label")) == [2, 9, 10]


def test_class_statistics(spark):
    df = spark.range(1010).select((F.col("id") < 10).cast("int").alias("label"))
    row = prep.class_weights(df).first()
    assert (row.n, row.positives, row.pos_weight) == (1010, 10, 100.0)
    assert (row.weight_0, row.weight_1) == (pytest.approx(1010 / 2000), 50.5)
    balance = {r["class"]: r for r in prep.class_balance(df).collect()}
    assert balance[1].balance_pct == 1.0 and not balance[1].extreme_imbalance
    one = prep.class_balance(df.filter("label = 0")).first()
    assert one.balance_pct == 100.0
    assert prep.class_balance(df.filter("label = 0").union(df.filter("label = 1").limit(9))
                              ).first().extreme_imbalance


def test_baseline_tie_takes_lowest_class(spark):
    df = frame(spark, [(0,), (0,), (1,), (1,)], "label int")
    test = frame(spark, [(0,), (1,), (1,)], "label int")
    assert tuple(prep.baseline_accuracy(df, test).first()) == (0, pytest.approx(1 / 3))
