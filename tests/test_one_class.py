"""Training rows of which most, or all, are of one class."""

import pytest
from pyspark.sql import functions as F

from hostwin.operators import models, prep
from hostwin.operators.iforest import share_cut

SMALL = models.Settings(trees=3, depth=3, boost_depth=2)


def rows_with(spark, positive):
    return spark.range(300).select(
        F.col("id").alias("row_id"), (F.col("id") % 17).cast("double").alias("a"),
        (F.col("id") % 5).cast("double").alias("b"), F.expr(positive).cast("int").alias("label"))


def prepared(spark, positive, test=None):
    done = prep.prepare(rows_with(spark, positive).filter("row_id < 200"),
                        rows_with(spark, test or positive).filter("row_id >= 200"), keep=["row_id"])
    done.train, done.test = done.train.cache(), done.test.cache()
    return done


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "boolean", "decimal(3,0)"])
@pytest.mark.parametrize("value", [0, 1])
def test_zero_and_one_stand_for_themselves(spark, kind, value):
    df = spark.range(3).select(F.lit(value).cast(kind).alias("label"))
    codes = prep.label_codes(df, "label")
    assert {r.y for r in prep.encode_labels(df, "label", codes).collect()} == {value}
    assert prep.encode_labels(df.select((1 - F.lit(value)).cast(kind).alias("label")), "label", codes).first().y == 1 - value


def test_other_labels_are_numbered(spark):
    for labels, kind in (([2], "int"), ([1, 2], "int"), (["1"], "string")):
        codes = prep.label_codes(spark.createDataFrame([(v,) for v in labels], f"label {kind}"), "label")
        assert [(r["class"], r.code) for r in codes.orderBy("code").collect()] == [(v, i) for i, v in enumerate(labels)]


@pytest.mark.parametrize("value", [0, 1])
def test_one_class_is_always_answered(spark, value):
    done = prepared(spark, str(value), "id % 2")
    fitted, scored = models.train_and_score(done, "row_id", settings=SMALL)
    found = {r.model: r for r in scored.groupBy("model").agg(
        F.count("*").alias("n"), F.collect_set("pred").alias("preds"), F.sum("y").alias("positives"),
        F.min("score").alias("low"), F.max("score").alias("high")).collect()}
    assert list(fitted) == models.MODEL_NAMES and set(found) == set(fitted)
    assert all(r.n == 100 and r.positives == 50 for r in found.values())
    for name in models.MODEL_NAMES[:5]:
        assert found[name].preds == [value], name
    for name in models.MODEL_NAMES[:4]:
        assert abs(found[name].low - value) < 0.4 and abs(found[name].high - value) < 0.4, name
    top = models.importances(spark, fitted, done.features)
    assert top.count() == 10 and top.filter("coefficient is not null and importance > 0").isEmpty()


def test_mostly_positive_rows(spark):
    done = prepared(spark, "id % 10 > 1")
    _, scored = models.train_and_score(done, "row_id", ["IsolationForest"], SMALL)
    assert {r.pred for r in scored.select("pred").distinct().collect()} == {0, 1}
    scores = spark.range(100).select(F.col("id").cast("double").alias("anomaly"))
    for share, above in ((0.0, 0), (0.25, 25), (0.8, 80)):
        assert scores.filter(F.col("anomaly") > share_cut(scores, share)).count() == above


def test_classes_that_are_balanced_already(spark):
    done = prepared(spark, "id % 2")
    forests = [models.fit_rf_smote(done.train, done.features, "row_id", SMALL),
               models.fit_balanced_rf(done.train, done.features, "row_id", SMALL)]
    assert [f.getNumTrees for f in forests] == [3, 3]


def test_few_rows_of_a_class(spark):
    """Trees whose bag has no row of the rare class know of it all the same."""
    done = prepared(spark, "id in (3, 150)", "id % 2")
    settings = models.Settings(trees=12, depth=3)
    forests = [models.fit_rf_smote(done.train, done.features, "row_id", settings),
               models.fit_balanced_rf(done.train, done.features, "row_id", settings)]
    assert all(t.numClasses == 2 for f in forests for t in f.trees)
