from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostwin.functions.scalars import null_tokens
from hostwin.operators import evaluate, models, prep
from hostwin.operators.iforest import (
    anomaly_cut, average_path, fit_iforest, predict_iforest, sampled_rows, score_iforest)
from hostwin.plans import catalog
from hostwin.plans.flagship import Study, run_study
from hostwin.sources import fixtures

SMALL = models.Settings(trees=6, depth=6, boost_depth=3)


@pytest.fixture(scope="module")
def prepared(spark):
    """A planted signal: positives lie further out in two of three features."""
    rng = np.random.default_rng(0)
    y = (rng.random(900) < 0.12).astype(int)
    x = rng.normal(size=(900, 3)) + np.outer(y, [2.0, -1.5, 0.0])
    rows = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id int, a double, b double, c double, label int")
    done = prep.prepare(df.filter("row_id < 600"), df.filter("row_id >= 600"), keep=["row_id"])
    done.train, done.test = done.train.cache(), done.test.cache()
    return done


@pytest.fixture(scope="module")
def outcome(prepared):
    fitted, scored = models.train_and_score(prepared, "row_id", settings=SMALL)
    return fitted, scored.cache()


def test_every_model_scores_every_row(outcome):
    fitted, scored = outcome
    assert list(fitted) == models.MODEL_NAMES
    counts = {r.model: r["count"] for r in scored.groupBy("model").count().collect()}
    assert counts == dict.fromkeys(models.MODEL_NAMES, 300)
    without = {r.model for r in scored.filter("score is null").select("model").distinct().collect()}
    assert without == {"SGD SVM", "IsolationForest"}


def test_models_find_the_signal(outcome):
    rows = {r.model: r for r in evaluate.compare(outcome[1]).collect()}
    for name in models.MODEL_NAMES[:4]:
        assert rows[name].roc_auc > 0.85, name
    assert rows["SGD SVM"].balanced_accuracy > 0.75


def test_logreg_is_the_penalised_optimum(prepared):
    model = models.fit_logreg(prepared.train, prepared.features)
    pdf = prepared.train.toPandas()
    x = np.column_stack([pdf[prepared.features].to_numpy(), np.ones(len(pdf))])
    y = pdf["y"].to_numpy()
    w = len(y) / (2 * np.bincount(y))[y]
    penalty = np.diag([1.0, 1.0, 1.0, 0.0])
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (p - y)) + penalty @ beta
        beta -= np.linalg.solve((x.T * (w * p * (1 - p))) @ x + penalty, grad)
    got = [*model.coefficients.toArray(), model.intercept]
    assert got == pytest.approx(beta.tolist(), abs=2e-3)


def test_importances(spark, prepared, outcome):
    imp = models.importances(spark, outcome[0], prepared.features)
    assert {r.model for r in imp.select("model").distinct().collect()} == set(
        models.MODEL_NAMES) - {"IsolationForest"}
    top = evaluate.top_features(imp, 1).collect()
    assert all(r.feature in ("a", "b") for r in top)
    linear = imp.filter("model = 'Logistic Regression'").collect()
    assert all(r.importance == abs(r.coefficient) for r in linear)


def test_isolation_forest_flags_the_contaminated_share(prepared):
    forest = fit_iforest(prepared.train, prepared.features, "row_id", 30)
    scored = score_iforest(prepared.train, forest)
    cut = anomaly_cut(scored, 0.1)
    flagged = predict_iforest(scored, cut).filter("outlier = -1").count()
    assert flagged == 60
    assert scored.filter("anomaly <= 0 or anomaly >= 1").count() == 0
    again = score_iforest(prepared.train.repartition(7), fit_iforest(
        prepared.train.repartition(3), prepared.features, "row_id", 30))
    assert again.select("row_id", "anomaly").exceptAll(scored.select("row_id", "anomaly")).count() == 0
    with pytest.raises(ValueError, match="contamination"):
        anomaly_cut(scored, 0.6)


@pytest.mark.parametrize("n", [50, 900, 5000])
def test_tree_samples(spark, n):
    size = min(256, n)
    rows = sampled_rows(spark.range(n), "id", n, 4, size, 1).groupBy("tree").agg(
        F.count_distinct("id").alias("u"), F.count(F.lit(1)).alias("n"), F.collect_set("id").alias("ids"))
    rows = rows.collect()
    assert [(r.u, r.n) for r in rows] == [(size, size)] * 4
    # Trees draw from the whole table, each for itself.
    if n > 512:
        assert all(max(r.ids) > n * 0.9 and min(r.ids) < n * 0.1 for r in rows)
        assert len(set(rows[0].ids) & set(rows[1].ids)) < size


def test_average_path():
    assert average_path([1, 2]).tolist() == [0.0, 1.0]
    assert float(average_path(256)) == pytest.approx(10.2448, abs=1e-3)


@pytest.fixture(scope="module")
def three(spark):
    """Three classes, the rarest with a twentieth of the rows."""
    rng = np.random.default_rng(1)
    y = rng.choice(3, 900, p=[0.65, 0.3, 0.05])
    x = rng.normal(size=(900, 3)) + np.array([[0, 0, 0], [2.5, 0, 0], [0, 3.0, 0]])[y]
    rows = [(i, *map(float, r), ["fine", "odd", "worst"][c]) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id int, a double, b double, c double, label string")
    done = prep.prepare(df.filter("row_id < 600"), df.filter("row_id >= 600"), keep=["row_id"])
    done.train, done.test = done.train.cache(), done.test.cache()
    return done


def test_three_classes(spark, three):
    fitted, scored = models.train_and_score(three, "row_id", settings=SMALL)
    assert list(fitted) == models.MODEL_NAMES[:5]
    scored = scored.cache()
    sums = scored.filter("scores is not null").select(
        F.size("scores").alias("n"), F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("s"),
        (F.get("scores", F.col("pred")) == F.col("score")).alias("own")).collect()
    assert len(sums) == 4 * 300 and all(r.n == 3 and abs(r.s - 1) < 1e-9 and r.own for r in sums)
    tables = evaluate.class_tables(scored, models.by_class(scored), "x")
    rows = {r.model: r for r in tables["comparison"].collect()}
    assert set(rows) == set(fitted) and all(r.balanced_accuracy > 0.7 for r in rows.values())
    # The area is that of pairs of rows, one class against the others, weighted by support.
    frame = scored.filter("model = 'Logistic Regression'").toPandas()
    want = 0.0
    for c in range(3):
        s, hit = np.array([v[c] for v in frame["scores"]]), (frame["y"] == c).to_numpy()
        above = (s[hit][:, None] > s[~hit]).mean() + 0.5 * (s[hit][:, None] == s[~hit]).mean()
        want += above * hit.sum() / len(frame)
    assert rows["Logistic Regression"].roc_auc == pytest.approx(want, abs=1e-12) and want > 0.9
    assert rows["SGD SVM"].roc_auc is None
    imp = models.importances(spark, fitted, three.features)
    assert imp.count() == 15 and imp.filter("feature = 'c'").agg(F.max("importance")).first()[0] < imp.agg(
        F.max("importance")).first()[0]


def test_a_bag_for_each_tree(prepared):
    bags = models.bag_of_each_tree(prepared.train, "row_id", 40, 1)
    sums = bags.select("y", F.posexplode("bags").alias("tree", "n")).groupBy("tree").pivot("y", [0, 1]).agg(
        F.sum("n")).collect()
    assert len(sums) == 40 and np.mean([r["1"] / r["0"] for r in sums]) == pytest.approx(0.5, rel=0.1)
    assert len({(r["0"], r["1"]) for r in sums}) > 20
    forest = models.fit_balanced_rf(prepared.train, prepared.features, "row_id", SMALL)
    assert forest.getNumTrees == SMALL.trees == len(forest.trees)
    assert len({t.toDebugString for t in forest.trees}) == SMALL.trees


def test_the_boosted_query_fits_every_round(spark, sf, monkeypatch):
    seen = []

    def fit(*args):
        seen.append(models.fit_gbt(*args))
        return seen[-1]

    monkeypatch.setattr(catalog, "fit_gbt", fit)
    assert catalog.QUERIES["fit_boosted"](spark, sf).first().n_rows > 0
    assert len(seen) == 1 and seen[0].getNumTrees == models.TREES == 200
    assert max(t.depth for t in seen[0].trees) == models.Settings().boost_depth == 5


def test_fits_read_training_rows_that_are_dealt_evenly(spark, prepared, monkeypatch):
    seen = []

    def fit(name, prep, train, key, settings):
        seen.append([r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()])
        return None, models.scored_rows(name, prep.test, key, None, F.lit(0))

    monkeypatch.setattr(models, "_binary", fit)
    one = replace(prepared, train=prepared.train.coalesce(1))
    models.train_and_score(one, "row_id", [models.MODEL_NAMES[0]], SMALL)
    cores = spark.sparkContext.defaultParallelism
    assert sum(seen[0]) == 600 and len(seen[0]) == cores > 1 and max(seen[0]) < 2 * 600 / cores
    assert models.dealt(one.train, "row_id", 20).rdd.getNumPartitions() == cores * -(-30 // cores)


def test_fits_run_at_the_same_time(spark):
    import threading
    gate = threading.Barrier(3, timeout=60)
    seen = models.together(spark, {i: lambda i=i: (gate.wait(), spark.range(i + 1).count())[1] for i in range(3)}, 3)
    assert seen == {0: 1, 1: 2, 2: 3}
    with pytest.raises(ZeroDivisionError):
        models.together(spark, {0: lambda: 1 / 0}, 3)


def test_whole_study(spark, sf, tmp_path):
    b = fixtures.base(spark, sf)
    logs = {k: null_tokens(fixtures.view_of(b, k)) for k in fixtures.LOGS}
    study = Study(width=21_600, settings=SMALL, tuning_rule="max_threshold", balance="context",
                  validation_days=[20, 21, 22], models=["Logistic Regression"])
    written = run_study(logs, str(tmp_path), study)
    assert len(written) == 30
    report = spark.read.parquet(str(tmp_path / "report" / "comparison"))
    assert {(r.dataset, r.model) for r in report.collect()} == {
        (d, m) for d in ("EDR", "XDR") for m in study.models}
    tables = [spark.read.parquet(str(tmp_path / "tables" / d)) for d in ("EDR", "XDR")]
    assert tables[0].count() == tables[1].count() > 0
    cells = spark.read.parquet(str(tmp_path / "report" / "errors")).first()
    tested = tables[0].filter("split = 'test'").count()
    assert cells.tn + cells.fp + cells.fn + cells.tp == tested
