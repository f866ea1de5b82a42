"""Metrics against direct computations."""

import math

import numpy as np
import pytest

from hostwin.operators import evaluate as ev

SCHEMA = "model string, y int, score double, pred int"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    y = (rng.random(700) < 0.3).astype(int)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    return y, score


@pytest.fixture(scope="module")
def scored(spark, data):
    y, score = data
    rows = [("m", int(a), float(s), int(s >= 0.5)) for a, s in zip(y, score)]
    rows += [("none", int(a), None, int(a)) for a in y]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def ranked(scored):
    return ev.rank_scores(scored)


def one(df, model="m"):
    return df.filter(f"model = '{model}'").first()


def test_roc_auc_counts_pairs(ranked, data):
    y, s = data
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert one(ev.roc_auc(ranked)).roc_auc == pytest.approx(wins / len(pos) / len(neg))


def points(y, s):
    cuts = np.unique(s)[::-1]
    return [(c, (y[s >= c] == 1).sum(), (y[s >= c] == 0).sum()) for c in cuts]


def test_average_precision(ranked, data):
    y, s = data
    last, area = 0.0, 0.0
    for _, tp, fp in points(y, s):
        area += (tp / y.sum() - last) * tp / (tp + fp)
        last = tp / y.sum()
    assert one(ev.average_precision(ranked)).pr_auc == pytest.approx(area)


def test_curves(ranked, data):
    y, s = data
    want = points(y, s)
    pr = {r.threshold: (r.precision, r.recall) for r in ev.pr_curve(ranked).collect()}
    assert pr.pop(None) == (1.0, 0.0)
    assert {c: p for c, (p, _) in pr.items()} == pytest.approx(
        {c: tp / (tp + fp) for c, tp, fp in want})
    assert {c: r for c, (_, r) in pr.items()} == pytest.approx(
        {c: tp / y.sum() for c, tp, _ in want})
    full = {(r.fpr, r.tpr) for r in ev.roc_curve(ranked, drop_collinear=False).collect()}
    assert len(full) == len(want) + 1 and {(0.0, 0.0), (1.0, 1.0)} <= full
    kept = sorted((r.fpr, r.tpr) for r in ev.roc_curve(ranked).collect())
    assert {(0.0, 0.0), (1.0, 1.0)} <= set(kept) <= full
    # Leaving out points inside a line keeps the area.
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(kept, kept[1:]))
    assert area == pytest.approx(one(ev.roc_auc(ranked)).roc_auc)


def test_threshold_sweep(scored, data):
    y, s = data
    rows = {round(r.threshold * 100): r for r in ev.threshold_sweep(scored).collect()}
    assert len(rows) == 101
    for i, t in enumerate(np.linspace(0, 1, 101)):
        hit = s >= t
        tp, called = (hit & (y == 1)).sum(), hit.sum()
        assert rows[i].precision == pytest.approx(tp / called if called else 0.0)
        assert rows[i].recall == pytest.approx(tp / y.sum())


def test_histogram_equals_numpy(scored, data):
    n, edges = np.histogram(data[1], bins=30)
    density, _ = np.histogram(data[1], bins=30, density=True)
    rows = ev.score_histogram(scored).orderBy("bin").collect()
    assert [r.n for r in rows] == n.tolist()
    assert [r.density for r in rows] == pytest.approx(density.tolist())
    assert [r.lo for r in rows] + [rows[-1].hi] == pytest.approx(edges.tolist())


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("m", 1, 0.3, 1)] * 4, SCHEMA)
    n, _ = np.histogram([0.3] * 4, bins=30)
    assert [r.n for r in ev.score_histogram(df).orderBy("bin").collect()] == n.tolist()


def test_tuning_rules(scored, ranked, data):
    y, s = data
    first = one(ev.tune_threshold(ranked, rule="first"))
    assert (first.threshold, first.share_positive, first.threshold_tuned) == (s.min(), 1.0, False)
    tuned = ev.tune_threshold(ranked, rule="max_threshold")
    best = max(c for c, tp, _ in points(y, s) if tp / y.sum() >= 0.8)
    row = one(tuned)
    assert row.threshold == best and row.threshold_tuned
    assert row.share_positive == pytest.approx((s >= best).mean())
    final = ev.apply_tuning(scored, tuned)
    assert final.count() == scored.count()
    got = final.filter("model = 'm'").toPandas()
    assert (got["pred"] == (got["score"] >= best)).all() and got["threshold_tuned"].all()
    assert not final.filter("model = 'none' and (pred <> y or threshold_tuned)").count()
    with pytest.raises(ValueError, match="unknown rule"):
        ev.tune_threshold(ranked, rule="x")


def test_one_class(spark):
    df = spark.createDataFrame([("m", 0, 0.1, 0), ("m", 0, 0.2, 0)], SCHEMA)
    row = ev.error_rates(df).first()
    assert tuple(row)[1:] == (None, None, None, None, 0.0, 0.0)
    ranked = ev.rank_scores(df)
    assert ev.roc_auc(ranked).first().roc_auc is None
    assert ev.average_precision(ranked).first().pr_auc is None
    assert tuple(ev.binary_metrics(df).first())[1:] == (1.0, 0.0, 0.0, 0.0)


def test_best_models_ties_follow_the_order(spark):
    df = spark.createDataFrame(
        [(m, y, 0.5, 1) for m in ("a", "b") for y in (0, 1)], SCHEMA)
    ranked = ev.rank_scores(df)
    rows = ev.best_models(ev.compare(df, ranked), ev.error_rates(df), ["b", "a"]).collect()
    assert len(rows) == 9 and {r.model for r in rows} == {"b"}


def test_report_has_every_section(scored):
    tables = ev.report_tables(scored, "EDR", ["m", "none"])
    assert len(tables) == 10
    for table in tables.values():
        row = table.first()
        assert row.dataset == "EDR"
    assert not math.isnan(one(tables["comparison"]).roc_auc)
