"""Evaluation tables from one scored frame (model, y, score, pred).

Everything is grouped by model, so all models are evaluated in one job. Tables of counts
come from one pass over the scored rows; curves come from counts per distinct score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostwin.operators.order import running_totals
from hostwin.session import pin

METRICS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
ERROR_RATES = ["fp_rate", "miss_rate"]


def ratio(n: Column, d: Column) -> Column:
    """``n / d``, 0 where undefined."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    """F1 of a precision and a recall."""
    return ratio(2 * p * r, p + r)


# Confusion counts

def confusion(df: DataFrame) -> DataFrame:
    """(model, y, pred, n). A table that has its counts already is returned as it is."""
    if "n" in df.columns:
        return df
    return df.groupBy("model", "y", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_pct(df: DataFrame) -> DataFrame:
    """Confusion counts and their percentage of the actual class."""
    row = Window.partitionBy("model", "y")
    return confusion(df).withColumn("pct", F.col("n") / F.sum("n").over(row) * 100)


def confusion_cells(df: DataFrame) -> DataFrame:
    """(model, tn, fp, fn, tp); NULL unless exactly two classes occur."""
    counts = confusion(df)
    labels = F.array_union(F.collect_set("y"), F.collect_set("pred"))
    ends = counts.groupBy("model").agg(labels.alias("labels"), F.collect_list(
        F.struct("y", "pred", "n")).alias("cells"))
    low, high = F.array_min("labels"), F.array_max("labels")

    def cell(y: Column, pred: Column) -> Column:
        hit = F.filter("cells", lambda c: (c["y"] == y) & (c["pred"] == pred))
        return F.when(F.size("labels") == 2, F.coalesce(F.get(hit, 0)["n"], F.lit(0)))

    return ends.select("model", cell(low, low).alias("tn"), cell(low, high).alias("fp"),
                       cell(high, low).alias("fn"), cell(high, high).alias("tp"))


def error_rates(df: DataFrame) -> DataFrame:
    """Confusion cells, false-positive rate and miss rate in percent; 0 where undefined."""
    return confusion_cells(df).select(
        "*", (ratio(F.col("fp"), F.col("fp") + F.col("tn")) * 100).alias("fp_rate"),
        (ratio(F.col("fn"), F.col("fn") + F.col("tp")) * 100).alias("miss_rate"))


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def binary_metrics(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1."""
    y, pred = F.col("y"), F.col("pred")
    tp = _n((y == 1) & (pred == 1))
    sums = confusion(df).groupBy("model").agg(
        ratio(_n(y == pred), F.sum("n")).alias("accuracy"),
        ratio(tp, _n(pred == 1)).alias("precision"), ratio(tp, _n(y == 1)).alias("recall"))
    return sums.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def per_class(df: DataFrame) -> DataFrame:
    """(model, class, precision, recall, f1, support) for each class that occurs."""
    # Each cell counts for its actual and for its predicted class.
    both = confusion(df).select("model", F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint")
                 .alias("guessed"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
                 .alias("hit")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hit")))).alias("c"))
    sums = both.select("model", "c.*").groupBy("model", "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "guessed", "hit")])
    return sums.select(
        "model", "class", ratio(F.col("hit"), F.col("guessed")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"), "support", "hit").withColumn(
        "f1", harmonic(F.col("precision"), F.col("recall")))


def weighted_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 averaged over classes by support."""
    def mean(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)

    return per_class(df).groupBy("model").agg(mean("precision"), mean("recall"), mean("f1"))


def balanced_accuracy(df: DataFrame) -> DataFrame:
    """Mean recall over the classes present in y."""
    present = per_class(df).filter(F.col("support") > 0)
    return present.groupBy("model").agg(F.avg("recall").alias("balanced_accuracy"))


def class_report(df: DataFrame) -> DataFrame:
    """Per-class precision, recall, F1 and support, and an accuracy row per model."""
    classes = per_class(df)
    overall = classes.groupBy("model").agg(
        F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
        ratio(F.sum("hit"), F.sum("support")).alias("f1"), F.sum("support").alias("support"))
    columns = ["model", "class", "precision", "recall", "f1", "support"]
    return classes.withColumn("class", F.col("class").cast("string")).select(*columns).unionByName(
        overall.withColumn("class", F.lit("accuracy")).select(*columns))


# Curves

def rank_scores(df: DataFrame, group: tuple[str, ...] = ("model",),
                positive: Column | None = None) -> DataFrame:
    """Positives and negatives per distinct score, with totals from the highest score down.

    Columns: group, score, pos, neg, pos_cum, neg_cum, pos_total, neg_total.
    """
    hit = (F.col("y") == 1) if positive is None else positive
    counts = df.filter(F.col("score").isNotNull()).groupBy(*group, "score").agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    return running_totals(counts, list(group), [F.desc("score")], ["pos", "neg"])


def _both_classes(value: Column) -> Column:
    return F.when((F.max("pos_total") > 0) & (F.max("neg_total") > 0), value)


def roc_auc(ranked: DataFrame, group: tuple[str, ...] = ("model",)) -> DataFrame:
    """Area under the ROC curve, ties at half; NULL if one class is missing."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    above = F.col("pos_cum") - pos
    pairs = F.max(F.col("pos_total").cast("double")) * F.max("neg_total")
    return ranked.groupBy(*group).agg(
        _both_classes(F.try_divide(F.sum(neg * (above + pos / 2)), pairs)).alias("roc_auc"))


def average_precision(ranked: DataFrame) -> DataFrame:
    """Sum over scores of the recall gained times the precision; NULL if one class is missing."""
    precision = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    area = F.try_divide(F.sum(F.col("pos") * precision), F.max("pos_total").cast("double"))
    return ranked.groupBy("model").agg(_both_classes(area).alias("pr_auc"))


def roc_auc_ovr(df: DataFrame) -> DataFrame:
    """One-vs-rest ROC-AUC weighted by class share.

    Input has one row per model, row and class: (model, class, y, score).
    """
    ranked = rank_scores(df, ("model", "class"), F.col("y") == F.col("class"))
    areas = ranked.groupBy("model", "class").agg(
        F.max("pos_total").alias("support")).join(
        roc_auc(ranked, ("model", "class")), ["model", "class"])
    return areas.groupBy("model").agg(
        (F.sum(F.col("roc_auc") * F.col("support")) / F.sum("support")).alias("roc_auc"))


def roc_curve(ranked: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """(model, threshold, fpr, tpr) from the origin to (1, 1).

    The origin has no threshold. ``drop_collinear`` leaves out points inside a straight line.
    """
    points = ranked
    if drop_collinear:
        # A point is inside a line if the next step goes the same way: look one score down.
        numbered = ranked.withColumn(
            "at", F.col("pos_cum") + F.col("neg_cum"))
        nxt = numbered.select(
            "model", (F.col("at") - F.col("pos") - F.col("neg")).alias("at"),
            F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
        same = (F.col("pos") == F.col("next_pos")) & (F.col("neg") == F.col("next_neg"))
        points = numbered.join(nxt, ["model", "at"], "left").filter(
            F.col("next_pos").isNull() | ~same | _is_first())
    curve = points.select(
        "model", F.col("score").alias("threshold"), _is_first().alias("first"),
        F.try_divide(F.col("neg_cum"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_cum"), F.col("pos_total")).alias("tpr"))
    return _with_end(curve, "fpr", "tpr", 0.0, 0.0)


def _with_end(curve: DataFrame, x: str, y: str, end_x: float, end_y: float) -> DataFrame:
    """Add the end of a curve that no score reaches, next to the first point."""
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(end_x).alias(x),
                   F.lit(end_y).alias(y))
    here = F.struct("threshold", x, y)
    both = F.explode(F.when(F.col("first"), F.array(end, here)).otherwise(F.array(here)))
    return curve.select("model", both.alias("p")).select("model", "p.*")


# True for the highest score of a model.
def _is_first() -> Column:
    return (F.col("pos_cum") == F.col("pos")) & (F.col("neg_cum") == F.col("neg"))


def pr_curve(ranked: DataFrame) -> DataFrame:
    """(model, threshold, precision, recall), and the closing point (1, 0)."""
    curve = ranked.select(
        "model", F.col("score").alias("threshold"), _is_first().alias("first"),
        (F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))).alias("precision"),
        F.try_divide(F.col("pos_cum"), F.col("pos_total")).alias("recall"))
    return _with_end(curve, "precision", "recall", 1.0, 0.0)


def threshold_sweep(df: DataFrame, steps: int = 100) -> DataFrame:
    """F1, precision and recall at the cut-offs 0, 1/steps, ..., 1.

    Each row is counted once, at the highest cut-off it reaches; the counts of all cut-offs
    are suffix sums over at most ``steps + 2`` rows per model.
    """
    score, step = F.col("score"), 1.0 / steps
    guess = F.floor(score * steps)
    reached = F.when(score >= (guess + 1) * step, guess + 1).when(
        score >= guess * step, guess).otherwise(guess - 1)
    counts = df.filter(score.isNotNull()).select(
        "model", F.greatest(F.least(reached, F.lit(steps)), F.lit(-1)).cast("int").alias("i"),
        F.col("y")).groupBy("model", "i").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    sums = _fill_grid(counts, "i", -1, steps, ["pos", "neg"])
    down = Window.partitionBy("model").orderBy(F.desc("i"))
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    total = F.sum("pos").over(Window.partitionBy("model"))
    return sums.select("model", "i", tp.alias("tp"), fp.alias("fp"), total.alias("total")).filter(
        "i >= 0").select(
        "model", (F.col("i") * F.lit(step)).alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("total")).alias("recall")).withColumn(
        "f1", harmonic(F.col("precision"), F.col("recall")))


def _fill_grid(counts: DataFrame, at: str, first: int, last: int, values: list[str],
               keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Counts with a row of zeros where a grid position has none; the grid is short."""
    cells = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.struct(at, F.struct(*values)))).alias("cells"))
    grid = cells.select(*keys, "cells", F.explode(F.sequence(F.lit(first), F.lit(last))).alias(at))
    return grid.select(*keys, at, *[
        F.coalesce(F.col("cells")[F.col(at)][v], F.lit(0)).alias(v)
        for v in values])


def score_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """(model, bin, lo, hi, n, density): equal bins between the lowest and highest score."""
    scored = df.filter(F.col("score").isNotNull())
    span = scored.groupBy("model").agg(F.min("score").alias("a"), F.max("score").alias("b"))
    half = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    span = span.select("model", (F.col("a") - half).alias("a"), (F.col("b") + half).alias("b"))
    a, b = F.col("a"), F.col("b")
    score = F.col("score")

    def edge(i: Column) -> Column:
        return F.when(i == bins, b).otherwise(a + i * ((b - a) / bins))

    guess = F.least(F.floor((score - a) / (b - a) * bins), F.lit(bins - 1))
    placed = F.when(score < edge(guess), guess - 1).when(
        (score >= edge(guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    counts = scored.join(span, "model").groupBy(
        "model", "a", "b", placed.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = _fill_grid(counts, "bin", 0, bins - 1, ["n"], ("model", "a", "b"))
    total = F.sum("n").over(Window.partitionBy("model"))
    at = F.col("bin")
    return full.select(
        "model", "bin", edge(at).alias("lo"), edge(at + 1).alias("hi"), "n",
        (F.col("n") / (total * (edge(at + 1) - edge(at)))).alias("density"))


# Threshold tuning

def tune_threshold(ranked: DataFrame, recall: float = 0.80, rule: str = "first",
                   max_share: float = 0.9) -> DataFrame:
    """(model, threshold, share_positive, threshold_tuned): the cut-off each model should use.

    ``max_threshold`` takes the highest cut-off that still has the target recall. ``first``
    takes the lowest cut-off whose successor has it; as recall falls with the cut-off, that
    calls every row positive. A cut-off that calls ``max_share`` or more rows positive is
    rejected, and the model keeps its own predictions.
    """
    score, reach = F.col("score"), F.try_divide(F.col("pos_cum"), F.col("pos_total"))
    if rule == "max_threshold":
        best = F.max(F.when(reach >= recall, score))
        called = F.min(F.when(reach >= recall, F.col("pos_cum") + F.col("neg_cum")))
    elif rule == "first":
        after = F.try_divide(F.col("pos_cum") - F.col("pos"), F.col("pos_total"))
        best = F.min(F.when(after >= recall, score))
        called = F.max(F.when(after >= recall, F.col("pos_cum") + F.col("neg_cum")))
    else:
        raise ValueError(f"unknown rule '{rule}'")
    found = ranked.groupBy("model").agg(
        best.alias("threshold"),
        (called / F.max(F.col("pos_total") + F.col("neg_total"))).alias("share_positive"))
    return found.withColumn("threshold_tuned",
                            F.coalesce(F.col("share_positive") < max_share, F.lit(False)))


def percent_positive(df: DataFrame, threshold: float) -> DataFrame:
    """Share of the rows of each model that reach a cut-off."""
    return df.filter(F.col("score").isNotNull()).groupBy("model").agg(
        F.avg((F.col("score") >= threshold).cast("double")).alias("share_positive"))


def apply_tuning(df: DataFrame, tuned: DataFrame) -> DataFrame:
    """Replace predictions of tuned models by those at their cut-off; adds threshold_tuned."""
    cut = tuned.select("model", "threshold", "threshold_tuned")
    joined = df.join(cut, "model", "left")
    use = F.coalesce("threshold_tuned", F.lit(False))
    return joined.withColumn("pred", F.when(
        use, (F.col("score") >= F.col("threshold")).cast("int")).otherwise(F.col("pred"))
    ).withColumn("threshold_tuned", use).select(*df.columns, "threshold_tuned")


# Model comparison

def compare_classes(df: DataFrame, by_class: DataFrame | None = None) -> DataFrame:
    """The headline metrics of each model for any number of classes.

    Precision, recall and F1 are weighted by class support. ``by_class`` has the score of each
    row for each class (model, class, y, score) and gives the one-vs-rest ROC-AUC; without it,
    and for the PR-AUC, which is one of two classes, the area is NULL.
    """
    classes = per_class(df)
    tables = [weighted_metrics(df), balanced_accuracy(df), classes.groupBy("model").agg(
        ratio(F.sum("hit"), F.sum("support")).alias("accuracy"))]
    if by_class is not None:
        tables.append(roc_auc_ovr(by_class))
    joined = reduce(lambda a, b: a.join(b, "model", "left"), tables)
    missing = [m for m in METRICS if m not in joined.columns]
    return joined.withColumns({m: F.lit(None).cast("double") for m in missing}).select("model", *METRICS)


def compare(df: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """The seven headline metrics of each model on two classes; see :func:`compare_classes`."""
    ranked = rank_scores(df) if ranked is None else ranked
    tables = [binary_metrics(df), balanced_accuracy(df), roc_auc(ranked), average_precision(ranked)]
    joined = reduce(lambda a, b: a.join(b, "model", "left"), tables)
    return joined.select("model", *METRICS)


def best_models(comparison: DataFrame, errors: DataFrame,
                order: list[str] | None = None) -> DataFrame:
    """(metric, model, score): best model per metric and lowest error rates.

    Ties go to the model that comes first in ``order`` (by name if not given).
    """
    def long(df: DataFrame, names: list[str], sign: int) -> DataFrame:
        return df.unpivot(["model"], names, "metric", "score").withColumn("sign", F.lit(sign))

    every = long(comparison, METRICS, 1).unionByName(long(errors, ERROR_RATES, -1)).filter(
        F.col("score").isNotNull())
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model")) if order else F.lit(0)
    best = Window.partitionBy("metric").orderBy(
        F.desc(F.col("score") * F.col("sign")), place, "model")
    return every.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select(
        "metric", "model", "score")


def top_features(importances: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most important features of each model."""
    best = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return importances.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def report_tables(df: DataFrame, dataset: str, order: list[str] | None = None,
                  recall: float = 0.80, rule: str = "first",
                  tune_on: DataFrame | None = None) -> dict[str, DataFrame]:
    """All evaluation tables of one dataset, each with a ``dataset`` column.

    Predictions are tuned first, as the metrics are those of the tuned predictions. The
    cut-offs come from the scored frame ``tune_on``, or from ``df`` itself if not given.
    """
    ranked = pin(rank_scores(df))
    basis = ranked if tune_on is None else rank_scores(tune_on)
    tuning = pin(tune_threshold(basis, recall, rule))
    # One pass counts the final predictions; the tables below come from the counts.
    final = pin(confusion(apply_tuning(df, tuning)))
    comparison, errors = compare(final, ranked), error_rates(final)
    tables = {
        "comparison": comparison, "errors": errors, "tuning": tuning,
        "best_models": best_models(comparison, errors, order),
        "confusion": confusion_pct(final), "class_report": class_report(final),
        "roc_curve": roc_curve(ranked), "pr_curve": pr_curve(ranked),
        "threshold_sweep": threshold_sweep(df), "score_histogram": score_histogram(df),
    }
    return {n: t.select(F.lit(dataset).alias("dataset"), "*") for n, t in tables.items()}


def class_tables(df: DataFrame, by_class: DataFrame, dataset: str) -> dict[str, DataFrame]:
    """The evaluation tables of one dataset with three or more classes, each with a ``dataset`` column."""
    final = pin(confusion(df))
    tables = {"comparison": compare_classes(final, by_class), "confusion": confusion_pct(final),
              "class_report": class_report(final)}
    return {n: t.select(F.lit(dataset).alias("dataset"), "*") for n, t in tables.items()}
