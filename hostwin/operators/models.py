"""Training with Spark ML: six detectors on prepared data, one scored frame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass
from functools import partial, reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, RandomForestClassificationModel,
    RandomForestClassifier)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwin.functions.scalars import anomaly_to_label
from hostwin.operators.iforest import (
    fit_iforest, predict_iforest, score_iforest, share_cut)
from hostwin.operators.prep import Prepared
from hostwin.operators.sampling import class_counts, poisson_weight
from hostwin.operators.smote import smote
from hostwin.session import pin

# The models by name, in report order.
MODEL_NAMES = ["Logistic Regression", "Random Forest (SMOTE)", "LightGBM", "Balanced RF",
               "SGD SVM", "IsolationForest"]
SEED = 42
TREES = 200
RATIO = 0.5
NEIGHBOURS = 5


@dataclass
class Settings:
    """Sizes of the ensembles. The defaults are for a cluster; tests use less."""

    trees: int = TREES
    depth: int = 20
    bins: int = 64
    boost_depth: int = 5
    seed: int = SEED
    neighbours: str = "exact"  # or "projected" or "graph", see nearest_neighbours
    at_once: int = 6  # fits that run at the same time


def together(spark: SparkSession, jobs: dict[Any, Callable[[], Any]], at_once: int) -> dict[Any, Any]:
    """The results of several fits, at most ``at_once`` at the same time, by their names.

    Each runs in a thread with the properties of the caller and in a scheduler pool of its own, so that
    under fair scheduling a long fit does not hold up the others. The first error is raised.
    """
    def run(name, job):
        context = copy_context()

        def pooled():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
            return job()

        return inheritable_thread_target(spark)(lambda: context.run(pooled))

    with ThreadPoolExecutor(max(1, min(at_once, len(jobs)))) as pool:
        running = {name: pool.submit(run(name, job)) for name, job in jobs.items()}
        return {name: future.result() for name, future in running.items()}


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Add the feature vector."""
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def balanced_weight(counts: list[tuple], label: str = "y") -> Column:
    """n / (classes * rows of the class), as a column."""
    n = sum(c for _, c in counts)
    weight = F.lit(None).cast("double")
    for value, rows in counts:
        weight = F.when(F.col(label) == value, n / (len(counts) * rows)).otherwise(weight)
    return weight


def with_classes(rows: DataFrame, counts: list[tuple]) -> DataFrame:
    """``rows`` whose label names the number of classes, two at least, also where rows of some are absent."""
    n = max(2, 1 + max(c for c, _ in counts))
    return rows.withMetadata("y", {"ml_attr": {"name": "y", "type": "nominal", "num_vals": n}})


def fit_logreg(train: DataFrame, features: list[str], strength: float = 1.0) -> Any:
    """Logistic regression with balanced class weights.

    Spark minimises the mean loss, so a penalty of 1 / (strength * n) gives the same optimum
    as a summed loss with weight ``strength``; balanced weights add up to n.
    """
    counts = class_counts(train, "y")
    n = sum(c for _, c in counts)
    rows = assemble(train, features).withColumn("w", balanced_weight(counts))
    return LogisticRegression(
        labelCol="y", weightCol="w", regParam=1.0 / (strength * n), elasticNetParam=0.0,
        standardization=False, maxIter=1000, tol=1e-4).fit(rows)


def fit_linear_svm(train: DataFrame, features: list[str], alpha: float = 1e-4,
                   rounds: int = 1000) -> Any:
    """Linear SVM with hinge loss and balanced class weights; gives no probabilities.

    Spark's LinearSVC, which stops early once the loss settles; each round is a pass over the data. Rows of
    a single class give a constant, which Spark does not fit.
    """
    counts = class_counts(train, "y")
    if len(counts) == 1:
        return constant_svm(train.sparkSession, len(features), counts[0][0])
    rows = assemble(train, features).withColumn("w", balanced_weight(counts))
    return LinearSVC(labelCol="y", weightCol="w", regParam=alpha, standardization=False,
                     maxIter=rounds, tol=1e-4).fit(rows)


def constant_svm(spark: SparkSession, width: int, label: int) -> LinearSVCModel:
    """The linear SVM of a single class, 0 or 1: no weights, a margin of 1, no loss."""
    zeros = _py2java(spark.sparkContext, Vectors.dense([0.0] * width))
    kind = spark.sparkContext._jvm.org.apache.spark.ml.classification.LinearSVCModel
    made = LinearSVCModel(kind(f"constant-{uuid.uuid4().hex}", zeros, 1.0 if label else -1.0))
    return made.setFeaturesCol("features")


def fit_rf_smote(train: DataFrame, features: list[str], key: str,
                 settings: Settings = Settings()) -> Any:
    """Random forest on the training rows plus synthetic rows of the rarer classes.

    Each class below half of the largest is filled up to that half, unless it has too few rows for neighbours.
    Where no class is, the forest is that of the training rows.
    """
    counts = class_counts(train, "y")
    major, many = counts[-1]
    wanted = max(1, int(RATIO * many))
    poor = [(c, n) for c, n in counts[:-1] if NEIGHBOURS < n < wanted]
    rows = train.select("y", *features)
    for value, _ in poor:
        pair = train.filter(F.col("y").isin(value, major))
        # Stored, as every level of the trees reads the rows again; their number is known.
        rows = rows.unionByName(pin(smote(pair, features, key, "y", RATIO, NEIGHBOURS, settings.seed,
                                          method=settings.neighbours).select("y", *features)))
    filled = [(c, max(n, wanted) if (c, n) in poor else n) for c, n in counts]
    weighted = with_classes(rows.withColumn("w", balanced_weight(filled)), counts)
    return _forest(settings.trees, settings, settings.seed).fit(assemble(weighted, features))


def _forest(trees: int, settings: Settings, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol="y", weightCol="w", numTrees=trees, maxDepth=settings.depth,
        maxBins=settings.bins, minInstancesPerNode=1, featureSubsetStrategy="sqrt", seed=seed)


def fit_gbt(train: DataFrame, features: list[str], settings: Settings = Settings()) -> Any:
    """Gradient-boosted trees with the positive class weighted by negatives / positives, if there are both.

    Spark's GBTClassifier, which grows trees level by level; it stands where the report says LightGBM.
    """
    counts = dict(class_counts(train, "y"))
    if not set(counts) <= {0, 1}:
        raise ValueError(f"y has the classes {sorted(counts)}, but only 0 and 1 are possible")
    ratio = counts[0] / counts[1] if len(counts) == 2 else 1.0
    weight = F.when(F.col("y") == 1, ratio).otherwise(1.0)
    rows = assemble(train.withColumn("w", weight), features)
    return GBTClassifier(
        labelCol="y", weightCol="w", maxIter=settings.trees, stepSize=0.1, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", maxDepth=settings.boost_depth, maxBins=settings.bins,
        minInstancesPerNode=1, seed=settings.seed).fit(rows)


@dataclass
class OneVsRest:
    """A model per class against all others; ``score`` is the probability or margin of each."""

    models: list
    column: str

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        for i, model in enumerate(self.models):
            out = model.transform(df)
            df = out.select(*kept, *[f"_s{j}" for j in range(i)],
                            vector_to_array(self.column)[1].alias(f"_s{i}"))
        scores = F.array(*[f"_s{i}" for i in range(len(self.models))])
        return df.select(*kept, scores.alias("scores")).withColumn(
            "pred", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))


def one_vs_rest(train: DataFrame, n_classes: int, fit: Callable[[DataFrame], Any], column: str,
                at_once: int) -> OneVsRest:
    """Fit ``fit`` on the rows of each class (y = 1) against all others (y = 0), several at a time."""
    jobs = {c: partial(lambda c: fit(train.withColumn("y", (F.col("y") == c).cast("int"))), c)
            for c in range(n_classes)}
    fitted = together(train.sparkSession, jobs, at_once)
    return OneVsRest([fitted[c] for c in range(n_classes)], column)


def bag_of_each_tree(train: DataFrame, key: str, trees: int, seed: int) -> DataFrame:
    """``train`` with ``bags``: how often each tree's balanced bag has the row, stored.

    Rows of the rarest class are drawn once on average; those of any other so that the rarest and the
    other are in the ratio RATIO. One with fewer rows than that is drawn once too. A draw depends only on the
    seed, the tree and the row key. Rows in no bag are left out.
    """
    counts = class_counts(train, "y")
    few = counts[0][1]
    rate = {c: min(1.0, few / RATIO / n) if i else 1.0 for i, (c, n) in enumerate(counts)}
    tree = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: reduce(
        lambda other, c: F.when(F.col("y") == c, poisson_weight(rate[c], seed, t, F.col(key))).otherwise(other),
        rate, F.lit(0)).cast("short"))
    # A tree may see a single class; the label still names all of them.
    return pin(with_classes(train, counts).withColumn("bags", tree).filter(F.array_max("bags") > 0))


def fit_balanced_rf(train: DataFrame, features: list[str], key: str,
                    settings: Settings = Settings()) -> Any:
    """A forest of trees that each have a balanced bag of their own.

    All bags are drawn in one pass and stored with the rows; trees are fitted from them several at
    a time and then make one forest.
    """
    rows = bag_of_each_tree(assemble(train, features).select("y", "features", key), key, settings.trees, settings.seed)
    spark = train.sparkSession

    def grow(tree: int):
        drawn = rows.withColumn("w", F.get("bags", tree).cast("double")).filter(F.col("w") > 0)
        return _forest(1, settings, settings.seed + tree).fit(drawn)

    grown = together(spark, {t: partial(grow, t) for t in range(settings.trees)}, settings.at_once)
    return joined_forest(spark, [grown[t] for t in range(settings.trees)])


def joined_forest(spark: SparkSession, forests: list) -> RandomForestClassificationModel:
    """One forest of the trees of several; its probability is the mean over trees."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    found = [t for f in forests for t in f._java_obj.trees()]
    kind = jvm.org.apache.spark.ml.classification
    trees = gateway.new_array(kind.DecisionTreeClassificationModel, len(found))
    for i, tree in enumerate(found):
        trees[i] = tree
    first = forests[0]
    made = kind.RandomForestClassificationModel(f"{first.uid}-joined", trees, first.numFeatures,
                                                max(f.numClasses for f in forests))
    made.set(made.numTrees(), len(found))
    return RandomForestClassificationModel(made)


def scored_rows(name: str, df: DataFrame, key: str, score: Column | None,
                pred: Column) -> DataFrame:
    """Predictions in the common shape (model, row_id, y, score, pred)."""
    value = F.lit(None).cast("double") if score is None else score.cast("double")
    return df.select(F.lit(name).alias("model"), F.col(key).alias("row_id"), "y",
                     value.alias("score"), pred.cast("int").alias("pred"))


def class_rows(name: str, df: DataFrame, key: str, scores: Column | None, pred: Column) -> DataFrame:
    """Predictions of any number of classes: (model, row_id, y, score, pred, scores).

    ``scores`` has one entry per class and adds up to 1, or is NULL for models without probabilities;
    ``score`` is the entry of the predicted class.
    """
    every = F.lit(None).cast("array<double>") if scores is None else scores
    rows = df.select(F.col(key).alias("row_id"), "y", every.alias("scores"), pred.cast("int").alias("pred"))
    return rows.select(F.lit(name).alias("model"), "row_id", "y", F.get("scores", F.col("pred")).alias("score"),
                       "pred", "scores")


def by_class(scored: DataFrame) -> DataFrame:
    """(model, class, y, score): the score of each row for each class, of models that have them."""
    return scored.filter("scores is not null").select(
        "model", "y", F.posexplode("scores").alias("class", "score"))


def _binary(name: str, prep: Prepared, train: DataFrame, key: str, settings: Settings) -> tuple[Any, DataFrame]:
    """One fitted model of two classes and its scored test rows."""
    features, test = prep.features, prep.test
    probability = vector_to_array(F.col("probability"))[1]
    vectors = assemble(test, features)
    if name == "IsolationForest":
        model = fit_iforest(train, features, key, settings.trees, settings.seed)
        counts = dict(class_counts(train, "y"))
        share = counts.get(1, 0) / sum(counts.values())
        cut = share_cut(score_iforest(train, model), share)
        found = predict_iforest(score_iforest(test, model), cut)
        return model, scored_rows(name, found, key, None, anomaly_to_label(F.col("outlier")))
    if name == "Logistic Regression":
        model = fit_logreg(train, features)
    elif name == "Random Forest (SMOTE)":
        model = fit_rf_smote(train, features, key, settings)
    elif name == "LightGBM":
        model = fit_gbt(train, features, settings)
    elif name == "Balanced RF":
        model = fit_balanced_rf(train, features, key, settings)
    elif name == "SGD SVM":
        model = fit_linear_svm(train, features)
        probability = None
    else:
        raise ValueError(f"unknown model '{name}'")
    return model, scored_rows(name, model.transform(vectors), key, probability, F.col("prediction"))


def _several(name: str, prep: Prepared, train: DataFrame, key: str, settings: Settings) -> tuple[Any, DataFrame]:
    """One fitted model of three or more classes and its scored test rows, with the scores of all classes."""
    features, vectors = prep.features, assemble(prep.test, prep.features)
    scores = vector_to_array(F.col("probability"))
    pred = F.col("prediction")
    if name == "Logistic Regression":
        model = fit_logreg(train, features)
    elif name == "Random Forest (SMOTE)":
        model = fit_rf_smote(train, features, key, settings)
    elif name == "Balanced RF":
        model = fit_balanced_rf(train, features, key, settings)
    elif name == "LightGBM":
        model = one_vs_rest(train, prep.n_classes, lambda rows: fit_gbt(rows, features, settings), "probability",
                            settings.at_once)
        total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
        scores, pred = F.transform("scores", lambda x: x / total), F.col("pred")
    elif name == "SGD SVM":
        model = one_vs_rest(train, prep.n_classes, lambda rows: fit_linear_svm(rows, features), "rawPrediction",
                            settings.at_once)
        scores, pred = None, F.col("pred")
    else:
        raise ValueError(f"'{name}' is no model of {prep.n_classes} classes")
    return model, class_rows(name, model.transform(vectors), key, scores, pred)


def dealt(train: DataFrame, key: str, rows_a_task: int = 1 << 19) -> DataFrame:
    """``train`` dealt evenly by ``key`` over all cores, several tasks to each where one would get over ``rows_a_task``.

    Training rows are the early part of a table that is often stored in time order and in few pieces, so most
    tasks of a scan have none of them.
    """
    cores = train.sparkSession.sparkContext.defaultParallelism
    # A multiple of the cores, so that no core waits while another has a task more.
    return train.repartition(cores * max(1, -(-train.count() // (cores * rows_a_task))), key)


#: Models of two classes only: outliers have no further kinds.
BINARY_ONLY = ["IsolationForest"]


def train_and_score(prep: Prepared, key: str, names: list[str] = MODEL_NAMES,
                    settings: Settings = Settings()) -> tuple[dict[str, Any], DataFrame]:
    """Fit the named models on ``prep.train``, several at a time, and score ``prep.test``.

    Every fit reads the training rows many times, so these are dealt evenly and cached while it lasts. With three or more
    classes the frame has a column ``scores`` with one entry per class, as :func:`class_rows` says, and models
    in BINARY_ONLY are left out.
    """
    if not prep.binary:
        names = [n for n in names if n not in BINARY_ONLY]
    train = dealt(prep.train, key).persist()
    one = _binary if prep.binary else _several
    try:
        done = together(train.sparkSession, {n: partial(one, n, prep, train, key, settings) for n in names},
                        settings.at_once)
    finally:
        train.unpersist()
    return {n: m for n, (m, _) in done.items()}, reduce(DataFrame.unionByName, [p for _, p in done.values()])


def importances(spark, fitted: dict[str, Any], features: list[str]) -> DataFrame:
    """(model, feature, importance, coefficient) of every model that has them.

    Linear models give the absolute coefficient and the coefficient itself, forests the
    impurity importance; with three or more classes, linear models and one-vs-rest give the mean over classes. Models without either are left out. Of a pipeline the last stage
    counts.
    """
    rows = []
    for name, model in fitted.items():
        model = getattr(model, "stages", [model])[-1]
        if isinstance(model, OneVsRest):
            # The mean over classes, without a sign of its own.
            each = [m.coefficients.toArray() if hasattr(m, "coefficients") else m.featureImportances.toArray()
                    for m in model.models]
            values, signed = sum(map(abs, each)) / len(each), None
        elif hasattr(model, "coefficientMatrix") and model.numClasses > 2:
            values, signed = abs(model.coefficientMatrix.toArray()).mean(axis=0), None
        elif hasattr(model, "coefficients"):
            signed = model.coefficients.toArray()
            values = abs(signed)
        elif hasattr(model, "featureImportances"):
            values, signed = model.featureImportances.toArray(), None
        else:
            continue
        rows += [(name, f, float(values[i]), None if signed is None else float(signed[i]))
                 for i, f in enumerate(features)]
    return spark.createDataFrame(
        rows, "model string, feature string, importance double, coefficient double")
