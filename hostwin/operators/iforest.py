"""Isolation forest (Liu, Ting and Zhou, 2008): samples and scores are spread by Spark."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostwin.functions.scalars import hash_long, hash_unit
from hostwin.operators.order import exact_quantiles

SAMPLE_ROWS = 256
_TREE = ("tree int, feature array<int>, cut array<double>, child array<int>, depth array<double>")


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 3.0)
    long = 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def sampled_rows(df: DataFrame, key: str, n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, columns of df): ``sample`` different rows of the whole table for each tree.

    One formula at every size. A row enters a tree with probability min(1, 2 * sample / n): the
    number of its trees is a binomial draw from its key, and these are the trees that a hash of
    key and tree ranks first. Of the rows of a tree, about twice ``sample``, the first by
    another hash stay. Only chosen rows leave the scan.
    """
    rate = min(1.0, 2 * sample / max(n, 1))
    steps, cdf = [], 0.0
    for k in range(trees):
        log = math.lgamma(trees + 1) - math.lgamma(k + 1) - math.lgamma(trees - k + 1)
        rest = (trees - k) * math.log1p(-rate) if rate < 1 else -math.inf
        cdf += math.exp(log + k * math.log(rate) + rest)
        if 1.0 - cdf < 2.0**-52:
            break
        steps.append(cdf)
    # A one-element array binds the draw to a name, so that it is computed once.
    count = F.get(F.transform(F.array(hash_unit(seed, "trees", F.col(key))), lambda u: sum(
        (F.when(u >= F.lit(c), 1).otherwise(0) for c in steps), F.lit(0))), 0)
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        hash_long(seed, "tree", F.col(key), t).alias("h"), t.alias("tree"))))
    drawn = df.withColumn("_count", count).filter(F.col("_count") > 0).select(
        *df.columns, F.explode(F.slice(ranked, F.lit(1), F.col("_count"))["tree"]).alias("tree"))
    best = Window.partitionBy("tree").orderBy(hash_long(seed, "keep", F.col("tree"), F.col(key)), key)
    return drawn.withColumn("_rank", F.row_number().over(best)).filter(
        F.col("_rank") <= sample).drop("_rank")


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> dict[str, list]:
    """One tree as parallel lists; ``child`` is the left child, the right one follows it."""
    tree = {"feature": [], "cut": [], "child": [], "depth": []}

    def add() -> int:
        for name, value in (("feature", -1), ("cut", 0.0), ("child", -1), ("depth", 0.0)):
            tree[name].append(value)
        return len(tree["cut"]) - 1

    todo = [(add(), np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            tree["depth"][node] = depth + float(average_path(len(rows)))
            continue
        f = int(rng.choice(usable))
        cut = rng.uniform(low[f], high[f])
        left = x[rows, f] <= cut
        tree["feature"][node], tree["cut"][node] = f, float(cut)
        tree["child"][node] = add()
        add()
        todo.append((tree["child"][node], rows[left], depth + 1))
        todo.append((tree["child"][node] + 1, rows[~left], depth + 1))
    return tree


def fit_iforest(df: DataFrame, features: list[str], key: str, trees: int = 200,
                seed: int = 42, sample: int = SAMPLE_ROWS) -> dict:
    """Grow the trees, one small group each; a forest has at most trees * 2 * sample nodes.

    ``key`` must be unique: draws depend on it alone.
    """
    n = df.count()
    size = min(sample, n)
    picked = sampled_rows(df.select(key, *features), key, n, trees, size, seed)
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values(key)[features].to_numpy(dtype=float)
        grown = _grow(rows, limit, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], **{k: [v] for k, v in grown.items()}})

    rows = picked.groupBy("tree").applyInPandas(grow, _TREE).orderBy("tree").collect()
    forest = [{k: np.array(r[k]) for k in ("feature", "cut", "child", "depth")} for r in rows]
    return {"features": features, "trees": forest, "scale": float(average_path(size))}


def score_iforest(df: DataFrame, model: dict, name: str = "anomaly") -> DataFrame:
    """Add the anomaly score, 2 ** (-mean path / expected path)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        forest = shared.value
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for tree in forest["trees"]:
            node = np.zeros(len(x), dtype=int)
            while True:
                f = tree["feature"][node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.where(inner, f, 0)] > tree["cut"][node]
                node = np.where(inner, tree["child"][node] + right, node)
            total += tree["depth"][node]
        return pd.Series(2.0 ** (-total / len(forest["trees"]) / forest["scale"]))

    return df.withColumn(name, score(*[F.col(c) for c in model["features"]]))


def anomaly_cut(train_scores: DataFrame, contamination: float, name: str = "anomaly") -> float:
    """The score above which a row is an outlier, from the training scores."""
    if not 0.0 < contamination <= 0.5:
        raise ValueError(f"contamination must be in (0, 0.5], got {contamination}")
    return share_cut(train_scores, contamination, name)


def share_cut(train_scores: DataFrame, share: float, name: str = "anomaly") -> float:
    """The score above which the given share of the training rows lies, any from 0 to 1."""
    # The quantile is taken of the negated score, as outliers have the lowest there.
    flipped = train_scores.select((-F.col(name)).alias("v"))
    return -exact_quantiles(flipped, ["v"], share).first()["quantile"]


def predict_iforest(scored: DataFrame, cut: float, name: str = "anomaly") -> DataFrame:
    """Add ``outlier``: -1 above the cut, else 1."""
    return scored.withColumn("outlier", F.when(F.col(name) > F.lit(cut), -1).otherwise(1))
