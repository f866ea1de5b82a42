"""Model preparation: target and feature discovery, imputing, scaling, class statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from hostwin.functions.scalars import clean_inf, map_columns
from hostwin.operators.order import exact_quantiles, global_index
from hostwin.session import pin

# Target names in order of preference, host identifiers, time columns.
TARGETS = ["label", "Class", "target", "y"]
HOST_IDS = ["src_comp", "dst_comp", "computer", "host"]
TIME_COLUMNS = ["day", "win"]


def find_target(df: DataFrame) -> str:
    """The target column; an error names the columns if there is none."""
    for name in TARGETS:
        if name in df.columns:
            return name
    raise ValueError(f"no target column among {df.columns}")


def feature_columns(df: DataFrame, include_time: bool = True) -> list[str]:
    """All columns but the target and host identifiers; day and window start on request."""
    left_out = {find_target(df), *HOST_IDS, *([] if include_time else TIME_COLUMNS)}
    return [c for c in df.columns if c not in left_out]


def align(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly ``features`` in order (0 where absent), after the columns to ``keep``."""
    return df.select(
        *[c for c in keep if c in df.columns and c not in features],
        *[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in features])


def fit_medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact median of each column. One value per column reaches the driver."""
    return {r["feature"]: r["quantile"] for r in exact_quantiles(df, cols, 0.5).collect()}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Clean infinities, then replace missing values by the given medians."""
    clean = clean_inf(as_double(df, list(medians)), medians)
    return clean.na.fill(medians)


def as_double(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast columns to DOUBLE, so that a fractional median is not cut off."""
    return map_columns(df, {c: f"cast(`{c}` as double)" for c in cols})


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation; a constant column gets deviation 1."""
    row = df.agg(*[F.expr(f"struct(avg(`{c}`) as mean, stddev_pop(`{c}`) as std)").alias(c)
                   for c in cols]).first()
    return {c: (row[c]["mean"], row[c]["std"] or 1.0) for c in cols}


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """Subtract the mean and divide by the deviation."""
    return map_columns(df, {c: f"(`{c}` - double('{mean!r}')) / double('{std!r}')"
                            for c, (mean, std) in stats.items()})


def label_codes(train: DataFrame, target: str) -> DataFrame:
    """(class, code): distinct training labels, numbered in their own order. Stored.

    The numbers 0 and 1 and truth values stand for themselves: where training has no other labels, both have
    their code, also if one of them is absent.
    """
    found = train.select(F.col(target).alias("class")).filter("class is not null").distinct()
    codes = pin(global_index(found, ["class"], "code").select("class", F.col("code").cast("int")))
    field = train.schema[target].dataType
    if isinstance(field, (NumericType, BooleanType)) and not codes.isEmpty() and codes.filter(
            ~F.col("class").cast("double").isin(0.0, 1.0)).isEmpty():
        return train.sparkSession.range(2).select(
            F.col("id").cast(field).alias("class"), F.col("id").cast("int").alias("code"))
    return codes


def encode_labels(df: DataFrame, target: str, codes: DataFrame, name: str = "y") -> DataFrame:
    """Add the class code; a label that training did not have is an error.

    Any number of classes will do: they are joined, and the planner broadcasts them while few.
    """
    known = codes.select(F.col("class").cast(dict(df.dtypes)[target]).alias("_class"),
                         F.col("code").alias("_code"))
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col(target).cast("string")))
    code = F.coalesce("_code", F.when(F.col(target).isNotNull(), unseen.cast("int")))
    joined = df.join(known, F.col(target) == F.col("_class"), "left")
    return joined.withColumn(name, code).drop("_class", "_code")


@dataclass
class Prepared:
    """Imputed train and test rows with the fitted statistics; ``n_classes`` counts the codes."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    codes: DataFrame
    n_classes: int
    medians: dict[str, float]
    stats: dict[str, tuple[float, float]]

    @property
    def binary(self) -> bool:
        return self.n_classes == 2


def prepare(train: DataFrame, test: DataFrame, include_time: bool = True,
            keep: list[str] = (), scaled: bool = True) -> Prepared:
    """Align, clean, impute, encode and scale; everything is fitted on ``train`` only.

    Features that also serve as keys can be kept unscaled under another name first.
    """
    target = find_target(train)
    features = feature_columns(train, include_time)
    features = [c for c in features if c not in keep]
    codes = label_codes(train, target)
    carried = [*keep, *[c for c in HOST_IDS if c not in keep]]
    clean = clean_inf(as_double(train, features), features)
    medians = fit_medians(clean, features)

    def ready(df: DataFrame) -> DataFrame:
        has_target = target in df.columns
        df = align(df, features, [*carried, target])
        df = impute(df, medians)
        if has_target:
            return encode_labels(df, target, codes).drop(*([target] if target != "y" else []))
        return df.withColumn("y", F.lit(None).cast("int"))

    train_x, test_x = ready(train), ready(test)
    stats = {}
    if scaled:
        stats = fit_scaler(train_x, features)
        train_x, test_x = scale(train_x, stats), scale(test_x, stats)
    return Prepared(train_x, test_x, features, codes, codes.count(), medians, stats)


def class_balance(df: DataFrame, target: str = "label") -> DataFrame:
    """Rows per class, minority / majority in percent, and the extreme imbalance warning."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # one row per class
    share = F.when(F.count(F.lit(1)).over(whole) > 1,
                   F.min("n").over(whole) / F.max("n").over(whole) * 100).otherwise(100.0)
    return counts.withColumn("balance_pct", share).withColumn(
        "extreme_imbalance", imbalance_warning(F.col("balance_pct")))


def imbalance_warning(balance_pct):
    """True where the minority is less than 1 % of the majority."""
    return balance_pct / 100 < 0.01


def overview(train: DataFrame, test: DataFrame, include_time: bool = True) -> DataFrame:
    """Rows, columns, features and missing cells of both sides, one pass each."""
    features = len(feature_columns(train, include_time))

    def side(df: DataFrame, name: str) -> DataFrame:
        doubles = {n for n, t in df.dtypes if t in ("double", "float")}
        missing = [
            F.count_if(F.col(c).isNull() | F.isnan(c) if c in doubles else F.col(c).isNull())
            for c in df.columns]
        return df.agg(F.count(F.lit(1)).alias("n_rows"),
                      reduce(lambda a, b: a + b, missing).alias("missing")).select(
            F.lit(name).alias("split"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
            F.lit(features).alias("n_features"), "missing")

    return side(train, "train").unionByName(side(test, "test"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Contamination, positive weight and balanced class weights of a binary label."""
    n = F.count(F.lit(1))
    pos = F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0))
    counts = df.agg(n.alias("n"), pos.alias("positives"))
    n, pos = F.col("n"), F.col("positives")
    return counts.select(
        "n", "positives",
        F.try_divide(pos, n).alias("contamination"),
        F.try_divide(n - pos, pos).alias("pos_weight"),
        F.try_divide(n, 2 * (n - pos)).alias("weight_0"),
        F.try_divide(n, 2 * pos).alias("weight_1"))


def baseline_accuracy(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy on test of always answering the most frequent training class."""
    top = (train.groupBy(label).count().orderBy(F.desc("count"), label).limit(1)
           .select(F.col(label)).first()[0])
    hit = F.avg((F.col(label) == F.lit(top)).cast("double"))
    return test.agg(F.lit(top).alias("majority"), hit.alias("accuracy"))
