import numpy as np
import pytest
from pyspark.sql import functions as F

from hostwin.operators import order, splits


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one window, and many windows with few."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 50).cast("bigint").alias("day"),
        F.when(F.col("id") % 3 == 0, 432_000).otherwise((F.col("id") % 50) * 86_400)
        .cast("bigint").alias("win"),
        F.concat(F.lit("C"), F.col("id").cast("string")).alias("src_comp"),
        (F.col("id") % 7).alias("v"))


def test_global_index_is_the_sorted_position(skewed):
    rows = order.global_index(skewed).toPandas()
    want = skewed.toPandas().sort_values(["day", "win", "src_comp"])["src_comp"].tolist()
    assert rows.sort_values("idx")["src_comp"].tolist() == want
    assert sorted(rows["idx"]) == list(range(6000))


def test_hot_window_is_spread_over_parts(skewed):
    parts = order.ranged(skewed, order.CHRONO).filter("day = 5").select("_part").distinct()
    assert parts.count() > 1


def test_running_totals(skewed):
    got = order.running_totals(skewed, ["day"], ["src_comp"], ["v"]).toPandas()
    got = got.sort_values(["day", "src_comp"])
    assert (got.groupby("day")["v"].cumsum() == got["v_cum"]).all()
    assert (got.groupby("day")["v"].transform("sum") == got["v_total"]).all()
    assert len(got) == 6000


@pytest.mark.parametrize("q", [0.0, 0.07, 0.5, 0.93, 1.0])
def test_exact_quantiles(spark, q):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=501), rng.integers(0, 4, 501).astype(float)
    rows = [(float(x), float(y) if i % 5 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(6)
    got = {r.feature: r.quantile for r in order.exact_quantiles(df, ["a", "b"], q).collect()}
    assert got["a"] == pytest.approx(np.quantile(a, q))
    assert got["b"] == pytest.approx(np.quantile([y for _, y in rows if y is not None], q))


def test_sort_filter_reads_text_days(spark):
    df = spark.createDataFrame([("2", "600", "B"), ("2", "300", "A"), ("x", "0", "A"),
                                ("3", "0", "A")], "day string, win string, src_comp string")
    rows = order.sort_filter(df, [1, 2]).collect()
    assert [(r.day, r.win, r.src_comp) for r in rows] == [(2, 300, "A"), (2, 600, "B")]


def test_splits(spark):
    df = spark.createDataFrame([(d,) for d in range(30)], "day bigint")
    last = splits.split_last_days(df)
    assert sorted(r.day for r in splits.take(last, "test").collect()) == list(range(23, 30))
    assert splits.take(last, "train").count() == 23
    fixed = splits.split_days(df, [1, 2, 3], [3, 4])
    assert {r.day: r.split for r in fixed.collect()} == {
        1: "train", 2: "train", 3: "train", 4: "test"}


def test_bracketed_quantiles_are_exact(spark):
    """With a coarse accuracy the bracket leaves most of the column out."""
    df = spark.range(50_000).select((F.pow(F.col("id"), 1.5) % 9973).alias("a"), (F.col("id") % 3).alias("b"),
                                    F.when(F.col("id") % 2 == 0, F.col("id")).cast("double").alias("c"))
    want = {c: df.selectExpr(*[f"percentile({c}, {q}) as q{i}" for i, q in enumerate((0.0, 0.5, 0.93, 1.0))]).first()
            for c in df.columns}
    for i, q in enumerate((0.0, 0.5, 0.93, 1.0)):
        got = {r.feature: r.quantile for r in order.exact_quantiles(df, df.columns, q, accuracy=1000).collect()}
        assert got == pytest.approx({c: want[c][i] for c in df.columns})
