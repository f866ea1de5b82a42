import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostwin.operators import order, sampling
from hostwin.operators.smote import (
    box_tree, tree_rounds,
    _with_reach, asking_rows, compact_blocks, nearest_neighbours, smote)


def table(spark, n, positives):
    return spark.range(n).select(
        F.concat(F.lit("C"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("src_comp"),
        F.lit(0).cast("bigint").alias("day"), F.lit(0).cast("bigint").alias("win"),
        F.col("id").isin(positives).cast("int").alias("label"))


def balanced(spark, n, positives, lo=3, hi=6, window=8, seed=1):
    df = table(spark, n, positives)
    kept, twin = sampling.context_balance(df, df.withColumn("extra", F.lit(1)), lo, hi, window, seed)
    assert kept.select("src_comp").exceptAll(twin.select("src_comp")).count() == 0
    assert kept.count() == twin.count()
    return {r.idx: r.label for r in kept.collect()}


def test_positives_are_kept_and_negatives_are_near(spark):
    positives = [0, 100, 110, 299]
    kept = balanced(spark, 300, positives)
    assert {i for i, y in kept.items() if y == 1} == set(positives)
    for i, y in kept.items():
        assert y == 1 or any(0 < abs(i - p) <= 8 for p in positives)


def test_sample_sizes_are_clamped_at_the_ends(spark):
    kept = balanced(spark, 50, [0, 49], lo=6, hi=6)
    assert sum(0 < i <= 8 for i in kept) == 6 and sum(41 <= i < 49 for i in kept) == 6
    assert len(balanced(spark, 4, [1], lo=6, hi=6)) == 4


def test_positives_are_no_context(spark):
    pairs = sampling.context_candidates(
        order.global_index(table(spark, 60, [20, 25])), 10).collect()
    assert not {r.cand for r in pairs} & {20, 25}
    assert {(r.event, r.cand) for r in pairs} == {
        (p, c) for p in (20, 25) for c in range(60) if 0 < abs(p - c) <= 10 and c not in (20, 25)}
    assert all((r.side == "before") == (r.cand < r.event) for r in pairs)


def test_third_of_all_rows_positive(spark):
    positives = list(range(0, 600, 3))
    kept = balanced(spark, 600, positives, lo=2, hi=4)
    assert {i for i, y in kept.items() if y == 1} == set(positives)


def test_sampling_is_repeatable_and_seeded(spark):
    a = balanced(spark, 400, [50, 200])
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    b = balanced(spark, 400, [50, 200])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b and a != balanced(spark, 400, [50, 200], seed=2)


def points(spark, n, d, seed=0, copies=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, d)).astype(float)
    if copies:
        x[: n // 3] = x[0]
    names = [f"f{i}" for i in range(d)]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return x, names, spark.createDataFrame(
        rows, "id bigint, " + ", ".join(f"{c} double" for c in names))


@pytest.mark.parametrize("block_rows, copies", [(1024, False), (16, False), (2, True), (16, True)])
def test_neighbours_equal_brute_force(spark, block_rows, copies):
    x, names, df = points(spark, 150, 3, copies=copies)
    got = nearest_neighbours(df, names, 4, block_rows).collect()
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    want = np.argsort(d2, axis=1, kind="stable")[:, :4]
    assert {(r.id, r["rank"]): r.nbr for r in got} == {
        (i, j + 1): int(want[i, j]) for i in range(150) for j in range(4)}


@pytest.mark.parametrize("d, most", [(3, 0.25), (8, 0.95), (31, 1.0)])
def test_blocks_that_meet(spark, d, most):
    """Compact blocks keep rows from most others while there are few dimensions."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((1500, d)))]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>").withColumn("r", F.sqrt(
        F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)))
    blocks = compact_blocks(df, "vec", d, 32)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert max(sizes) <= 32 and len(sizes) < 160
    met = asking_rows(_with_reach(blocks, 5), d).count()
    assert met / (len(rows) * len(sizes)) <= most


def test_projected_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 8))
    names = [f"f{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)],
                               "id bigint, " + ", ".join(f"{c} double" for c in names))
    got = nearest_neighbours(df, names, 5, 512, method="projected").collect()
    assert len(got) == 5 * len(x)
    d2 = (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T
    np.fill_diagonal(d2, np.inf)
    want = np.argsort(d2, axis=1)[:, :5]
    found = {}
    for r in got:
        found.setdefault(r.id, set()).add(r.nbr)
    recall = np.mean([len(found[i] & set(want[i].tolist())) / 5 for i in range(len(x))])
    assert recall > 0.75
    with pytest.raises(ValueError, match="unknown method"):
        nearest_neighbours(df, names, 5, method="guess")


@pytest.mark.parametrize("d, least", [(8, 0.9), (31, 0.9)])
def test_graph_neighbours(spark, d, least):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, d))
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)],
                               "id bigint, " + ", ".join(f"{c} double" for c in names))
    got = nearest_neighbours(df, names, 5, 512, method="graph").collect()
    assert len(got) == 5 * len(x)
    d2 = (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T
    np.fill_diagonal(d2, np.inf)
    want = np.argsort(d2, axis=1)[:, :5]
    found = {}
    for r in got:
        found.setdefault(r.id, set()).add(r.nbr)
        assert r.d2 == pytest.approx(d2[r.id, r.nbr], abs=1e-9)
    recall = np.mean([len(found[i] & set(want[i].tolist())) / 5 for i in range(len(x))])
    print("recall", d, recall)
    assert recall >= least


def test_graph_with_a_hub_and_copies(spark):
    """A row that is everyone's neighbour meets them in parts; copies are found as with the exact method."""
    x, names, df = points(spark, 150, 3, copies=True)
    got = nearest_neighbours(df, names, 4, 16, method="graph").collect()
    assert len(got) == 600 and len({(r.id, r.nbr) for r in got}) == 600
    rng = np.random.default_rng(4)
    star = np.vstack([np.zeros((1, 20)), np.eye(20)[rng.integers(0, 20, 1500)] * rng.uniform(5, 6, (1500, 1))])
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(star)],
                                 "id bigint, " + ", ".join(f"g{i} double" for i in range(20)))
    near = nearest_neighbours(rows, [f"g{i}" for i in range(20)], 3, 128, method="graph").collect()
    assert len(near) == 3 * 1501


def test_pairs_of_the_box_tree_grow_with_the_rows(spark):
    """Pairs listed on three-dimensional rows stay in proportion, where all pairs would be 64 times as many."""
    listed = {}
    for n in (2000, 16000):
        rng = np.random.default_rng(5)
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.random((n, 3)))],
                                   "id bigint, vec array<double>")
        rows = _with_reach(compact_blocks(df, "vec", 3, 32), 5)
        rounds = tree_rounds(box_tree(rows, 3), 3)
        listed[n] = sum(r.count() for r in rounds)
        blocks = rows.select("block").distinct().count()
        assert listed[n] < 80 * blocks
    print(listed)
    assert listed[16000] < 16 * listed[2000]


def test_text_labels(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 10 == 0, "bad").otherwise("good").alias("label"),
                                   (F.col("id") % 37).cast("double").alias("a"))
    out = smote(rows, ["a"], "id")
    assert out.count() == int(0.5 * 270) - 30 and out.filter("label <> 'bad'").count() == 0
    assert sampling.class_counts(rows, "label") == [("bad", 30), ("good", 270)]
    with pytest.raises(ValueError, match="exactly two"):
        smote(rows.withColumn("label", F.col("id") % 3), ["a"], "id")


def test_many_copies_are_not_compared(spark):
    """Only k + 1 of 20,000 equal rows take part in the search."""
    rows = spark.range(20_300).select("id", F.when(F.col("id") < 20_000, 1.0).otherwise(
        F.col("id").cast("double")).alias("a"))
    near = nearest_neighbours(rows, ["a"], 3).cache()
    assert near.count() == 3 * 20_300
    copies = near.filter("id between 3 and 19999").agg(
        F.max("nbr"), F.max("d2"), F.count_distinct("id")).first()
    assert tuple(copies) == (2, 0.0, 19_997)
    assert {r.nbr for r in near.filter("id = 1").collect()} == {0, 2, 3}


def test_smote_counts_and_place(spark):
    rows = spark.range(400).select(
        F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("label"),
        (F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    out = smote(rows, ["a", "b"], "id").toPandas()
    assert len(out) == int(0.5 * 360) - 40 and (out["label"] == 1).all()
    ref = rows.filter("label = 1").toPandas()
    assert out["a"].between(ref["a"].min(), ref["a"].max()).all()
    assert out["b"].between(ref["b"].min(), ref["b"].max()).all()


def test_smote_errors(spark):
    few = spark.range(100).select("id", (F.col("id") < 4).cast("int").alias("label"),
                                  F.col("id").cast("double").alias("a"))
    with pytest.raises(ValueError, match="too few"):
        smote(few, ["a"], "id")
    even = few.withColumn("label", (F.col("id") % 2).cast("int"))
    with pytest.raises(ValueError, match="already"):
        smote(even, ["a"], "id")


def test_poisson_weights_follow_the_rate(spark):
    for rate in (0.05, 1.0, 3.0):
        mean, var = spark.range(20_000).select(
            sampling.poisson_weight(rate, 5, F.col("id")).alias("w")).agg(
            F.avg("w"), F.var_pop("w")).first()
        assert mean == pytest.approx(rate, rel=0.1) and var == pytest.approx(rate, rel=0.15)


def test_poisson_weights_count_the_steps_below_the_draw(spark):
    for rate in (0.05, 1.0, 3.0):
        steps = np.cumsum([math.exp(-rate) * rate ** k / math.factorial(k) for k in range(40)])
        rows = spark.range(3000).select(sampling.hash_unit(5, F.col("id")).alias("u"),
                                        sampling.poisson_weight(rate, 5, F.col("id")).alias("w")).collect()
        assert all(r.w == np.searchsorted(steps, r.u, "right") for r in rows)


def test_balanced_bag_ratio(spark):
    df = spark.range(5000).select("id", (F.col("id") % 20 == 0).cast("int").alias("label"))
    rows = sampling.balanced_bag(df, "id", bags=3).groupBy("bag").pivot("label", [0, 1]).agg(
        F.sum("weight")).collect()
    assert len(rows) == 3
    assert all(r["1"] / r["0"] == pytest.approx(0.5, rel=0.3) for r in rows)
    with pytest.raises(ValueError, match="cannot draw"):
        sampling.balanced_bag(df.filter("id % 20 < 2"), "id")
