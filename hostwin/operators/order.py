"""Global order: sorts, row positions, running totals and exact quantiles.

None of these puts a whole table, or a whole group, in one task. Rows are range-sorted by
Spark, which cuts them into contiguous parts of even size whatever the skew; the result is
pinned as a table; only one row per part is then needed to turn positions within a part
into global ones.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostwin.functions.scalars import drop_unparseable, filter_days
from hostwin.schemas import KEPT_DAYS
from hostwin.session import pin

CHRONO = ["day", "win", "src_comp"]


def chrono(df: DataFrame) -> DataFrame:
    """Chronological order; the host settles rows of the same window."""
    return df.orderBy(*CHRONO)


def sort_filter(df: DataFrame, days: list[int] = KEPT_DAYS) -> DataFrame:
    """Rows of the listed days in chronological order; unreadable days are dropped."""
    types = dict(df.dtypes)
    if types["day"] != "bigint" or types["win"] != "bigint":
        df = drop_unparseable(df, "day", "win")
    return chrono(filter_days(df, days).na.drop(subset=["win"]))


def ranged(df: DataFrame, order: list) -> DataFrame:
    """Rows in global order, with the number of their part and the position inside it."""
    tagged = pin(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    return tagged.select(
        *df.columns,
        F.shiftright("_mid", 33).cast("int").alias("_part"),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"))


def global_index(df: DataFrame, order: list | None = None, name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row in the global order.

    ``order`` must be unique per row for the positions to be repeatable.
    """
    rows = ranged(df, order or CHRONO)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # One row per part of the sort: bounded by the number of shuffle partitions.
    return rows.join(F.broadcast(offsets), "_part").select(
        (F.col("_offset") + F.col("_pos")).alias(name), *df.columns)


def running_totals(df: DataFrame, group: list[str], order: list, values: list[str]) -> DataFrame:
    """Add, for each value ``v``, its running total ``v_cum`` and group total ``v_total``.

    The total runs inside each group in the given order and includes the current row.
    """
    rows = ranged(df, [*group, *order])
    parts = rows.groupBy(*group, "_part").agg(*[F.sum(v).alias(v) for v in values])
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *group, "_part",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values],
        *[F.sum(v).over(whole).alias(f"{v}_total") for v in values])
    inside = Window.partitionBy(*group, "_part").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, 0)
    summed = rows.select(
        *df.columns, "_part", *[F.sum(v).over(inside).alias(f"{v}_inside") for v in values])
    joined = summed.join(offsets, [*group, "_part"])
    return joined.select(
        *df.columns,
        *[(F.col(f"{v}_inside") + F.col(f"{v}_before")).alias(f"{v}_cum") for v in values],
        *[f"{v}_total" for v in values])


#: Size of quantile sketches; their ranks are off by well under SKETCH_ERROR.
SKETCH_SIZE, SKETCH_ERROR = 4096, 0.01


def _valid(c: str) -> str:
    return f"case when not isnan(double(`{c}`)) then double(`{c}`) end"


def quantile_sketches(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, sketch): a mergeable summary of the values of each column, of bounded size.

    Store those of each increment; :func:`merge_sketches` makes them one, and :func:`exact_quantiles`
    then needs no first pass over the increments before.
    """
    sketches = df.agg(*[F.expr(f"kll_sketch_agg_double({_valid(c)}, {SKETCH_SIZE})").alias(c) for c in cols])
    return sketches.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("sketch")) for c in cols])).alias("s")).select("s.*")


def merge_sketches(frames: list[DataFrame]) -> DataFrame:
    """One sketch per column for several increments."""
    return reduce(DataFrame.unionByName, frames).groupBy("feature").agg(
        F.expr("kll_merge_agg_double(sketch)").alias("sketch"))


def _sketched(sketches: DataFrame, cols: list[str], q: float) -> dict:
    """The number of values of each column and a bracket around its quantile, from sketches."""
    low, high = max(0.0, q - SKETCH_ERROR), min(1.0, q + SKETCH_ERROR)
    n = F.expr("kll_sketch_get_n_double(sketch)").alias("n")
    ends = F.when(F.expr("kll_sketch_get_n_double(sketch)") > 0, F.array(*[
        F.expr(f"kll_sketch_get_quantile_double(sketch, double('{e!r}'))") for e in (low, high)])).alias("ends")
    found = {r.feature: {"n": r.n, "ends": r.ends} for r in sketches.select("feature", n, ends).collect()}
    return {c: found.get(c, {"n": 0, "ends": None}) for c in cols}


def exact_quantiles(df: DataFrame, cols: list[str], q: float, accuracy: int = 10_000,
                    sketches: DataFrame | None = None) -> DataFrame:
    """Exact interpolated quantile of each column: (feature, quantile).

    NULL and NaN are left out; a column without any other value is left out of the result. A
    first pass brackets each quantile by approximate ones, whose rank is off by at most
    1 / ``accuracy``; merged ``sketches`` of all rows give the bracket without that pass. The second counts what
    lies below the bracket and inside it, which also shows that the quantile is inside; a column where it is not
    loses its bracket. Only the values inside, counted by value, are then ranked. Most of a column is never shuffled.
    """
    valid = {c: _valid(c) for c in cols}
    low, high = max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)
    around = _sketched(sketches, cols, q) if sketches is not None else df.agg(*[
        F.expr(f"struct(count({v}) as n, percentile_approx({v}, array({low!r}D, {high!r}D), "
               f"{accuracy}) as ends)").alias(c) for c, v in valid.items()]).first()
    cols = [c for c in cols if around[c]["n"]]
    # Interpolation takes two ranks, so a bracket needs room: at least 4 rows on either side of
    # the rank, or else no bound. The lowest and highest ranks need none on their side.
    roomy = {c: around[c]["n"] >= (4 / SKETCH_ERROR if sketches is not None else 4 * accuracy) for c in cols}
    ends = {c: (f"double('{around[c]['ends'][0]!r}')" if roomy[c] and low > 0 else "double('-Infinity')",
                f"double('{around[c]['ends'][1]!r}')" if roomy[c] and high < 1 else "double('Infinity')")
            for c in cols}
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "feature string, quantile double")
    split = df.agg(*[F.expr(f"struct(count_if({valid[c]} < {ends[c][0]}) as below, count_if({valid[c]} between "
                            f"{ends[c][0]} and {ends[c][1]}) as inside)").alias(c) for c in cols]).first()
    below = {}
    for c in cols:
        rank = q * (around[c]["n"] - 1)
        held = split[c]["below"] <= math.floor(rank) and math.ceil(rank) < split[c]["below"] + split[c]["inside"]
        below[c] = split[c]["below"] if held else 0
        ends[c] = ends[c] if held else ("double('-Infinity')", "double('Infinity')")
    facts = spark.createDataFrame(
        [(c, q * (around[c]["n"] - 1), int(below[c])) for c in cols], "feature string, rank double, below bigint")
    long = df.selectExpr(*[f"case when {valid[c]} between {ends[c][0]} and {ends[c][1]} then {valid[c]} end as `{c}`"
                           for c in cols]).unpivot([], cols, "feature", "value")
    counts = long.filter("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(counts, ["feature"], ["value"], ["n"]).join(F.broadcast(facts), "feature")

    def value_at(position):
        last = F.col("below") + F.col("n_cum")
        return F.max(F.when((last - F.col("n") <= position) & (position < last), F.col("value")))

    rank = F.col("rank")
    picked = cum.groupBy("feature").agg(
        value_at(F.floor(rank)).alias("lo"), value_at(F.ceil(rank)).alias("hi"),
        F.max(rank - F.floor(rank)).alias("w"))
    # Equal ends are returned as they are, since inf - inf is not a number.
    mixed = F.col("lo") * (1 - F.col("w")) + F.col("hi") * F.col("w")
    return picked.select(
        "feature", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(mixed)
        .alias("quantile"))
