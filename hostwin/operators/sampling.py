"""Balancing: context sampling around positives, and balanced bags."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.functions.scalars import hash_long, hash_unit
from hostwin.operators.datasets import semi_keys
from hostwin.operators.order import global_index
from hostwin.schemas import KEYS
from hostwin.session import pin

# Negatives drawn on each side of a positive row.
MIN_CONTEXT, MAX_CONTEXT = 75, 150


def _bucket(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width))


def context_candidates(indexed: DataFrame, window: int = MAX_CONTEXT) -> DataFrame:
    """All (event, cand, side): negatives within ``window`` positions of each positive.

    An equi-join on position buckets. Positions are dense, so a bucket never holds more
    than ``window`` rows.
    """
    bucket = _bucket(F.col("idx"), window)
    events = indexed.filter(F.col("label") == 1).select(
        F.col("idx").alias("event"),
        F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"))
    negatives = indexed.filter(F.col("label") == 0).select(
        F.col("idx").alias("cand"), bucket.alias("bucket"))
    gap = F.col("cand") - F.col("event")
    return events.join(negatives, "bucket").filter(F.abs(gap).between(1, window)).select(
        "event", "cand", F.when(gap < 0, "before").otherwise("after").alias("side"))


def draw_size(event: Column, side: str, lo: int, hi: int, seed: int) -> Column:
    """Whole number in lo..hi, fixed by the seed, the side and the event."""
    return F.lit(lo) + F.pmod(hash_long(seed, "size", side, event), F.lit(hi - lo + 1))


def draw_sizes(positives: DataFrame, lo: int = MIN_CONTEXT, hi: int = MAX_CONTEXT,
               seed: int = 0) -> DataFrame:
    """(event, k_before, k_after) for each positive position."""
    event = F.col("idx").alias("event")
    return positives.select(
        event, draw_size(F.col("idx"), "before", lo, hi, seed).alias("k_before"),
        draw_size(F.col("idx"), "after", lo, hi, seed).alias("k_after"))


def context_positions(indexed: DataFrame, lo: int = MIN_CONTEXT, hi: int = MAX_CONTEXT,
                      window: int = MAX_CONTEXT, seed: int = 0) -> DataFrame:
    """Distinct positions to keep: every positive and its sampled negatives.

    The candidates of a bucket of positions travel as one array of at most ``3 * window``
    numbers, and each positive draws from it in place: the pairs are never shuffled.
    """
    bucket = _bucket(F.col("idx"), window)
    events = indexed.filter(F.col("label") == 1).select(
        F.col("idx").alias("event"), bucket.alias("bucket"))
    nearby = F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket")
    near = events.select(nearby).distinct()
    negatives = indexed.filter(F.col("label") == 0).select("idx", bucket.alias("bucket"))
    pools = (negatives.join(near, "bucket", "left_semi").select("idx", nearby)
             .groupBy("bucket").agg(F.collect_list("idx").alias("pool")))

    def drawn(side: str, first: Column, last: Column) -> Column:
        inside = F.filter("pool", lambda c: (c >= first) & (c <= last))
        keyed = F.transform(inside, lambda c: F.struct(
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(side), event.cast("string"),
                              c.cast("string"))).alias("h"), c.alias("cand")))
        size = draw_size(event, side, lo, hi, seed).cast("int")
        return F.slice(F.array_sort(keyed), F.lit(1), size)["cand"]

    event = F.col("event")
    sampled = events.join(pools, "bucket").select(F.explode(F.concat(
        drawn("before", event - window, event - 1),
        drawn("after", event + 1, event + window))).alias("idx"))
    return events.select(event.alias("idx")).union(sampled).distinct()


def slice_like(df: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``df`` that have the same key as a kept row."""
    return semi_keys(df, kept.select(*KEYS))


def context_balance(edr: DataFrame, xdr: DataFrame, lo: int = MIN_CONTEXT,
                    hi: int = MAX_CONTEXT, window: int = MAX_CONTEXT,
                    seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Keep positives and sampled negatives near them, the same rows in both tables.

    The endpoint rows come back with their position ``idx`` in the full table. Only keys
    and labels are sorted and sampled; the wide tables are then filtered by key. Both are
    read more than once, so pass stored tables rather than ones still to be computed.
    """
    indexed = global_index(edr.select(*KEYS, "label"))
    positions = context_positions(indexed, lo, hi, window, seed)
    kept = pin(indexed.join(positions, "idx", "left_semi").select("idx", *KEYS))
    return edr.join(kept, KEYS).select("idx", *edr.columns), slice_like(xdr, kept)


def poisson_weight(rate: float, *parts) -> Column:
    """Poisson draw of mean ``rate``, fixed by the text of ``parts``."""
    steps, term, cdf = [], math.exp(-rate), 0.0
    # Stop once the remaining tail is smaller than one step of the draw.
    while 1.0 - cdf >= 2.0**-52 and term > 0.0:
        cdf += term
        steps.append(cdf)
        term *= rate / len(steps)

    def count(u: Column) -> Column:
        # The first step above the draw ends the search, which is mostly one of the first two.
        return reduce(lambda found, c: found.when(u < F.lit(c[1]), c[0]), enumerate(steps),
                      F.when(u.isNull(), 0)).otherwise(len(steps))

    # A one-element array binds the draw to a name, so that it is computed once.
    return F.get(F.transform(F.array(hash_unit(*parts)), count), 0)


def bag_rates(minority: int, majority: int, ratio: float) -> tuple[float, float]:
    """Poisson rates of minority and majority rows in a bag with the given class ratio."""
    if minority == 0 or minority / ratio > majority:
        raise ValueError(f"cannot draw a 1:{1 / ratio:g} bag from {minority} and {majority} rows")
    return 1.0, minority / ratio / majority


def balanced_bag(df: DataFrame, key: str, label: str = "label", ratio: float = 0.5,
                 bags: int = 10, seed: int = 42) -> DataFrame:
    """Rows of each balanced bootstrap bag, with the number of times each was drawn.

    Minority rows are drawn once on average; majority rows so that minority / majority is
    ``ratio``. A draw depends only on the seed, the bag and the row key.
    """
    (_, minority), (major_label, majority) = two_classes(df, label)
    low, high = bag_rates(minority, majority, ratio)
    per_bag = F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag")
    rows = df.select("*", per_bag)
    weight = class_poisson(F.col(label) == major_label, high, low, seed, F.col("bag"), F.col(key))
    return rows.withColumn("weight", weight).filter(F.col("weight") > 0)


def class_poisson(is_major: Column, high: float, low: float, *parts) -> Column:
    """Poisson draw at the rate of the row's class."""
    return F.when(is_major, poisson_weight(high, *parts)).otherwise(poisson_weight(low, *parts))


def class_counts(df: DataFrame, label: str) -> list[tuple]:
    """[(class, rows)] from the rarest to the most frequent class, for labels of any type.

    Of equally frequent classes the one with the higher label comes first. Rows without label
    are no class. One row per class reaches the driver.
    """
    rows = df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()
    by_label = sorted(((r[0], r["count"]) for r in rows), reverse=True)
    return sorted(by_label, key=lambda r: r[1])


def two_classes(df: DataFrame, label: str) -> list[tuple]:
    """:func:`class_counts` of a binary label; any other number of classes is an error."""
    counts = class_counts(df, label)
    if len(counts) != 2:
        raise ValueError(f"{label} has {len(counts)} classes, but exactly two are needed")
    return counts
