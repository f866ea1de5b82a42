"""Shared helpers: table reads, Arrow row groups, sorted runs, joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwin.session import pin

Batches = Iterable[pa.RecordBatch]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_held: dict[tuple, Any] = {}


def sole(make: Callable[..., Any]) -> Callable[..., Any]:
    """``make``, whose last result stays in the process until another such function, or call, needs the room.

    Worker processes outlive the queries that they serve. For results that are large and quickly made again.
    """
    @wraps(make)
    def held(*args: Any) -> Any:
        name = (make.__module__, make.__qualname__, *args)
        if name not in _held:
            _held.clear()
            pa.default_memory_pool().release_unused()
            _held[name] = make(*args)
        return _held[name]
    return held


def with_uid(df: DataFrame, name: str = "uid") -> DataFrame:
    """``df`` stored with a unique number per row; ids of the data may be null or repeated."""
    return pin(df.withColumn(name, F.monotonically_increasing_id()))


def free_prefix(df: DataFrame) -> str:
    """A beginning that no column name of ``df`` has, for helper columns beside any others."""
    prefix = "_h"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "h"
    return prefix


def stratum(uid: str | Column, n: int) -> Column:
    """A number in [0, n) that deals rows evenly, whatever their values."""
    return F.pmod(F.xxhash64(uid), F.lit(n)).cast("int")


def runs(batches: Batches, key: str) -> Iterator[pa.RecordBatch]:
    """One record batch per run of equal ``key`` in input that is sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts = [0, *cuts.tolist()]
        ends = [*cuts.tolist(), len(keys)]
        for start, end in zip(starts, ends):
            if held and keys[start] != last:
                yield _whole(held)
                held = []
            last = keys[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield _whole(held)


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def map_runs(df: DataFrame, key: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
             schema: str) -> DataFrame:
    """``fn`` over the rows of each ``key`` (a BIGINT), many keys per task and no call per group.

    ``fn`` returns a batch with the columns of ``schema`` or None. Groups must be bounded:
    see :func:`chunk_pairs`.
    """
    def run(batches):
        for group in runs(batches, key):
            out = fn(group)
            if out is not None and out.num_rows:
                yield out
    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def chunk_pairs(df: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """Split groups of over ``most`` rows into pairs of chunks.

    Adds ``bucket`` (BIGINT, the new group), ``side`` (the row's chunk) and ``within`` (whether
    the group holds a single chunk). Every two rows of a group meet in exactly one bucket that
    compares them: inside a chunk where ``within``, else across two sides.
    """
    hot = pin(df.groupBy(key).count().filter(F.col("count") > most)
              .select(key, F.ceil(F.col("count") / most).cast("int").alias("_n")))
    # The stored table has a known size, so the planner broadcasts it only while it is small.
    rows = df.join(hot, key, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    rows = rows.withColumn("side", F.pmod(F.xxhash64(member, F.lit(7)), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low, high = F.least("side", "_other"), F.greatest("side", "_other")
    return (rows.withColumn("within", low == high)
            .withColumn("bucket", F.when(F.col("_n") == 1, F.xxhash64(key))
                        .otherwise(F.xxhash64(key, low, high)))
            .drop("_n", "_other"))


def attach(df: DataFrame, facts: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Left join of one row per ``key``; a key with a third of ``df`` is dealt over ``salts``.

    The salt is a hash of the row, and only the salts that a key really has in ``df`` are made on
    the side of ``facts``. NULL keys find nothing and stay spread. ``df`` is read twice.
    """
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    wanted = dealt.filter(F.col(key).isNotNull()).select(key, "_salt").distinct()
    return dealt.join(wanted.join(facts, key), [key, "_salt"], "left").drop("_salt")


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column that are usable vectors: (positions, float64 matrix).

    Usable: not null, not empty, no null or non-finite component, not zero, and as long as
    most vectors of the batch. Components keep their stored precision.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array([0 if n is None else n for n in
                        column.value_lengths().to_pylist()], dtype=np.int64)
    if not lengths.any():
        return np.empty(0, np.int64), np.empty((0, 0))
    width = int(np.bincount(lengths[lengths > 0]).argmax())
    at = np.flatnonzero(lengths == width)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    rows = np.asarray(flat, dtype=np.float64).reshape(len(at), width)
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return at[good], rows[good]
