"""Train / test splits by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwin.functions.scalars import drop_unparseable
from hostwin.schemas import TEST_DAYS, TRAIN_DAYS
from hostwin.session import pin
from hostwin.sources.tables import write_table


def split_last_days(df: DataFrame, n: int = 7, last_day: int | None = None) -> DataFrame:
    """Add ``split``: the last ``n`` days are "test", the rest "train".

    Pass ``last_day`` when it is known, to spare the pass that finds it.
    """
    if last_day is None:
        last_day = df.agg(F.max("day")).first()[0]
    test = F.col("day") > F.lit(last_day).cast("bigint") - n
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def split_days(df: DataFrame, train: list[int] = TRAIN_DAYS,
               test: list[int] = TEST_DAYS) -> DataFrame:
    """Add ``split`` from two lists of days; other days are dropped, train wins on overlap."""
    if dict(df.dtypes)["day"] != "bigint":
        df = drop_unparseable(df, "day")
    day = F.col("day")
    named = df.withColumn("split", F.when(day.isin(train), "train").when(day.isin(test), "test"))
    return named.filter(F.col("split").isNotNull())


def take(df: DataFrame, part: str) -> DataFrame:
    """One side of a split, without the ``split`` column."""
    return df.filter(F.col("split") == part).drop("split")


def split_and_save(tables: dict[str, DataFrame], path: str, n: int = 7,
                   fmt: str = "parquet") -> dict[str, str]:
    """Last-days split of each table, written as ``path/<table>/split=...``.

    The last day is the table's own. Each table is stored once, since finding the last day, the
    sort and the write all read it. A run replaces what an earlier run wrote.
    """
    written = {}
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        ordered = split_last_days(pin(df), n).orderBy("split", "day", "win", "src_comp")
        write_table(ordered, target, fmt, partition_by=["split"])
        written[name] = target
    return written
