"""Scalar column functions. Every one is a native expression, so it stays inside codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostwin.schemas import DAY_SECONDS, NULL_TOKENS

# Texts that count as numbers. The JVM alone would also take "1d", "1f" and hexadecimals.
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def null_tokens(df: DataFrame, cols: Iterable[str] | None = None,
                tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Replace the texts that mean "missing" by NULL, by default in every text column."""
    chosen = {n for n, t in df.dtypes if t == "string"} if cols is None else set(cols)
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in tokens)
    return map_columns(df, {
        c: f"case when `{c}` not in ({listed}) then `{c}` end" for c in chosen})


def to_num(c: Column) -> Column:
    """Text to DOUBLE, NULL where it is not a number."""
    # Whole numbers are the common case and need no pattern.
    return F.coalesce(c.try_cast("bigint").cast("double"),
                      F.when(c.rlike(_NUMBER), c.try_cast("double")))


def to_int(c: Column) -> Column:
    """Text to BIGINT; "7.0" and "1e3" count as integers, "1.5" gives NULL."""
    d = c.try_cast("decimal(38,18)")
    return F.coalesce(c.try_cast("bigint"), F.when(d == F.floor(d), d.try_cast("bigint")))


def to_floor(c: Column) -> Column:
    """Text to BIGINT, dropping a fraction."""
    return F.coalesce(c.try_cast("bigint"),
                      F.floor(c.try_cast("decimal(38,18)")).try_cast("bigint"))


def window_floor(c: Column, width: int) -> Column:
    """Start of the window of ``width`` seconds that holds ``c``."""
    return c - F.pmod(c, F.lit(width).cast("bigint"))


def day_id(c: Column) -> Column:
    """Day number, counted from 0."""
    return (window_floor(c, DAY_SECONDS) / F.lit(DAY_SECONDS)).cast("bigint")


def flag(c: Column, value) -> Column:
    """1 where ``c`` equals ``value``, else 0 (also for NULL)."""
    return F.when(c == value, 1).otherwise(0)


def flag_other(c: Column, known: list[str]) -> Column:
    """1 where ``c`` is present and none of ``known``."""
    return F.when(c.isNotNull() & ~c.isin(known), 1).otherwise(0)


def flag_contains(c: Column, text: str) -> Column:
    """1 where ``c`` contains ``text``, else 0 (also for NULL)."""
    return F.when(F.contains(c, F.lit(text)), 1).otherwise(0)


def port_flags(c: Column) -> dict[str, Column]:
    """Well-known / 80 / 443 flags of a port text; non-numeric ports give 0."""
    port = to_num(c)
    return {
        "wellknown_dst_flows": F.when(port <= 1024, 1).otherwise(0),
        "http80_flows": flag(port, 80),
        "https443_flows": flag(port, 443),
    }


def safe_ratio(n: Column, d: Column) -> Column:
    """``n / d`` as DOUBLE, 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def clean_inf(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Replace infinities and NaN by NULL."""
    finite = "case when not isnan(`{0}`) and abs(`{0}`) <> double('Infinity') then `{0}` end"
    return map_columns(df, {c: finite.format(c) for c in cols})


def map_columns(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Replace columns by SQL expressions, keeping the others and the order.

    One call for any number of columns: wide tables would otherwise need thousands.
    """
    return df.selectExpr(*[f"{texts[c]} as `{c}`" if c in texts else f"`{c}`"
                           for c in df.columns])


def drop_unparseable(df: DataFrame, *cols: str) -> DataFrame:
    """Drop rows whose ``cols`` are not whole numbers; the others become BIGINT."""
    parsed = df.withColumns({c: F.col(c).cast("string").try_cast("bigint") for c in cols})
    return parsed.na.drop(subset=list(cols))


def filter_days(df: DataFrame, days: list[int], column: str = "day") -> DataFrame:
    """Rows whose day is listed."""
    return df.filter(F.col(column).isin(days))


def apply_threshold(df: DataFrame, threshold: float, score: str = "score",
                    pred: str = "pred") -> DataFrame:
    """Class 1 where the score reaches the threshold."""
    return df.withColumn(pred, (F.col(score) >= F.lit(threshold)).cast("int"))


def anomaly_to_label(c: Column) -> Column:
    """Detector output -1 (outlier) becomes class 1, everything else class 0."""
    return flag(c, -1)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every DOUBLE column, for display."""
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(*[
        F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns
    ])


def hash_long(*parts) -> Column:
    """A repeatable number in [0, 2**52), drawn from the text of ``parts`` joined by ':'."""
    text = F.concat_ws(":", *[
        (p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """A repeatable number in [0, 1), drawn from the text of ``parts``."""
    return hash_long(*parts).cast("double") / F.lit(float(2**52))
