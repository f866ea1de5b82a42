"""Raw log scans, feature-table scans and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwin.functions.scalars import null_tokens
from hostwin.schemas import LOG_COLUMNS, XDR_COLUMNS, log_schema, master_schema


def read_log(spark: SparkSession, kind: str, path: str | list[str],
             clean: bool = True) -> DataFrame:
    """Headerless CSV scan of one raw log; plain or compressed text.

    ``clean`` turns the texts that mean "missing" into NULL. Plain text is split freely; a
    gzip file is always one task, so deliver large logs as many gzip files.
    """
    reader = spark.read.schema(log_schema(kind)).option("escape", '"')
    df = reader.csv(path)
    return null_tokens(df) if clean else df


def read_logs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """All five raw logs, after a check that they exist."""
    check_inputs(spark, paths)
    return {kind: read_log(spark, kind, path) for kind, path in paths.items()}


def check_inputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """Raise FileNotFoundError that names the first missing log."""
    for kind in LOG_COLUMNS:
        if kind not in paths:
            raise FileNotFoundError(f"no path given for log '{kind}'")
        try:
            spark.read.text(paths[kind])
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                raise FileNotFoundError(f"missing file: {paths[kind]}") from error
            raise


def read_master(spark: SparkSession, path: str, fmt: str = "parquet",
                columns: list[str] | None = None,
                file_columns: list[str] | None = None) -> DataFrame:
    """A feature table, optionally only some columns.

    The types of a CSV file follow from its column names, so that no inference pass over the
    data is needed; ``file_columns`` gives the names without even reading the header. The columns of a
    file with other names are read as text first and then :func:`narrowed`, in one pass over the columns asked for.
    """
    if fmt == "csv":
        reader = spark.read.option("header", True).option("escape", '"')
        names = file_columns or reader.csv(path).columns
        if set(names) <= set(XDR_COLUMNS):
            reader = reader.schema(master_schema(names)).option("enforceSchema", False)
        else:
            texts = reader.csv(path)
            return narrowed(texts.select(*columns) if columns else texts)
        df = reader.csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one text row each: (path, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a table; ``mode="append"`` adds to an existing one."""
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_days(df: DataFrame, path: str, by: str = "day", fmt: str = "parquet") -> None:
    """Write a table by day so that a repeated day replaces itself and all other days stay.

    Only the folders of days that ``df`` has are exchanged, at the end of the job; a job that fails
    changes nothing.
    """
    df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).save(path)


def narrowed(df: DataFrame) -> DataFrame:
    """Text columns as the narrowest type that every value can be read as: BIGINT, DOUBLE, BOOLEAN or text.

    One pass over the rows decides for all columns. Blanks around a value do not matter and empty values are
    missing; a column without values stays text.
    """
    text = [n for n, t in df.dtypes if t == "string"]
    if not text:
        return df
    trimmed = {n: f"nullif(trim(`{n}`), '')" for n in text}
    kinds = ["bigint", "double", "boolean"]
    whole = df.agg(*[F.expr(f"struct(count({v}) as n, " + ", ".join(
        f"count(try_cast({v} as {k})) as `{k}`" for k in kinds) + ")").alias(n) for n, v in trimmed.items()]).first()
    kind = {n: next((k for k in kinds if 0 < whole[n]["n"] == whole[n][k]), "string") for n in text}
    return df.select(*[F.expr(f"try_cast({trimmed[n]} as {kind[n]})").alias(n) if kind.get(n, "string") != "string"
                       else F.col(f"`{n}`") for n in df.columns])


def write_split(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Train and test rows in one pass, one folder per value of ``split``."""
    write_table(df, path, fmt, partition_by=["split"])


def write_sorted(df: DataFrame, path: str, order: list[str], fmt: str = "parquet") -> None:
    """A file set in global order: the order of the part files is the order of the rows."""
    write_table(df.orderBy(*order), path, fmt)
