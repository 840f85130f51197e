"""Writing results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = "UTF-8", bom: bool = False) -> str:
    """CSV part files with a header, text kept as it is.

    With ``bom`` each part starts with the UTF-8 byte order mark spreadsheet programs
    look for: the header is the first text of a part, so the mark goes before its name.
    """
    if bom:
        df = df.toDF(BOM + df.columns[0], *df.columns[1:])
    (
        df.write.option("sep", sep)
        .option("header", True)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .mode("overwrite")
        .csv(path)
    )
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_period(df: DataFrame, path: str, period_column: str = "mesano", period: str | None = None) -> str:
    """Parquet partitioned by run period; a rerun replaces only its own periods.

    With ``period`` all rows are of that one period and its folder is written as a whole, so
    a result without rows leaves an empty period, readable with its columns.
    """
    if period is not None:
        df.drop(period_column).write.mode("overwrite").parquet(f"{path}/{period_column}={period}")
        return path
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(period_column)
        .parquet(path)
    )
    return path


def outputs_of_period(spark: SparkSession, path: str, period: str, period_column: str = "mesano") -> DataFrame:
    """The files of one period with their number of rows; other periods are not read."""
    return (
        spark.read.parquet(path)
        .filter(F.col(period_column).cast("string") == period)
        .groupBy(F.col("_metadata.file_path").alias("arquivo"))
        .agg(F.count(F.lit(1)).alias("linhas"))
    )


def write_many(frames: Mapping[str, DataFrame], path: str) -> dict[str, str]:
    """Several named tables under one folder."""
    return {name: write_parquet(df, f"{path}/{name}") for name, df in frames.items()}


def write_lists(frames: list[DataFrame], names: list[str], path: str) -> dict[str, str]:
    """The same from two lists, which must have the same length and distinct names."""
    if len(frames) != len(names) or len(set(names)) != len(names):
        raise ValueError("one distinct name per table is needed")
    return write_many(dict(zip(names, frames)), path)
