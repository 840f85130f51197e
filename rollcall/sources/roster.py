"""The manual roster kept by support staff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.cpf import cpf_digits


def _roster_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, schema="matricula string, cpf string")


def manual_roster_rejects(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """The lines, as they are, whose enrolment number cannot be read."""
    return _roster_lines(spark, path, sep).filter(F.col("matricula").try_cast("bigint").isNull())


def read_manual_roster(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """(enrolment, id) pairs from a CSV with columns ``matricula`` and ``cpf``.

    Lines without a readable enrolment number are in ``manual_roster_rejects``.
    """
    raw = _roster_lines(spark, path, sep)
    return raw.select(F.col("matricula").try_cast("bigint").alias("matricula"), cpf_digits(F.col("cpf")).alias("cpf")).dropna(
        subset=["matricula"]
    )
