"""The social registry: standard form, income rule, one row per person.

A registry table has ``row_id``, unique in the table, and ``dat_atual_fam``, the update date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.cpf import person_cpf
from rollcall.operators.keys import first_per_key
from rollcall.schema import INCOME_CUT


def latest_first() -> list[Column]:
    """Newest update first, ties by row id."""
    return [F.desc("dat_atual_fam"), F.asc("row_id")]


def with_standard_cpf(df: DataFrame, source: str = "cpf") -> DataFrame:
    """``cpf_std``: digits only, null when there are none or the id stands for no person."""
    return df.withColumn("cpf_std", person_cpf(F.col(source)))


def income_filter(registry: DataFrame, cut: float = INCOME_CUT, column: str = "renda_media") -> DataFrame:
    """Rows with family income up to ``cut``; unreadable or missing income drops.

    A numeric column is compared as it is, so the condition reaches the Parquet scan.
    """
    income = F.col(column)
    if dict(registry.dtypes)[column] == "string":
        income = income.try_cast("double")
    return registry.filter(income <= F.lit(cut))


def income_filter_counts(registry: DataFrame, cut: float = INCOME_CUT, column: str = "renda_media") -> DataFrame:
    """Rows before and after the income filter."""
    income = F.col(column).try_cast("double")
    return registry.agg(
        F.count(F.lit(1)).alias("antes"),
        F.count_if(income <= F.lit(cut)).alias("depois"),
        F.count_if(income.isNull()).alias("renda_ilegivel"),
    )


def latest_per_person(registry: DataFrame) -> DataFrame:
    """The newest row of each ``cpf_std``; rows without one are all kept."""
    return first_per_key(registry, F.col("cpf_std"), latest_first(), keep_null=True)


def latest_with_cpf(registry: DataFrame) -> DataFrame:
    """The newest row of each ``cpf_std``, rows without one left out."""
    return first_per_key(registry, F.col("cpf_std"), latest_first())


def cpf_duplicates(registry: DataFrame) -> DataFrame:
    """Ids on more than one row, with the number of rows and the newest update."""
    return (
        registry.filter(F.col("cpf_std").isNotNull())
        .groupBy("cpf_std")
        .agg(F.count(F.lit(1)).alias("linhas"), F.max("dat_atual_fam").alias("ultima_atualizacao"))
        .filter("linhas > 1")
    )


def superseded_rows(registry: DataFrame) -> DataFrame:
    """Rows that ``latest_per_person`` removes.

    Matched back by row id, which is unique, so a hot person spreads over all tasks.
    """
    return registry.join(latest_per_person(registry).select("row_id"), "row_id", "left_anti")
