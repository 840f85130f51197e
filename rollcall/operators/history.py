"""Bases carried from month to month: one row per enrolment or per person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.cpf import person_cpf
from rollcall.operators.keys import first_per_key


def with_manual_roster(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """Automatic and manual (enrolment, id) pairs; automatic wins per enrolment."""
    both = automatic.withColumn("origem", F.lit("AUTOMATICO")).unionByName(
        manual.withColumn("origem", F.lit("MANUAL")), allowMissingColumns=True
    )
    return first_per_key(both, F.col("matricula"), [F.asc("origem"), F.asc_nulls_last("cpf")])


def accumulate(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row per enrolment over both bases: the newest period that has an id wins."""
    both = previous.unionByName(current, allowMissingColumns=True)
    return first_per_key(both, F.col("matricula"), [person_cpf(F.col("cpf")).isNull(), F.desc("mesano"), F.asc_nulls_last("cpf")])


def inactive(accumulated: DataFrame, active: DataFrame) -> DataFrame:
    """Accumulated enrolments that are not in the active base."""
    return accumulated.join(active.select("matricula"), "matricula", "left_anti")


def unique_cpf(base: DataFrame) -> DataFrame:
    """One row per person id, whatever its punctuation: newest period, then lowest enrolment."""
    return first_per_key(base, person_cpf(F.col("cpf")), [F.desc("mesano"), F.asc("matricula")])


def union_versions(*versions: DataFrame) -> DataFrame:
    """All rows of several files; columns a file lacks become null."""
    result = versions[0]
    for version in versions[1:]:
        result = result.unionByName(version, allowMissingColumns=True)
    return result
