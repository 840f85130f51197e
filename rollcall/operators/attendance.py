"""Monthly attendance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.period import year_month
from rollcall.functions.rates import attendance_ratio, clip_unit, percent_text
from rollcall.schema import HIGH_SCHOOL_TYPES


def attendance_monthly(
    attendance: DataFrame,
    classes: DataFrame,
    years: Sequence[int] | None,
    types: Sequence[str] = HIGH_SCHOOL_TYPES,
) -> DataFrame:
    """Classes, absences and attendance ratio per student and month; ``years`` None for all."""
    if years is not None:
        attendance = attendance.filter(F.col("ano").isin(*years))
    chosen = classes.filter(F.col("cd_tipo_ensino").isin(*types)).select("nro_int_turma")
    totals = (
        attendance.join(chosen, "nro_int_turma")
        .groupBy("matricula", "ano", "mes")
        .agg(
            F.sum("aulas").alias("aulas_totais"),
            F.sum("faltas").alias("faltas_totais"),
            F.sum("faltas_justificadas").alias("faltas_justificadas_totais"),
        )
    )
    ratio = attendance_ratio(
        F.col("aulas_totais"), F.col("faltas_totais"), F.col("faltas_justificadas_totais")
    )
    return totals.withColumn("freq_datalake", ratio)


def format_attendance(monthly: DataFrame, as_percent: bool = False) -> DataFrame:
    """Student, ``YYYY/MM`` and the ratio limited to 0..1, as number or percent text."""
    ratio = clip_unit(F.col("freq_datalake"))
    return monthly.select(
        F.col("matricula").alias("MATRICULA"),
        year_month(F.col("ano"), F.col("mes")).alias("DATA_COMPETENCIA"),
        (percent_text(ratio) if as_percent else ratio).alias("FREQ_DATALAKE"),
    )
