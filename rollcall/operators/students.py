"""Student extracts and eligibility from the school tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.period import age_in_years
from rollcall.schema import (
    ACTIVE_SITUATION_NAMES,
    ACTIVE_SITUATIONS,
    AGE_LIMITS,
    DOCUMENT_COLUMNS,
    ENROLMENT_FACT_COLUMNS,
    EXCLUDED_DESIGNATIONS,
    HIGH_SCHOOL_TYPES,
)


def student_base(
    fact: DataFrame,
    classes: DataFrame,
    students: DataFrame,
    columns: Sequence[str] = ENROLMENT_FACT_COLUMNS,
    types: Sequence[str] = HIGH_SCHOOL_TYPES,
) -> DataFrame:
    """Enrolments of the given teaching types with the student's id and name."""
    chosen = classes.filter(F.col("cd_tipo_ensino").isin(*types)).select("nro_int_turma")
    person = students.select(F.col("matricula").alias("chave_contagem_aluno"), "cpf", "nm_aluno")
    wanted = list(dict.fromkeys([*columns, "nro_int_turma", "chave_contagem_aluno"]))
    return (
        fact.select(*wanted)
        .join(chosen, "nro_int_turma")
        .join(person, "chave_contagem_aluno")
        .select("cpf", "nm_aluno", *columns)
    )


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in a stated order, so the same rows come back each time."""
    return df.orderBy(*order).limit(n)


def max_age_allowed(teaching_type: Column, limits: Mapping[str, int] = AGE_LIMITS) -> Column:
    """The age limit of a teaching type; null for types that give no benefit."""
    limit = F.lit(None).cast("int")
    for age in sorted(set(limits.values())):
        limit = F.when(teaching_type.isin(*[t for t, a in limits.items() if a == age]), age).otherwise(limit)
    return limit


def eligible_students(
    enrolments: DataFrame,
    classes: DataFrame,
    calendars: DataFrame,
    schools: DataFrame,
    students: DataFrame,
    ref_date: Column,
    situations: Sequence[int] = ACTIVE_SITUATIONS,
    excluded_designations: Sequence[int] = EXCLUDED_DESIGNATIONS,
    limits: Mapping[str, int] = AGE_LIMITS,
) -> DataFrame:
    """Distinct students with an active enrolment whose teaching type allows their age.

    Calendar and school only filter, so they are semi joins. Each student's enrolments
    collapse to the highest age limit before students are read: someone is eligible by
    some enrolment exactly when their age is within the highest of the limits.
    """
    open_calendars = calendars.filter(ref_date.between(F.col("dt_inicio"), F.col("dt_fim")))
    regular_schools = schools.filter(
        (F.col("in_esc_prisional") != "S") & ~F.col("nro_int_designacao").isin(*excluded_designations)
    )
    typed = classes.select("nro_int_turma", max_age_allowed(F.col("cd_tipo_ensino"), limits).alias("limite"))
    best = (
        enrolments.filter(F.col("nro_int_situacao").isin(*situations))
        .join(open_calendars, "nro_int_calend_estab", "left_semi")
        .join(regular_schools, "idt_estab", "left_semi")
        .join(typed.filter("limite is not null"), "nro_int_turma")
        .groupBy("matricula")
        .agg(F.max("limite").alias("limite"))
    )
    born = students.select("matricula", "dt_nascimento")
    young_enough = age_in_years(ref_date, born["dt_nascimento"]) <= best["limite"]
    return best.join(born, (best["matricula"] == born["matricula"]) & young_enough, "left_semi").select("matricula")


def students_per_school(
    classes: DataFrame,
    enrolments: DataFrame,
    schools: DataFrame,
    situations: DataFrame,
    calendars: DataFrame,
    school_ids: Sequence[int],
    ref_date: Column,
    names: Sequence[str] = ACTIVE_SITUATION_NAMES,
) -> DataFrame:
    """Distinct active students per school, by the calendar of the class.

    Enrolment and situation are required by later conditions, so only the school stays
    an outer join. The distinct count first groups by school and student, so one very
    large school does not end up in one task.
    """
    open_calendars = calendars.filter(ref_date.between(F.col("dt_inicio"), F.col("dt_fim")))
    active = situations.filter(F.col("ds_situacao").isin(*names))
    chosen = (
        classes.filter(F.col("idt_estab").isin(*school_ids))
        .join(open_calendars, "nro_int_calend_estab", "left_semi")
        .select("nro_int_turma", "idt_estab")
    )
    school = schools.select(F.col("idt_estab").alias("escola"), "denominacao")
    return (
        enrolments.join(active, "nro_int_situacao", "left_semi")
        .select("nro_int_turma", "matricula")
        .join(chosen, "nro_int_turma")
        .join(school, F.col("idt_estab") == F.col("escola"), "left")
        .groupBy(F.col("escola").alias("idt_estab"), "denominacao")
        .agg(F.countDistinct("matricula").alias("qtd_alunos"))
        .orderBy(F.desc("qtd_alunos"), "idt_estab")
    )


def student_documents(students: DataFrame, ids: DataFrame) -> DataFrame:
    """Document columns of the students in ``ids`` (any number of them)."""
    return students.join(ids.select("nro_int_aluno_estado"), "nro_int_aluno_estado", "left_semi").select(
        *DOCUMENT_COLUMNS
    ).distinct()


def sorted_ids(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of an id column in ascending order, without nulls."""
    return df.select(column).dropna().distinct().orderBy(column)
