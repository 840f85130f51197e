"""Registered queries: student extracts, eligibility, attendance."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.fixtures import ATTENDANCE_YEARS, REF_DATE, SCHOOL_IDS, view, views, with_views
from rollcall.operators import attendance as att
from rollcall.operators import students as stu
from rollcall.schema import (
    ACTIVE_SITUATION_NAMES,
    ACTIVE_SITUATIONS,
    AGE_LIMITS,
    ENROLMENT_FACT_COLUMNS,
    EXCLUDED_DESIGNATIONS,
    HIGH_SCHOOL_TYPES,
)
from rollcall.sources.lake import lake_query

# Columns of the two narrower student extracts.
NARROW_COLUMNS = [
    "idt_estab", "nro_int_curso", "nro_int_turma", "ano_base", "data_referencia", "in_bolsa_familia",
    "in_tjne", "idade", "in_distorcao_idade", "chave_contagem_aluno",
]
MINIMAL_COLUMNS = ["idt_estab", "in_bolsa_familia"]
BASE_VIEWS = ("enrolment_fact", "school_class", "student")


def _listed(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


HIGH_SCHOOL_CLASSES = f"(select nro_int_turma from school_class where cd_tipo_ensino in ({_listed(HIGH_SCHOOL_TYPES)}))"


def _base_sql(columns: list[str]) -> str:
    facts = ", ".join(f"f.{c}" for c in columns)
    return with_views(
        "enrolment_fact school_class student",
        f"""select person.cpf, person.nm_aluno, {facts}
          from student person, enrolment_fact f
          where f.chave_contagem_aluno = person.matricula and f.nro_int_turma in {HIGH_SCHOOL_CLASSES}""",
    )


def student_base(spark, d):
    return stu.student_base(*views(spark, d, *BASE_VIEWS))


def student_base_narrow(spark, d):
    return stu.student_base(*views(spark, d, *BASE_VIEWS), columns=NARROW_COLUMNS)


def student_base_minimal(spark, d):
    return stu.student_base(*views(spark, d, *BASE_VIEWS), columns=MINIMAL_COLUMNS)


def _eligible(spark, d, ref_date):
    names = ("enrolment", "school_class", "school_calendar", "school", "student")
    return stu.eligible_students(*views(spark, d, *names), ref_date)


def eligible_students(spark, d):
    return _eligible(spark, d, F.lit(REF_DATE).cast("date"))


def eligible_students_param(spark, d):
    # The run's reference date as a one-row table: two months after the last calendar opens.
    param = view(spark, d, "school_calendar").agg(F.max("dt_inicio").alias("inicio"))
    return _eligible(spark, d, param.select(F.date_sub("inicio", 60)).scalar())


def _eligible_sql(ref_date: str) -> str:
    limits = ", ".join(f"('{kind}', {age})" for kind, age in AGE_LIMITS.items())
    return with_views(
        "enrolment school_class school_calendar school student",
        f"""select matricula from student natural join highest
          where trunc(date_diff('day', dt_nascimento, {ref_date}) / 365.25) <= idade_maxima""",
        f"""limits(tipo, idade) as (values {limits}),
          highest as (
            select x.matricula, max(limits.idade) as idade_maxima
            from limits, school_class k, enrolment x
            where k.cd_tipo_ensino = limits.tipo and x.nro_int_turma = k.nro_int_turma
              and x.nro_int_situacao in ({_listed(ACTIVE_SITUATIONS)})
              and exists (from school_calendar where nro_int_calend_estab = x.nro_int_calend_estab
                          and dt_inicio <= {ref_date} and dt_fim >= {ref_date})
              and exists (from school where idt_estab = x.idt_estab and in_esc_prisional != 'S'
                          and nro_int_designacao not in ({_listed(EXCLUDED_DESIGNATIONS)}))
            group by x.matricula)""",
    )


def students_per_school(spark, d):
    names = ("school_class", "enrolment", "school", "situation", "school_calendar")
    return stu.students_per_school(*views(spark, d, *names), SCHOOL_IDS, F.lit(REF_DATE).cast("date"))


def _documents(spark, d):
    return view(spark, d, "student").withColumnsRenamed(
        {"matricula": "nro_int_aluno_estado", "nm_aluno": "nm_aluno_puro", "nm_mae": "nm_mae_puro", "nm_pai": "nm_pai_puro"}
    )


def student_documents(spark, d):
    ids = eligible_students(spark, d).withColumnRenamed("matricula", "nro_int_aluno_estado")
    return stu.student_documents(_documents(spark, d), ids)


def student_ids_sorted(spark, d):
    return stu.sorted_ids(view(spark, d, "enrolment"), "matricula")


def lake_query_result(spark, d):
    classes, enrolments = views(spark, d, "school_class", "enrolment")
    sql = """select t.cd_tipo_ensino, count(distinct e.matricula) as alunos, count(*) as matriculas
      from {enrolments} e join {classes} t on t.nro_int_turma = e.nro_int_turma group by t.cd_tipo_ensino"""
    return lake_query(spark, sql, classes=classes, enrolments=enrolments)


def attendance_monthly(spark, d):
    return att.attendance_monthly(*views(spark, d, "attendance", "school_class"), ATTENDANCE_YEARS)


def attendance_all_years(spark, d):
    return att.attendance_monthly(*views(spark, d, "attendance", "school_class"), None)


def attendance_formatted(spark, d):
    return att.format_attendance(attendance_monthly(spark, d))


def attendance_percent(spark, d):
    return att.format_attendance(attendance_monthly(spark, d), as_percent=True)


def _monthly_sql(condition: str) -> str:
    return f"""counted as (
        select matricula, ano, mes, sum(aulas) as dadas, sum(faltas) as perdidas, sum(faltas_justificadas) as justificadas
        from attendance where nro_int_turma in {HIGH_SCHOOL_CLASSES} and {condition} group by all),
      monthly as (
        select matricula, ano, mes, dadas::bigint as aulas_totais, perdidas::bigint as faltas_totais,
          justificadas::bigint as faltas_justificadas_totais,
          round(1 - (perdidas - justificadas) / nullif(dadas, 0)::double, 7) as freq_datalake
        from counted)"""


SELECTED_YEARS = _monthly_sql(f"ano in ({_listed(ATTENDANCE_YEARS)})")


def _formatted_sql(value: str) -> str:
    return with_views(
        "attendance school_class",
        f"""select matricula as "MATRICULA", concat(cast(ano as string),'/',lpad(cast(mes as string),2,'0'))
          as "DATA_COMPETENCIA", {value} as "FREQ_DATALAKE"
          from (select *, case when freq_datalake is not null then greatest(0.0, least(1.0, freq_datalake)) end as f
                from monthly)""",
        SELECTED_YEARS,
    )


QUERIES = {
    "student_base": student_base,
    "student_base_narrow": student_base_narrow,
    "student_base_minimal": student_base_minimal,
    "eligible_students": eligible_students,
    "eligible_students_param": eligible_students_param,
    "students_per_school": students_per_school,
    "student_documents": student_documents,
    "student_ids_sorted": student_ids_sorted,
    "lake_query": lake_query_result,
    "attendance_monthly": attendance_monthly,
    "attendance_all_years": attendance_all_years,
    "attendance_formatted": attendance_formatted,
    "attendance_percent": attendance_percent,
}

_ELIGIBLE = _eligible_sql(f"date '{REF_DATE}'")

SQL = {
    "student_base": _base_sql(ENROLMENT_FACT_COLUMNS),
    "student_base_narrow": _base_sql(NARROW_COLUMNS),
    "student_base_minimal": _base_sql(MINIMAL_COLUMNS),
    "eligible_students": _ELIGIBLE,
    "eligible_students_param": _eligible_sql(
        "(select cast(max(dt_inicio) - 60 as date) from school_calendar)"
    ),
    "students_per_school": with_views(
        "school_class enrolment school situation school_calendar",
        """select school.idt_estab, denominacao, count(distinct matricula) as qtd_alunos
          from pupils left join school on school.idt_estab = pupils.estab
          group by all order by qtd_alunos desc, school.idt_estab""",
        f"""pupils as (
            select distinct k.idt_estab as estab, x.matricula from enrolment x, school_class k
            where x.nro_int_turma = k.nro_int_turma and k.idt_estab in ({_listed(SCHOOL_IDS)})
              and exists (from situation where nro_int_situacao = x.nro_int_situacao
                          and ds_situacao in ({_listed(ACTIVE_SITUATION_NAMES)}))
              and exists (from school_calendar where nro_int_calend_estab = k.nro_int_calend_estab
                          and dt_inicio <= date '{REF_DATE}' and dt_fim >= date '{REF_DATE}'))""",
    ),
    "student_documents": with_views(
        "enrolment school_class school_calendar school student",
        f"""select distinct matricula as nro_int_aluno_estado, nm_aluno as nm_aluno_puro, dt_nascimento, cpf, cpf_pai,
          cpf_mae, cpf_responsavel, nm_mae as nm_mae_puro, nr_ident_mae, nm_pai as nm_pai_puro, nr_ident_pai,
          nr_doc_mae, nr_doc_pai from student where matricula in (select matricula from ids)""",
        f"ids as ({_ELIGIBLE})",
    ),
    "student_ids_sorted": with_views("enrolment", "select distinct matricula from enrolment order by matricula"),
    "lake_query": with_views(
        "enrolment school_class",
        """select t.cd_tipo_ensino, count(distinct e.matricula) as alunos, count(*) as matriculas
          from enrolment e join school_class t on t.nro_int_turma=e.nro_int_turma group by t.cd_tipo_ensino""",
    ),
    "attendance_monthly": with_views("attendance school_class", "select * from monthly", SELECTED_YEARS),
    "attendance_all_years": with_views("attendance school_class", "select * from monthly", _monthly_sql("true")),
    "attendance_formatted": _formatted_sql("f"),
    "attendance_percent": _formatted_sql(
        "case when f is not null then concat(cast(cast(ceil(100*f) as bigint) as string),'%') end"
    ),
}
