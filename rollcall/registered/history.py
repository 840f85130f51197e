"""Registered queries: month-to-month bases and comparing outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.fixtures import view, views, with_views
from rollcall.operators import history as his
from rollcall.operators import reconcile as rec
from rollcall.registered.matching import mapped_cpf
from rollcall.registered.sql import RG, ST, WATERFALL, ctes, person

COMPARED = ["cpf", "origem_cpf"]


def manual_roster_union(spark, d):
    automatic = mapped_cpf(spark, d).filter("cad_cpf is not null").select("matricula", F.col("cad_cpf").alias("cpf"))
    return his.with_manual_roster(automatic, view(spark, d, "manual_roster"))


def accumulated_base(spark, d):
    return his.accumulate(*views(spark, d, "previous_accumulated", "current_active"))


def inactive_beneficiaries(spark, d):
    return his.inactive(*views(spark, d, "previous_accumulated", "current_active"))


def unique_cpf_accumulated(spark, d):
    return his.unique_cpf(accumulated_base(spark, d))


def unique_cpf_active(spark, d):
    return his.unique_cpf(view(spark, d, "current_active"))


def reconcile_rows(spark, d):
    return rec.compare_rows(*views(spark, d, "output_a", "output_b"), "matricula", COMPARED).select(
        "matricula", "status", "cpf_a", "cpf_b", "origem_cpf_a", "origem_cpf_b"
    )


def reconcile_status(spark, d):
    return rec.compare_status(*views(spark, d, "output_a", "output_b"), "matricula", COMPARED)


def reconcile_columns(spark, d):
    return rec.compare_columns(*views(spark, d, "output_a", "output_b"), "matricula", COMPARED)


def reconcile_cpf_sets(spark, d):
    return rec.compare_key_sets(*views(spark, d, "previous_accumulated", "current_active"), "cpf")


QUERIES = {
    f.__name__: f
    for f in (
        manual_roster_union, accumulated_base, inactive_beneficiaries, unique_cpf_accumulated, unique_cpf_active,
        reconcile_rows, reconcile_status, reconcile_columns, reconcile_cpf_sets,
    )
}

DIGITS = "nullif(regexp_replace(cpf, '[^0-9]', '', 'g'), '')"
ACCUMULATED = f"""acc as (select * from (select *, row_number() over (partition by matricula
    order by {person()} is null, mesano desc, cpf) as rn
  from (select * from previous_accumulated union all select * from current_active)) where rn=1)"""
COMPARISON = """cmp as (select coalesce(a.matricula, b.matricula) as matricula,
    case when b.matricula is null then 'only_a' when a.matricula is null then 'only_b'
      when a.cpf is distinct from b.cpf or a.origem_cpf is distinct from b.origem_cpf then 'differs' else 'same' end as status,
    a.cpf as cpf_a, b.cpf as cpf_b, a.origem_cpf as origem_cpf_a, b.origem_cpf as origem_cpf_b,
    a.matricula is not null and b.matricula is not null as in_both
  from output_a a full outer join output_b b on a.matricula=b.matricula)"""


def _unique(source: str) -> str:
    return f"""select matricula, cpf, mesano from (select *, row_number() over (partition by {person()} order by mesano desc, matricula) as k
      from {source} where {person()} is not null) where k=1"""


SQL = {
    "manual_roster_union": with_views(
        "student registry manual_roster",
        """select matricula, cpf, origem from (select *, row_number() over (partition by matricula order by origem, cpf) as rn
          from (select matricula, cad_cpf as cpf, 'AUTOMATICO' as origem from wf where cad_cpf is not null
            union all select matricula, cpf, 'MANUAL' from manual_roster)) where rn=1""", ctes(ST, RG, WATERFALL)),
    "accumulated_base": with_views(
        "previous_accumulated current_active", "select matricula, cpf, mesano from acc", ACCUMULATED),
    "inactive_beneficiaries": with_views(
        "previous_accumulated current_active",
        """select matricula, cpf, mesano from previous_accumulated p
          where not exists (select 1 from current_active c where c.matricula=p.matricula)"""),
    "unique_cpf_accumulated": with_views("previous_accumulated current_active", _unique("acc"), ACCUMULATED),
    "unique_cpf_active": with_views("current_active", _unique("current_active")),
    "reconcile_rows": with_views(
        "output_a output_b", "select matricula, status, cpf_a, cpf_b, origem_cpf_a, origem_cpf_b from cmp", COMPARISON),
    "reconcile_status": with_views(
        "output_a output_b", "select status, count(*) as linhas from cmp group by status", COMPARISON),
    "reconcile_columns": with_views(
        "output_a output_b",
        """select 'cpf' as coluna, count(*) filter (in_both and cpf_a is distinct from cpf_b) as divergencias from cmp
          union all select 'origem_cpf', count(*) filter (in_both and origem_cpf_a is distinct from origem_cpf_b) from cmp""",
        COMPARISON),
    "reconcile_cpf_sets": with_views(
        "previous_accumulated current_active",
        """select em_comum, somente_a, somente_b, round(em_comum/(em_comum+somente_a), 6) as aderencia from (
          select (select count(*) from (select cpf from a intersect select cpf from b)) as em_comum,
            (select count(*) from (select cpf from a except select cpf from b)) as somente_a,
            (select count(*) from (select cpf from b except select cpf from a)) as somente_b)""",
        f"""a as (select distinct {DIGITS} as cpf from previous_accumulated where {DIGITS} is not null),
          b as (select distinct {DIGITS} as cpf from current_active where {DIGITS} is not null)"""),
}
