"""Pieces of comparison SQL that several queries share."""

from __future__ import annotations


def std(column: str = "cpf") -> str:
    return f"nullif(regexp_replace({column},'[^0-9]','','g'),'')"


def money(cents: str) -> str:
    return f"concat(cast(cast(floor({cents}/100) as bigint) as string),'.',lpad(cast({cents}%100 as string),2,'0'))"


# one digit eleven times, or only zeros: an id that stands for no person
REPEATED = ", ".join(f"'{str(d) * 11}'" for d in range(10))


def person(column: str = "cpf") -> str:
    digits = std(column)
    return f"(case when not regexp_full_match({digits}, '0+') and {digits} not in ({REPEATED}) then {digits} end)"


ST = f"st as (select *, {person()} as cpf_std from student)"
RG = f"rg as (select *, {person()} as cpf_std from registry)"
NEWEST = "order by dat_atual_fam desc, row_id"
LATEST = f"""latest as (select * from (select *, row_number() over (partition by cpf_std {NEWEST}) as rn from rg)
  where cpf_std is not null and rn=1)"""
WATERFALL = f"""
k1 as (select cpf_std, row_id from rg where cpf_std is not null
  qualify row_number() over (partition by cpf_std {NEWEST})=1),
k2 as (select nome, nome_mae, row_id, cpf_std from rg qualify row_number() over (partition by nome, nome_mae {NEWEST})=1),
k3 as (select nome, dta_nasc, row_id, cpf_std from rg qualify row_number() over (partition by nome, dta_nasc {NEWEST})=1),
wf as (select st.*,
    case when k1.row_id is not null then 'cpf' when k2.row_id is not null then 'nome_mae'
         when k3.row_id is not null then 'nome_nascimento' end as regra,
    coalesce(k1.row_id, k2.row_id, k3.row_id) as cad_row_id,
    case when k1.row_id is not null then k1.cpf_std when k2.row_id is not null then k2.cpf_std
         else k3.cpf_std end as cad_cpf
  from st left join k1 on st.cpf_std=k1.cpf_std
  left join k2 on st.nm_aluno=k2.nome and st.nm_mae=k2.nome_mae
  left join k3 on st.nm_aluno=k3.nome and st.dt_nascimento=k3.dta_nasc)"""


def ctes(*parts: str) -> str:
    return ",\n".join(p.strip() for p in parts)
