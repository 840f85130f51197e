"""Domain tables derived from the given test tables (see FIXTURES.md).

Each view is one SELECT in the common subset of Spark SQL and DuckDB SQL, so the same
text feeds the Spark queries and the comparison SQL. ``{name}`` stands for a given table
or another view. All views are projections whose group sizes stay bounded when the
tables grow: more rows mean more persons, classes and families, not larger ones.
"""

from __future__ import annotations

import re
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

REF_DATE = "2025-07-31"
PERIOD = "202507"
ATTENDANCE_YEARS = (1999, 2000, 2001)
SCHOOL_IDS = tuple(range(1, 11))


def _cpf(key: str) -> str:
    """Every fifth person carries the id of another one."""
    return f"lpad(cast({key} - case when {key}%5=4 then 4 else 0 end as string),11,'0')"


VIEWS = {
    "student": f"""
        select matricula, nm_aluno, nm_mae, dt_nascimento, cd_munic,
          case when matricula%11=0 then null
               when matricula%13=0 then '---'
               when matricula%37=0 then '000.000.000-00'
               when matricula%41=0 then '11111111111'
               when matricula%3=0 then concat(substring(id,1,9),'-',substring(id,10,2))
               else id end as cpf,
          case when matricula%4=0 then null else lpad(cast(matricula+700 as string),11,'0') end as cpf_pai,
          lpad(cast(matricula+800 as string),11,'0') as cpf_mae,
          case when matricula%2=0 then lpad(cast(matricula+800 as string),11,'0') else null end as cpf_responsavel,
          concat('PAI ',cast(matricula%89 as string)) as nm_pai,
          cast(matricula*3 as string) as nr_ident_mae, cast(matricula*5 as string) as nr_ident_pai,
          cast(matricula*7 as string) as nr_doc_mae, cast(matricula*9 as string) as nr_doc_pai
        from (select c_custkey as matricula, upper(c_name) as nm_aluno, {_cpf('c_custkey')} as id,
                concat('MAE ',cast(c_custkey%97 as string)) as nm_mae,
                date '1996-01-01' + cast((c_custkey*37)%7300 as int) as dt_nascimento,
                cast(c_nationkey as int) as cd_munic
              from {{customer}}) c""",
    "enrolment": """
        select o_custkey as matricula, cast(floor(o_orderkey*2/15) as bigint) as nro_int_turma,
          cast(o_orderkey%9 as int) as nro_int_situacao, o_custkey%25 as nro_int_calend_estab,
          cast(floor(o_custkey/15) as bigint) as idt_estab
        from {orders}""",
    "enrolment_fact": """
        select cast(2020+o_orderkey%6 as int) as ano_base, cast(o_orderdate as date) as data_referencia,
          cast(floor(o_custkey/15) as bigint) as idt_estab, cast(o_orderkey%40 as int) as nro_int_curso,
          cast(floor(o_orderkey*2/15) as bigint) as nro_int_turma,
          concat('T',cast(o_orderkey%30 as string)) as cd_turma,
          concat('T',lpad(cast(o_orderkey%30 as string),3,'0')) as cd_turma_normalizado,
          cast(floor(o_orderkey*2/15) as bigint) as chave_contagem_turma,
          cast(o_orderkey%5 as int) as chave_tpo_ensino,
          case o_orderkey%3 when 0 then 'M' when 1 then 'T' else 'N' end as turno,
          case when o_custkey%4=0 then 'S' else 'N' end as in_bolsa_familia,
          case when o_custkey%6=0 then 'S' else 'N' end as in_tjne,
          case when o_custkey%2=0 then 'F' else 'M' end as cd_sexo,
          concat('R',cast(o_custkey%5 as string)) as ds_raca,
          case when o_custkey%50=0 then 'S' else 'N' end as in_autodeclarado_quilombola,
          cast(14+o_custkey%15 as int) as idade, cast(o_custkey%12 as int) as nro_int_neces_esp,
          cast(15 as int) as idade_inicial_serie, cast(18 as int) as idade_final_serie,
          case when 14+o_custkey%15>18 then 'S' else 'N' end as in_distorcao_idade,
          o_orderkey as chave_contagem_matricula, o_custkey as chave_contagem_aluno
        from {orders}""",
    "school_class": """
        select p_partkey as nro_int_turma,
          case p_size%5 when 0 then 'I2' when 1 then 'E2' when 2 then 'R2' when 3 then 'S2' else 'E9' end
            as cd_tipo_ensino,
          cast(floor(p_partkey/20) as bigint) as idt_estab, p_partkey%25 as nro_int_calend_estab
        from {part}""",
    "school": """
        select s_suppkey as idt_estab, s_name as denominacao,
          case when s_suppkey%17=0 then null when s_suppkey%10=0 then 'S' else 'N' end as in_esc_prisional,
          cast(s_nationkey as int) as nro_int_designacao, cast(4300000+s_nationkey as int) as cd_munic_ibge
        from {supplier}""",
    "school_calendar": """
        select cast(n_nationkey as bigint) as nro_int_calend_estab,
          date '2025-02-01' + cast(n_nationkey*10 as int) as dt_inicio,
          date '2025-06-01' + cast(n_nationkey*10 as int) as dt_fim
        from {nation}""",
    "situation": """
        select cast(n_nationkey as int) as nro_int_situacao,
          case n_nationkey when 1 then 'Matriculado' when 8 then 'Infrequente'
            else concat('Outro ',cast(n_nationkey as string)) end as ds_situacao
        from {nation} where n_nationkey < 9""",
    "attendance": """
        select cast(floor(l_orderkey/10) as bigint) as matricula, l_partkey as nro_int_turma,
          cast(year(l_shipdate) as int) as ano, cast(month(l_shipdate) as int) as mes,
          cast(l_quantity as int)-1 as aulas, cast(l_linenumber as int) as faltas,
          cast(round(l_tax*50) as int) as faltas_justificadas
        from {lineitem}""",
    "registry": f"""
        select o_orderkey as row_id,
          case when o_custkey%19=0 then '' when o_custkey%37=0 then '00000000000' else {_cpf('o_custkey')} end as cpf,
          concat('CUSTOMER#',lpad(cast(o_custkey as string),9,'0')) as nome,
          lpad(cast(o_orderkey as string),11,'0') as nis,
          case when o_custkey%5=0 then 'MAE X' else concat('MAE ',cast(o_custkey%97 as string)) end as nome_mae,
          concat('PAI ',cast(o_custkey%89 as string)) as nome_pai,
          cast(o_custkey*11 as string) as rg,
          date '1996-01-01' + cast((o_custkey*37)%7300 as int)
            + cast(case when o_custkey%23=0 then 1 else 0 end as int) as dta_nasc,
          cast(cast(floor(o_custkey/4) as bigint) as string) as cod_fam,
          cast(1+o_orderkey%3 as int) as cod_parentesco,
          cast(floor(o_totalprice/4) as bigint) as renda_centavos,
          cast(cast(floor(o_totalprice/4) as bigint) as double)/100 as renda_media,
          cast(o_orderdate as date) as dat_atual_fam,
          case o_custkey%3 when 0 then 'Jardim Botânico' when 1 then 'Três Vendas' else 'Centro' end as bairro,
          case o_orderkey%3 when 0 then 'RUA' when 1 then 'AVENIDA' else null end as tipo_end,
          case when o_orderkey%7=0 then 'DOUTOR' else null end as titulo_end,
          o_orderpriority as nome_end, cast(o_orderkey%999 as string) as num_end,
          case when o_orderkey%4=0 then concat('APTO ',cast(o_orderkey%50 as string)) else null end as complem_1,
          case when o_orderkey%6=0 then concat('BLOCO ',cast(o_orderkey%7 as string)) else null end as complem_2,
          lpad(cast((o_orderkey*7)%100000000 as string),8,'0') as cep,
          cast(4300000+o_custkey%500 as string) as cd_ibge, '51' as ddd_contato1,
          lpad(cast((o_orderkey*13)%1000000000 as string),9,'0') as num_tel_contato1,
          case when o_orderkey%5=0 then '54' else null end as ddd_contato2,
          case when o_orderkey%5=0 then lpad(cast((o_orderkey*17)%1000000000 as string),9,'0') else null end
            as num_tel_contato2,
          cast(1+o_orderkey%4 as string) as fx_rfpc,
          case when o_custkey%2=0 then '1' else '0' end as marc_pbf,
          cast(1+o_custkey%9 as string) as grau_instrucao
        from {{orders}}""",
    "manual_roster": """
        select c_custkey as matricula, lpad(cast(c_custkey+1 as string),11,'0') as cpf
        from {customer} where c_custkey%7=0""",
    "previous_accumulated": """
        select o_custkey as matricula,
          case when o_custkey%29=0 then null else lpad(cast(cast(floor(max(o_orderkey)/10) as bigint) as string),11,'0') end as cpf,
          '202506' as mesano
        from {orders} where cast(o_orderdate as date) < date '1999-01-01' group by o_custkey""",
    "current_active": """
        select matricula, replace(cpf,'-','') as cpf, '202507' as mesano
        from {student} where matricula%4<>0 and cpf is not null and cpf<>'---'""",
    "output_a": """
        select matricula, lpad(cast(matricula as string),11,'0') as cpf, 'PROPRIO' as origem_cpf
        from {student} where matricula%10<>0""",
    "output_b": """
        select matricula, lpad(cast(matricula as string),11,'0') as cpf,
          case when matricula%50=1 then 'RESPONSAVEL' else 'PROPRIO' end as origem_cpf
        from {student} where matricula%12<>0""",
}


def _inputs(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


_KNOWN: WeakKeyDictionary[SparkSession, dict[tuple[str, str], DataFrame]] = WeakKeyDictionary()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of the derived views, its plan built once per session."""
    known = _KNOWN.setdefault(spark, {})
    if (sf_dir, name) not in known:
        if name in VIEWS:
            sql = VIEWS[name]
            df = spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _inputs(sql)})
        else:
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        known[sf_dir, name] = df
    return known[sf_dir, name]


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


def with_views(names: str | list[str], body: str, extra: str = "") -> str:
    """Comparison SQL: the named views as CTEs, then ``extra`` CTEs, then the query."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for needed in _inputs(VIEWS[name]):
                add(needed)
            order.append(name)

    for name in names.split() if isinstance(names, str) else names:
        add(name)
    ctes = [f"{n} as ({re.sub(r'[{}]', '', VIEWS[n]).strip()})" for n in order]
    if extra:
        ctes.append(extra.strip().rstrip(","))
    return "with " + ",\n".join(ctes) + "\n" + body.strip()
