"""Registered queries: registry, ids, matching."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rollcall.fixtures import view, views, with_views
from rollcall.functions import cpf as cpf_fn
from rollcall.functions.period import period_last_day
from rollcall.functions.text import normalise_name
from rollcall.operators import layout, matching
from rollcall.operators import registry as reg
from rollcall.operators.columns import ensure_standard_cpf
from rollcall.registered.sql import LATEST, RG, ST, WATERFALL, ctes, person, std
from rollcall.schema import INCOME_CUT
from rollcall.sources.registry_by_id import store_by_id
from rollcall.workdir import fresh_path, settle


def students(spark, d):
    return reg.with_standard_cpf(view(spark, d, "student"))


def registry(spark, d):
    return reg.with_standard_cpf(view(spark, d, "registry"))


def eligible_registry(spark, d):
    return reg.income_filter(registry(spark, d))


# --- ids, names, periods -------------------------------------------------------------

def cpf_digits(spark, d):
    return view(spark, d, "student").select("matricula", cpf_fn.cpf_digits(F.col("cpf")).alias("cpf_std"))


def cpf_trim(spark, d):
    padded = view(spark, d, "student").select("matricula", F.concat(F.lit(" "), "cpf", F.lit("  ")).alias("cpf"))
    return padded.select("matricula", cpf_fn.cpf_trimmed(F.col("cpf")).alias("cpf"))


def cpf_canonical(spark, d):
    # Ids that lost their leading zeros, as a numeric read would leave them.
    short = view(spark, d, "student").select("matricula", F.regexp_replace("cpf", "^0+", "").alias("cpf"))
    return short.select("matricula", cpf_fn.cpf_canonical(F.col("cpf")).alias("cpf"))


# Ids with every kind of fault; in 00000000mcc the check digits cc of a one-digit m are known,
# in hundreds of persons m = matricula % 10 is the ninth digit.
QUALITY_INPUT = """select matricula, case cast(floor(matricula/10) as bigint)%10
    when 0 then concat('00000000', cast(matricula%10 as string),
      case matricula%10 when 1 then '91' when 2 then '72' when 3 then '53' when 4 then '34' when 5 then '15'
        when 6 then '04' when 7 then '87' when 8 then '68' when 9 then '49' else '00' end)
    when 1 then substring(id,1,8) when 2 then concat(id,'0000') when 3 then '000.000.000-00' when 4 then '11111111111'
    when 5 then concat('000 000 00', cast(matricula%10 as string), '-',
      case matricula%10 when 1 then '91' when 2 then '72' when 3 then '53' else '00' end)
    when 6 then concat('000.000.00', cast(matricula%10 as string), '-',
      case matricula%10 when 1 then '91' when 2 then '72' when 3 then '53' else '00' end)
    else cpf end as cpf
  from (select matricula, cpf, lpad(cast((matricula*7919+1)%100000000000 as string),11,'0') as id from {student}) s"""


def cpf_quality(spark, d):
    return cpf_fn.with_cpf_quality(spark.sql(QUALITY_INPUT, student=view(spark, d, "student")), "cpf")


def cpf_quality_counts(spark, d):
    return cpf_quality(spark, d).groupBy("qualidade").agg(F.count(F.lit(1)).alias("linhas"))


def name_normalise(spark, d):
    raw = F.concat(F.lit("  José  da "), F.lower("c_name"), F.lit("\t Conceição Müller "))
    return view(spark, d, "customer").select("c_custkey", normalise_name(raw).alias("nome"))


PERIOD_INPUT = """select o_orderkey, case when o_orderkey%50=0 then '202513' when o_orderkey%50=1 then '20251'
  when o_orderkey%50=2 then null else concat(cast(year(o_orderdate) as string),
  lpad(cast(month(o_orderdate) as string),2,'0')) end as mesano from {orders}"""


def period_ref_date(spark, d):
    periods = spark.sql(PERIOD_INPUT, orders=view(spark, d, "orders"))
    return periods.withColumn("ref_date", period_last_day(F.col("mesano")))


# --- registry ------------------------------------------------------------------------

PERSON = ["row_id", "cpf_std", "nome", "dat_atual_fam", "renda_media"]
PERSON_SQL = ", ".join(PERSON)


def registry_latest(spark, d):
    return reg.latest_per_person(registry(spark, d)).select(*PERSON)


def registry_superseded(spark, d):
    return reg.superseded_rows(registry(spark, d)).select(*PERSON)


def cpf_duplicates(spark, d):
    return reg.cpf_duplicates(registry(spark, d))


def income_filter(spark, d):
    return eligible_registry(spark, d).select(*PERSON)


def income_filter_counts(spark, d):
    return reg.income_filter_counts(view(spark, d, "registry"))


# --- merges --------------------------------------------------------------------------

def cpf_merge(spark, d):
    left = students(spark, d).select("cpf_std", "matricula", F.col("nm_aluno").alias("nome"), "cpf")
    right = eligible_registry(spark, d).select("cpf_std", "row_id", F.col("nome").alias("NOME"), "cpf", "renda_media", "cep")
    return matching.merge_on(left, right, "cpf_std")


def cpf_merge_latest(spark, d):
    left = students(spark, d).select("cpf_std", "matricula", "nm_aluno")
    right = eligible_registry(spark, d).select("cpf_std", "row_id", "nome", "renda_media", "dat_atual_fam")
    return matching.merge_newest(left, right).drop("dat_atual_fam")


def cpf_merge_min(spark, d):
    people = view(spark, d, "registry").select(
        F.col("cpf").alias("CPF_CADUNICO"), F.col("nome").alias("NOME_PESSOA_CADUNICO"), F.col("cep").alias("CEP"),
        F.col("renda_media").alias("RENDA_MEDIA_FAM"), "cod_fam",
    )
    return matching.merge_minimal(view(spark, d, "student"), people)


def ensure_cpf(spark, d):
    people = view(spark, d, "registry").select("row_id", F.col("cpf").alias("Num_Cpf_Titular"))
    return ensure_standard_cpf(people)


def matricula_merge(spark, d):
    ids = view(spark, d, "student").select(F.col("matricula").alias("nro_int_aluno_estado"))
    people = view(spark, d, "registry").select(
        F.substring("nome", 10, 9).cast("bigint").alias("nro_int_aluno_estado"), "row_id", "renda_media"
    )
    return matching.merge_by_cpf_or_enrolment(ids, None, people)


def document_merge(spark, d):
    docs = view(spark, d, "student").select(F.col("matricula").alias("nro_int_aluno_estado"), F.concat(F.lit(" "), "cpf").alias("cpf"))
    people = view(spark, d, "registry").select("cpf", "row_id", "renda_media")
    return matching.merge_by_cpf_or_enrolment(docs.select("nro_int_aluno_estado"), docs, people)


def merge_metrics(spark, d):
    return matching.require_cpfs(matching.merge_metrics(students(spark, d), eligible_registry(spark, d)))


UNIQUE = ["cpf_std", "matricula", "nm_aluno", "row_id", "nome", "renda_media", "dat_atual_fam"]


def unique_persons(spark, d):
    left = students(spark, d).select("cpf_std", "matricula", "nm_aluno")
    right = eligible_registry(spark, d).select("cpf_std", "row_id", "nome", "renda_media", "dat_atual_fam")
    return matching.unique_persons(left, right).select(*UNIQUE)


def missing_cpf_sample(spark, d):
    return matching.missing_cpf_sample(students(spark, d).select("matricula", "nm_aluno", "cpf_std"), "matricula")


def invalid_cpf_rows(spark, d):
    return matching.invalid_cpf_rows(registry(spark, d).select("row_id", "cpf", "cpf_std", "nome")).drop("cpf_std")


def invalid_cpf_counts(spark, d):
    return matching.invalid_cpf_counts(students(spark, d), registry(spark, d))


# --- the registry laid out by id -----------------------------------------------------

def _by_id(spark, d, people):
    return store_by_id(people, f"registry_{uuid.uuid4().hex}", fresh_path(spark, "by_id"), buckets=8)


def unique_persons_by_id(spark, d):
    latest = _by_id(spark, d, eligible_registry(spark, d).select("cpf_std", "row_id", "nome", "renda_media", "dat_atual_fam"))
    return matching.unique_with_latest(students(spark, d).select("cpf_std", "matricula", "nm_aluno"), latest).select(*UNIQUE)


def cpf_merge_latest_by_id(spark, d):
    latest = _by_id(spark, d, eligible_registry(spark, d).select("cpf_std", "row_id", "nome", "renda_media", "dat_atual_fam"))
    return matching.merge_with_latest(students(spark, d).select("cpf_std", "matricula", "nm_aluno"), latest).drop("dat_atual_fam")


def unmatched_by_id(spark, d):
    latest = _by_id(spark, d, eligible_registry(spark, d).select("cpf_std", "row_id", "dat_atual_fam"))
    return matching.unmatched_with_latest(students(spark, d).select("matricula", "nm_aluno", "cpf_std"), latest)


def cpf_conflicts_by_id(spark, d):
    latest = _by_id(spark, d, registry(spark, d).select("cpf_std", "row_id", "nome", "dat_atual_fam"))
    return matching.conflicts_with_latest(students(spark, d).select("matricula", "nm_aluno", "cpf_std"), latest).select(*CONFLICT, "manter")


# --- waterfall and what follows from it ----------------------------------------------

WF = ["matricula", "nm_aluno", "cpf_std", "regra", "cad_row_id", "cad_cpf"]


def waterfall(spark, d):
    return matching.match_waterfall(
        students(spark, d).select("matricula", "nm_aluno", "nm_mae", "dt_nascimento", "cpf_std"), registry(spark, d)
    )


def mapped_cpf(spark, d):
    return layout.enrich_matched(waterfall(spark, d), registry(spark, d), [])


def match_waterfall(spark, d):
    return mapped_cpf(spark, d).select(*WF)


def match_rule_counts(spark, d):
    rule = F.coalesce("regra", F.lit("nenhuma")).alias("regra")
    return waterfall(spark, d).groupBy(rule).agg(F.count(F.lit(1)).alias("alunos"))


def unmapped_rows(spark, d):
    return waterfall(spark, d).filter("cad_row_id is null").select("matricula", "nm_aluno", "cpf_std")


def unmatched_by_cpf(spark, d):
    return matching.unmatched(students(spark, d).select("matricula", "nm_aluno", "cpf_std"), eligible_registry(spark, d))


def eligibility_funnel(spark, d):
    return matching.eligibility_funnel(waterfall(spark, d), registry(spark, d), INCOME_CUT)


CONFLICT = ["matricula", "nm_aluno", "cpf_std", "nome_cad"]


def _conflicts(spark, d):
    return matching.cpf_conflicts(students(spark, d).select("matricula", "nm_aluno", "cpf_std"), registry(spark, d))


def cpf_conflict_kept(spark, d):
    return _conflicts(spark, d).filter("manter").select(*CONFLICT)


def cpf_conflict_removed(spark, d):
    return _conflicts(spark, d).filter("not manter").select(*CONFLICT)


def enriched_mapped(spark, d):
    matched = waterfall(spark, d).select("matricula", "nm_aluno", "nm_mae", "dt_nascimento", "regra", "cad_row_id")
    return layout.enrich_matched(matched, registry(spark, d))


RESPONSIBLE = ["row_id", "cpf_std", "cod_fam", "cpf_resp", "nome_resp", "origem_cpf"]


def family_responsible(spark, d):
    people = registry(spark, d)
    return layout.with_responsible(people.select("row_id", "cpf_std", "cod_fam"), people).select(*RESPONSIBLE)


def municipality_fix(spark, d):
    rows = view(spark, d, "student").select(
        "matricula", F.when(F.col("matricula") % 9 != 0, (4300000 + F.col("cd_munic")).cast("string")).alias("cd_ibge")
    )
    return layout.fix_municipality(rows, *views(spark, d, "enrolment", "school"))


def beneficiary_layout(spark, d):
    matched = settle(waterfall(spark, d).select("matricula", "cad_row_id"), "matched")
    return layout.beneficiary_layout(matched, registry(spark, d), *views(spark, d, "enrolment", "school"))


QUERIES = {
    f.__name__: f
    for f in (
        cpf_digits, cpf_trim, cpf_canonical, cpf_quality, cpf_quality_counts, name_normalise, period_ref_date,
        registry_latest, registry_superseded, cpf_duplicates, income_filter, income_filter_counts,
        cpf_merge, cpf_merge_latest, cpf_merge_min, ensure_cpf, matricula_merge, document_merge, merge_metrics, unique_persons,
        missing_cpf_sample, invalid_cpf_rows, invalid_cpf_counts,
        unique_persons_by_id, cpf_merge_latest_by_id, unmatched_by_id, cpf_conflicts_by_id,
        match_waterfall, match_rule_counts, unmapped_rows, unmatched_by_cpf, eligibility_funnel,
        cpf_conflict_kept, cpf_conflict_removed, enriched_mapped, family_responsible, municipality_fix, beneficiary_layout,
    )
}

# Comparison SQL ----------------------------------------------------------------------

BOTH = ctes(ST, RG)
DIGITS = "regexp_replace(cpf,'[^0-9]','','g')"


def _digit(n: int, count: int) -> str:
    """A check digit in SQL over the first ``count`` digits of column ``g``."""
    total = "+".join(f"{count + 1 - i}*cast(substring(g,{i + 1},1) as int)" for i in range(count))
    return f"(case when ({total})%11<2 then 0 else 11-({total})%11 end) = cast(substring(g,{n},1) as int)"


QUALITY = f"""quality as (select matricula, cpf, case when cpf is null or g='' then 'missing'
    when replace(g,'0','')='' then 'zeroed' when length(g)<11 then 'incomplete'
    when length(g)>11 or replace(g,substring(g,1,1),'')='' or not ({_digit(10, 9)} and {_digit(11, 10)}) then 'invalid'
    when not regexp_matches(cpf,'^([0-9]{{11}}|[0-9]{{3}}[.][0-9]{{3}}[.][0-9]{{3}}-[0-9]{{2}})$') then 'irregular_format'
    else 'valid' end as qualidade
  from (select *, {DIGITS} as g from ({QUALITY_INPUT.replace('{student}', 'student')})))"""
ELIGIBLE = "er as (select * from rg where renda_media <= 660)"
ELIGIBLE_LATEST = """el as (select * from (select *, row_number() over (partition by cpf_std order by dat_atual_fam desc, row_id) as rn
  from er where cpf_std is not null) where rn=1)"""
CONFLICTS = """cf as (select st.matricula, st.nm_aluno, st.cpf_std, latest.nome as nome_cad from st
  join (select cpf_std from st where cpf_std is not null group by cpf_std having count(distinct nm_aluno)>1) x on x.cpf_std=st.cpf_std
  join latest on latest.cpf_std=st.cpf_std)"""
HEADS = """heads as (select cod_fam, cpf_std as cpf_resp, nome as nome_resp from rg where cod_parentesco=1 and cpf_std is not null
  qualify row_number() over (partition by cod_fam order by dat_atual_fam desc, row_id)=1)"""
LOCATED = """located as (select x.matricula, cast(s.cd_munic_ibge as string) as cd_ibge_escola from (select * from enrolment
    qualify row_number() over (partition by matricula order by (nro_int_situacao in (1,8)) desc, nro_int_turma, idt_estab, nro_int_situacao)=1) x
  join school s on s.idt_estab=x.idt_estab)"""
ADDRESS = ("concat_ws(' ', nullif(tipo_end,''), nullif(titulo_end,''), nullif(nome_end,''), nullif(num_end,''), "
           "nullif(complem_1,''), nullif(complem_2,''), nullif(bairro,''))")

SQL = {
    "cpf_digits": with_views("student", f"select matricula, {std()} as cpf_std from student"),
    "cpf_trim": with_views("student", "select matricula, trim(case when cpf is not null then ' '||cpf||'  ' end) as cpf from student"),
    "cpf_canonical": with_views(
        "student",
        """select matricula, case when length(g)<11 then lpad(g,11,'0') else g end as cpf
          from (select matricula, nullif(regexp_replace(regexp_replace(cpf,'^0+',''),'[^0-9]','','g'),'') as g from student)""",
    ),
    "cpf_quality": with_views("student", "select * from quality", QUALITY),
    "cpf_quality_counts": with_views("student", "select qualidade, count(*) as linhas from quality group by qualidade", QUALITY),
    "name_normalise": r"""select c_custkey, upper(trim(regexp_replace(strip_accents(
        '  José  da '||lower(c_name)||chr(9)||' Conceição Müller '),'\s+',' ','g'))) as nome from customer""",
    "period_ref_date": f"""select *, case when regexp_matches(mesano,'^[0-9]{{4}}(0[1-9]|1[0-2])$')
        then last_day(strptime(mesano||'01','%Y%m%d')::date) end as ref_date from ({PERIOD_INPUT.replace('{orders}', 'orders')})""",
    "registry_latest": with_views(
        "registry",
        f"""select {PERSON_SQL} from (select *, row_number() over (partition by cpf_std order by dat_atual_fam desc, row_id) as rn from rg)
          where cpf_std is null or rn=1""", RG),
    "registry_superseded": with_views(
        "registry",
        f"""select {PERSON_SQL} from (select *, row_number() over (partition by cpf_std order by dat_atual_fam desc, row_id) as rn from rg)
          where cpf_std is not null and rn>1""", RG),
    "cpf_duplicates": with_views(
        "registry",
        """select cpf_std, count(*) as linhas, max(dat_atual_fam) as ultima_atualizacao from rg
          where cpf_std is not null group by cpf_std having count(*)>1""", RG),
    "income_filter": with_views("registry", f"select {PERSON_SQL} from rg where renda_media<=660", RG),
    "income_filter_counts": with_views(
        "registry",
        """select count(*) as antes, count(*) filter (renda_media<=660) as depois,
          count(*) filter (renda_media is null) as renda_ilegivel from registry"""),
    "cpf_merge": with_views(
        "student registry",
        """select st.cpf_std, st.matricula, st.nm_aluno as "nome_ALUNO", st.cpf as "cpf_ALUNO", er.row_id,
          er.nome as "NOME_CADUNICO", er.cpf as "cpf_CADUNICO", er.renda_media, er.cep
          from st join er on st.cpf_std=er.cpf_std""",
        ctes(BOTH, ELIGIBLE)),
    "cpf_merge_latest": with_views(
        "student registry",
        """select st.cpf_std, st.matricula, st.nm_aluno, el.row_id, el.nome, el.renda_media
          from st join el on st.cpf_std=el.cpf_std""", ctes(BOTH, ELIGIBLE, ELIGIBLE_LATEST)),
    "cpf_merge_min": with_views(
        "student registry",
        """select st.cpf_std as "CPF_PADRONIZADO", st.nm_aluno, st.cpf, rg.nome as "NOME_PESSOA_CADUNICO",
          rg.renda_media as "RENDA_MEDIA_FAM", rg.cep as "CEP" from st join rg on st.cpf_std=rg.cpf_std""", BOTH),
    "ensure_cpf": with_views(
        "registry",
        f"""select row_id, cpf as "Num_Cpf_Titular", {person()} as "CPF_PADRONIZADO" from registry"""),
    "matricula_merge": with_views(
        "student registry",
        """select s.matricula as nro_int_aluno_estado, r.row_id, r.renda_media
          from student s join registry r on s.matricula=cast(substring(r.nome,10,9) as bigint)"""),
    "document_merge": with_views(
        "student registry",
        """select s.matricula as nro_int_aluno_estado, trim(s.cpf) as cpf, r.row_id, r.renda_media
          from student s join registry r on nullif(trim(s.cpf), '') = nullif(trim(r.cpf), '')"""),
    "merge_metrics": with_views(
        "student registry",
        """select (select count(*) from st) as alunos_total, (select count(cpf_std) from st) as alunos_com_cpf,
          (select count(*) from er) as cad_total, (select count(cpf_std) from er) as cad_com_cpf,
          (select count(*) from st join er on st.cpf_std=er.cpf_std) as merge_linhas,
          (select count(distinct st.cpf_std) from st join er on st.cpf_std=er.cpf_std) as pessoas_unicas""",
        ctes(BOTH, ELIGIBLE)),
    "unique_persons": with_views(
        "student registry",
        f"""select {', '.join(UNIQUE)} from (select st.cpf_std, st.matricula, st.nm_aluno, er.row_id, er.nome, er.renda_media,
            er.dat_atual_fam, row_number() over (partition by st.cpf_std order by er.dat_atual_fam desc, er.row_id, st.matricula) as rn
          from st join er on st.cpf_std=er.cpf_std) where rn=1""", ctes(BOTH, ELIGIBLE)),
    "missing_cpf_sample": with_views(
        "student", "select matricula, nm_aluno, cpf_std from st where cpf_std is null order by matricula limit 10", ST),
    "invalid_cpf_rows": with_views("registry", "select row_id, cpf, nome from rg where cpf_std is null", RG),
    "invalid_cpf_counts": with_views(
        "student registry",
        """select (select count(*) from st where cpf_std is null) as invalid_cpf_docs_count,
          (select count(*) from rg where cpf_std is null) as invalid_cpf_cad_count,
          (select string_agg(nome, ', ' order by nome) from (select distinct nome from rg where cpf_std is null order by nome limit 80))
            as invalid_cpf_cad_sample_names""", BOTH),
    "match_waterfall": with_views("student registry", f"select {', '.join(WF)} from wf", ctes(BOTH, WATERFALL)),
    "match_rule_counts": with_views(
        "student registry", "select coalesce(regra,'nenhuma') as regra, count(*) as alunos from wf group by 1", ctes(BOTH, WATERFALL)),
    "unmapped_rows": with_views(
        "student registry", "select matricula, nm_aluno, cpf_std from wf where cad_row_id is null", ctes(BOTH, WATERFALL)),
    "unmatched_by_cpf": with_views(
        "student registry",
        """select matricula, nm_aluno, cpf_std from st where not exists (select 1 from er where er.cpf_std=st.cpf_std)""",
        ctes(BOTH, ELIGIBLE)),
    "eligibility_funnel": with_views(
        "student registry",
        """select count(*) as lidos, count(wf.cad_row_id) as mapeados, count(*)-count(wf.cad_row_id) as nao_mapeados,
          count(*) filter (rg.renda_media<=660) as elegiveis,
          count(wf.cad_row_id) - count(*) filter (rg.renda_media<=660) as removidos
          from wf left join rg on rg.row_id=wf.cad_row_id""", ctes(BOTH, WATERFALL)),
    "cpf_conflict_kept": with_views(
        "student registry", "select * from cf where nm_aluno=nome_cad", ctes(BOTH, LATEST, CONFLICTS)),
    "cpf_conflict_removed": with_views(
        "student registry", "select * from cf where nm_aluno<>nome_cad", ctes(BOTH, LATEST, CONFLICTS)),
    "enriched_mapped": with_views(
        "student registry",
        """select wf.matricula, wf.nm_aluno, wf.nm_mae, wf.dt_nascimento, wf.regra, wf.cad_row_id, wf.cad_cpf, rg.nome as cad_nome,
          rg.nome_mae as cad_nome_mae, rg.dta_nasc as cad_dta_nasc, rg.cod_fam as cad_cod_fam, rg.renda_media as cad_renda_media
          from wf left join rg on rg.row_id=wf.cad_row_id""", ctes(BOTH, WATERFALL)),
    "family_responsible": with_views(
        "registry",
        """select rg.row_id, rg.cpf_std, rg.cod_fam, cpf_resp, nome_resp, case when rg.cpf_std is not null then 'PROPRIO'
          when cpf_resp is not null then 'RESPONSAVEL' else 'NENHUM' end as origem_cpf
          from rg left join heads on heads.cod_fam=rg.cod_fam""", ctes(RG, HEADS)),
    "municipality_fix": with_views(
        "student enrolment school",
        """select s.matricula, s.cd_ibge, l.cd_ibge_escola, coalesce(l.cd_ibge_escola, s.cd_ibge) as cod_munic_ibge,
          case when coalesce(l.cd_ibge_escola, s.cd_ibge) is distinct from s.cd_ibge then 1 else 0 end as municipio_corrigido
          from (select matricula, case when matricula%9<>0 then cast(4300000+cd_munic as string) end as cd_ibge from student) s
          left join located l on l.matricula=s.matricula""", LOCATED),
    "beneficiary_layout": with_views(
        "student registry enrolment school",
        f"""select wf.matricula as "MATRICULA", coalesce(rg.cpf_std, heads.cpf_resp) as "COD_CPF", rg.nome as "NOME_BENEFICIARIO",
          rg.dta_nasc as "DT_NASC_BENEFICIARIO", rg.nome_mae as "NOME_MAE_BENEFICIARIO",
          coalesce(located.cd_ibge_escola, rg.cd_ibge) as "COD_MUNIC_IBGE", {ADDRESS} as "ENDERECO", rg.cep as "CEP",
          ddd_contato1||num_tel_contato1 as "TELEFONE_1", ddd_contato2||num_tel_contato2 as "TELEFONE_2",
          cast(null as string) as "EMAIL", rg.renda_media as "VLR_RENDA_MEDIA",
          case when rg.cpf_std is not null then 'PROPRIO' when cpf_resp is not null then 'RESPONSAVEL' else 'NENHUM' end as "ORIGEM_CPF",
          cpf_resp as "CPF_RESP"
          from wf join rg on rg.row_id=wf.cad_row_id and rg.renda_media<=660
          left join heads on heads.cod_fam=rg.cod_fam left join located on located.matricula=wf.matricula""",
        ctes(BOTH, WATERFALL, HEADS, LOCATED)),
}

for _name in ("unique_persons", "cpf_merge_latest"):
    SQL[f"{_name}_by_id"] = SQL[_name]
SQL["unmatched_by_id"] = SQL["unmatched_by_cpf"]
SQL["cpf_conflicts_by_id"] = with_views(
    "student registry", "select *, nm_aluno=nome_cad as manter from cf", ctes(BOTH, LATEST, CONFLICTS))
