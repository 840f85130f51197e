"""Enriching matched students and the beneficiary layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.cpf import person_cpf
from rollcall.functions.text import full_address, phone
from rollcall.operators.keys import cut_to, first_per_key, join_per_key, join_written, wanted_keys
from rollcall.operators.registry import latest_first, latest_with_cpf
from rollcall.schema import ACTIVE_SITUATIONS, INCOME_CUT
from rollcall.workdir import settle

REFERENCE_PERSON = 1


MATCHED_COLUMNS = ("nome", "nome_mae", "dta_nasc", "cod_fam", "renda_media")


def enrich_matched(
    matched: DataFrame, registry: DataFrame, columns: Sequence[str] = MATCHED_COLUMNS
) -> DataFrame:
    """Matched students with the personal and family data of their registry row.

    Adds ``cad_cpf`` and the given columns with the prefix ``cad_``; students without a
    match stay, with nulls. ``matched`` is written, and only registry rows that it has are joined.
    """
    matched = settle(matched, "matched")
    person = registry.select(
        F.col("row_id").alias("_row"), F.col("cpf_std").alias("cad_cpf"), *[F.col(c).alias(f"cad_{c}") for c in columns]
    )
    person = cut_to(person, wanted_keys(matched.filter("cad_row_id is not null").select(F.col("cad_row_id").alias("_row")), "_row"), "_row")
    return join_written(matched.withColumn("_row", F.col("cad_row_id")), person, "_row", "left", "matricula").drop("_row")


def family_heads(registry: DataFrame, code: int = REFERENCE_PERSON) -> DataFrame:
    """Per family the reference person with an id: newest update, then row id."""
    heads = registry.filter((F.col("cod_parentesco") == code) & F.col("cpf_std").isNotNull()).select(
        "cod_fam", F.col("cpf_std").alias("cpf_resp"), F.col("nome").alias("nome_resp"), "dat_atual_fam", "row_id"
    )
    return first_per_key(heads, F.col("cod_fam"), latest_first()).select("cod_fam", "cpf_resp", "nome_resp")


def with_responsible(persons: DataFrame, registry: DataFrame, code: int = REFERENCE_PERSON) -> DataFrame:
    """Registry persons with their family's responsible and where their id comes from.

    ``origem_cpf`` is ``PROPRIO`` with an own id, else ``RESPONSAVEL`` when the family has
    one, else ``NENHUM``.
    """
    joined = join_per_key(
        persons.withColumn("_fam", F.col("cod_fam")),
        family_heads(registry, code).withColumnRenamed("cod_fam", "_fam"),
        "_fam",
        "left",
        "row_id",
    ).drop("_fam")
    origin = (
        F.when(F.col("cpf_std").isNotNull(), "PROPRIO")
        .when(F.col("cpf_resp").isNotNull(), "RESPONSAVEL")
        .otherwise("NENHUM")
    )
    return joined.withColumn("origem_cpf", origin)


def school_of_student(enrolments: DataFrame) -> DataFrame:
    """One school per student: active enrolments first, then the lowest class."""
    active = F.col("nro_int_situacao").isin(*ACTIVE_SITUATIONS)
    order = [F.desc(active), F.asc("nro_int_turma"), F.asc("idt_estab"), F.asc("nro_int_situacao")]
    return first_per_key(
        enrolments.select("matricula", "nro_int_situacao", "nro_int_turma", "idt_estab"), F.col("matricula"), order
    ).select("matricula", "idt_estab")


def fix_municipality(students: DataFrame, enrolments: DataFrame, schools: DataFrame) -> DataFrame:
    """``cod_munic_ibge``: the school's municipality where known, else ``cd_ibge``.

    ``municipio_corrigido`` is 1 where that changed the code.
    """
    place = schools.select("idt_estab", F.col("cd_munic_ibge").cast("string").alias("cd_ibge_escola"))
    # A student's school first: both sides are then one row per enrolment number.
    located = school_of_student(enrolments).join(place, "idt_estab").select("matricula", "cd_ibge_escola")
    fixed = F.coalesce("cd_ibge_escola", "cd_ibge")
    return students.join(located, "matricula", "left").select(
        "*",
        fixed.alias("cod_munic_ibge"),
        F.when(~fixed.eqNullSafe(F.col("cd_ibge")), 1).otherwise(0).alias("municipio_corrigido"),
    )


def with_manual_rows(kept: DataFrame, mapped: DataFrame, registry: DataFrame) -> DataFrame:
    """``matricula``, ``cad_row_id`` and ``manual_cpf`` of matched students and of the manual roster.

    A manual id stands for its newest registry row; where the registry has none, the row that
    the match found stays. The registry is cut to the manual ids before any of its rows is ranked.
    """
    manual = mapped.filter("origem = 'MANUAL'").select("matricula", F.col("cpf").alias("manual_cpf"), person_cpf(F.col("cpf")).alias("cpf_std"))
    known = cut_to(registry.select("cpf_std", "row_id", "dat_atual_fam"), wanted_keys(manual, "cpf_std"), "cpf_std")
    found = join_per_key(manual, latest_with_cpf(known).select("cpf_std", "row_id"), "cpf_std", "left", "matricula")
    both = kept.select("matricula", "cad_row_id").join(found.select("matricula", "manual_cpf", "row_id"), "matricula", "full")
    return both.select("matricula", F.coalesce("row_id", "cad_row_id").alias("cad_row_id"), "manual_cpf")


def beneficiary_layout(
    matched: DataFrame,
    registry: DataFrame,
    enrolments: DataFrame,
    schools: DataFrame,
    cut: float = INCOME_CUT,
) -> DataFrame:
    """The final layout: one row per matched student within the income cut.

    The registry is cut to the matched rows, and for the responsible to these rows' families;
    both are only then spread over the students. ``matched`` is read twice, so pass a table (see
    ``workdir.settle``). With a column ``manual_cpf`` such an id is the student's own. No
    source for an e-mail is known, that column is null.
    """
    if "manual_cpf" not in matched.columns:
        matched = matched.withColumn("manual_cpf", F.lit(None).cast("string"))
    wanted = matched.filter("cad_row_id is not null").select(F.col("cad_row_id").alias("row_id"))
    person = settle(cut_to(registry.filter(F.col("renda_media") <= cut), wanted_keys(wanted, "row_id"), "row_id"), "person")
    families = cut_to(registry, wanted_keys(person, "cod_fam"), "cod_fam")
    person = with_responsible(person, families).withColumnRenamed("row_id", "cad_row_id").drop("cpf")
    rows = matched.select("matricula", "cad_row_id", "manual_cpf").join(person, "cad_row_id")
    rows = fix_municipality(rows, enrolments, schools)
    return rows.select(
        F.col("matricula").alias("MATRICULA"),
        F.coalesce("manual_cpf", "cpf_std", "cpf_resp").alias("COD_CPF"),
        F.col("nome").alias("NOME_BENEFICIARIO"),
        F.col("dta_nasc").alias("DT_NASC_BENEFICIARIO"),
        F.col("nome_mae").alias("NOME_MAE_BENEFICIARIO"),
        F.col("cod_munic_ibge").alias("COD_MUNIC_IBGE"),
        full_address(F.col("tipo_end"), F.col("titulo_end"), F.col("nome_end"), F.col("num_end"),
                     F.col("complem_1"), F.col("complem_2"), F.col("bairro")).alias("ENDERECO"),
        F.col("cep").alias("CEP"),
        phone(F.col("ddd_contato1"), F.col("num_tel_contato1")).alias("TELEFONE_1"),
        phone(F.col("ddd_contato2"), F.col("num_tel_contato2")).alias("TELEFONE_2"),
        F.lit(None).cast("string").alias("EMAIL"),
        F.col("renda_media").alias("VLR_RENDA_MEDIA"),
        F.when(F.col("manual_cpf").isNotNull(), "PROPRIO").otherwise(F.col("origem_cpf")).alias("ORIGEM_CPF"),
        F.col("cpf_resp").alias("CPF_RESP"),
    )
