"""The beneficiaries run: match, settle conflicts, carry the bases, write the layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.cpf import person_cpf
from rollcall.functions.period import reference_date
from rollcall.operators import history
from rollcall.operators.keys import cut_to, join_written, wanted_keys
from rollcall.operators.layout import beneficiary_layout, enrich_matched, with_manual_rows
from rollcall.operators.matching import cpf_conflicts, eligibility_funnel, match_waterfall, shared_ids
from rollcall.operators.reconcile import final_analysis
from rollcall.operators.registry import with_standard_cpf
from rollcall.operators.students import eligible_students
from rollcall.schema import INCOME_CUT
from rollcall.sinks.files import write_csv, write_parquet
from rollcall.sinks.publish import publish, publish_tables
from rollcall.workdir import settle


def run_beneficiaries(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    period: str,
    out: str,
    cut: float = INCOME_CUT,
) -> dict[str, str]:
    """Write the outputs of one period and return their paths by name.

    ``tables`` holds student, registry, enrolment, school, school_class, school_calendar,
    manual_roster and previous_accumulated. The steps come in a fixed order: eligible
    students are matched to the registry, wrong owners of a shared id are taken out, the
    manual roster fills what the automatic match left, and only then the accumulated bases
    and the layout follow, with the registry looked up again for manual ids.
    """
    eligible = eligible_students(
        tables["enrolment"], tables["school_class"], tables["school_calendar"], tables["school"],
        tables["student"], F.lit(reference_date(period)),
    )
    people = with_standard_cpf(tables["student"].join(eligible, "matricula", "left_semi"))
    students = settle(people.select("matricula", "nm_aluno", "nm_mae", "dt_nascimento", "cpf_std"), "eligible")
    registry = with_standard_cpf(tables["registry"])

    # conflicts and manual ids want the newest rows of few ids: both take them from one scan
    roster = tables["manual_roster"].select(person_cpf(F.col("cpf")).alias("cpf_std"))
    ids = wanted_keys(shared_ids(students).unionByName(roster), "cpf_std")
    by_id = settle(cut_to(registry.select("cpf_std", "nome", "row_id", "dat_atual_fam"), ids, "cpf_std"), "by-id")

    matched = settle(enrich_matched(match_waterfall(students, registry), registry, []), "matched")
    removed = settle(
        cpf_conflicts(students, by_id).filter("not manter").select("matricula", "nm_aluno", "cpf_std", "nome_cad"), "removed"
    )
    kept = settle(matched.join(removed.select("matricula"), "matricula", "left_anti"), "kept")
    automatic = kept.filter("cad_cpf is not null").select("matricula", F.col("cad_cpf").alias("cpf"))
    mapped = settle(
        history.with_manual_roster(automatic, tables["manual_roster"]).withColumn("mesano", F.lit(period)), "mapped"
    )
    base = mapped.select("matricula", "cpf", "mesano")
    accumulated = settle(history.accumulate(tables["previous_accumulated"], base), "accumulated")

    paths = {
        name: write_parquet(df, f"{out}/{period}/{name}")
        for name, df in {
            "mapeados": mapped,
            "nao_mapeados": matched.filter("cad_row_id is null").select("matricula", "nm_aluno", "cpf_std"),
            "removidas_cpf_duplicado": removed,
            "acumulada": accumulated,
            "inativos": history.inactive(tables["previous_accumulated"], base),
            "cpfs_unicos_mapeados": history.unique_cpf(base),
            "cpfs_unicos_acumulada": history.unique_cpf(accumulated),
            "funil": eligibility_funnel(matched, registry, cut),
        }.items()
    }
    rows = settle(with_manual_rows(kept, mapped, by_id), "rows")
    layout = beneficiary_layout(rows, registry, tables["enrolment"], tables["school"], cut)
    paths["layout"] = write_csv(layout, f"{out}/{period}/layout", bom=True)
    return paths


def publish_beneficiaries(
    spark: SparkSession, tables: Mapping[str, DataFrame], period: str, out: str, cut: float = INCOME_CUT
) -> dict[str, str]:
    """``run_beneficiaries`` into a folder of its own, published as a whole."""
    paths: dict[str, str] = {}
    publish(spark, out, period, lambda folder: paths.update(run_beneficiaries(spark, tables, period, folder, cut)))
    return paths


COMPARED_COLUMNS = ("COD_CPF", "ORIGEM_CPF", "CPF_RESP", "VLR_RENDA_MEDIA")


def publish_final_analysis(layout: DataFrame, other: DataFrame, period: str, out: str, columns: Sequence[str] = COMPARED_COLUMNS) -> str:
    """The layout of a run against another output of the same period, published as a whole."""
    return publish_tables(layout.sparkSession, out, period, final_analysis(layout, other, "MATRICULA", columns))


def layout_debug(matched: DataFrame, registry: DataFrame, layout: DataFrame, cut: float = INCOME_CUT) -> DataFrame:
    """Why each student of ``matched`` is in the layout or not: ``no_layout``, ``sem_cadastro`` or ``renda``.

    ``matched`` has ``matricula``, ``regra`` and ``cad_row_id``; the registry is cut to its rows.
    """
    rows = settle(matched.select("matricula", "regra", "cad_row_id"), "matched")
    people = registry.select(F.col("row_id").alias("cad_row_id"), F.col("renda_media").alias("renda"))
    people = cut_to(people, wanted_keys(rows, "cad_row_id"), "cad_row_id")
    there = layout.select(F.col("MATRICULA").alias("matricula"), F.lit(True).alias("_there"))
    joined = join_written(rows, people, "cad_row_id", "left", "matricula").join(there, "matricula", "left")
    reason = (
        F.when(F.col("_there"), "no_layout").when(F.col("regra").isNull(), "sem_cadastro")
        .when(F.coalesce(F.col("renda") > cut, F.lit(True)), "renda").otherwise("retirado")
    )
    return joined.select("matricula", "regra", "renda", reason.alias("situacao"))
