"""The monthly run: from school and registry tables to the output files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.period import reference_date
from rollcall.operators.matching import (
    invalid_cpf_rows,
    merge_metrics,
    merge_newest,
    merge_on,
    require_ids,
    unique_persons,
    unmatched,
)
from rollcall.operators.registry import income_filter, with_standard_cpf
from rollcall.operators.students import eligible_students
from rollcall.schema import INCOME_CUT
from rollcall.sinks.files import write_csv, write_period
from rollcall.sinks.publish import publish, published_folder
from rollcall.workdir import settle


def run_month(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    period: str,
    out: str,
    cut: float = INCOME_CUT,
    all_registry_rows: bool = False,
) -> DataFrame:
    """Write the period's outputs under ``out`` and return the metrics row.

    ``matriculas`` has one row per student, with the newest registry row of their id, or
    with ``all_registry_rows`` one per pair of student and registry row.

    Eligible students with their documents and the income-filtered registry are each
    written once to the cluster's shared folder, with their rows and ids counted as they are
    written, which tells whether there is anything to match; all outputs read those tables, so nothing
    is computed twice and a lost executor costs only its own tasks.
    """
    ref_date = F.lit(reference_date(period))
    eligible = eligible_students(
        tables["enrolment"], tables["school_class"], tables["school_calendar"], tables["school"],
        tables["student"], ref_date,
    )
    documents = with_standard_cpf(tables["student"].join(eligible, "matricula", "left_semi"))
    people = income_filter(with_standard_cpf(tables["registry"]), cut)

    counts = F.count(F.lit(1)).alias("total"), F.count("cpf_std").alias("com_cpf")
    seen_students, seen_registry = Observation(), Observation()
    students = settle(documents.select("matricula", "nm_aluno", "cpf", "cpf_std").observe(seen_students, *counts), "students")
    registry = settle(
        people.select("row_id", "cpf", "cpf_std", "nome", "dta_nasc", "renda_media", "cep", "dat_atual_fam").observe(seen_registry, *counts),
        "registry",
    )
    require_ids(seen_students.get, seen_registry.get)
    metrics = merge_metrics(students, registry)

    def stamped(df: DataFrame) -> DataFrame:
        return df.withColumn("mesano", F.lit(period))

    merged = merge_on(students, registry, "cpf_std") if all_registry_rows else merge_newest(students, registry)
    write_period(stamped(merged), f"{out}/matriculas", period=period)
    write_period(stamped(unique_persons(students, registry)), f"{out}/pessoas_unicas", period=period)
    write_period(stamped(unmatched(students, registry)), f"{out}/nao_mapeados", period=period)
    write_csv(invalid_cpf_rows(registry), f"{out}/cpf_invalidos/{period}", bom=True)
    write_period(stamped(metrics), f"{out}/metricas", period=period)
    return spark.read.parquet(f"{out}/metricas").filter(F.col("mesano") == period)


def publish_month(spark: SparkSession, tables: Mapping[str, DataFrame], period: str, out: str, **options) -> dict[str, str]:
    """``run_month`` into a folder of its own, published as a whole; the published outputs by name.

    Until the last output is written, and if the run dies, readers of the period keep what
    was published before (``publish.published_folder``).
    """
    publish(spark, out, period, lambda folder: run_month(spark, tables, period, folder, **options))
    folder = published_folder(spark, out, period)
    paths = {name: f"{folder}/{name}" for name in ("matriculas", "pessoas_unicas", "nao_mapeados", "metricas")}
    return paths | {"cpf_invalidos": f"{folder}/cpf_invalidos/{period}"}
