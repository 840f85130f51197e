"""Joins with the registry start from the students: what is scanned, shuffled and written."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from rollcall import workdir
from rollcall.functions.cpf import person_cpf
from rollcall.operators import keys, layout, matching
from rollcall.operators.registry import with_standard_cpf
from rollcall.plans.beneficiaries import run_beneficiaries

D1 = dt.date(2025, 1, 1)


@pytest.fixture
def written(monkeypatch):
    """Plans and numbers of rows of all tables that operators write, in order."""
    found = []

    def settle(df, name):
        plan = df._jdf.queryExecution().toString()
        table = workdir_settle(df, name)
        found.append((name, plan, table.count()))
        return table

    workdir_settle = workdir.settle
    for module in (keys, layout, matching):
        monkeypatch.setattr(module, "settle", settle)
    return found


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    """20,000 persons, of whom students are 200; every id twice, families of four."""
    path = str(tmp_path_factory.mktemp("registry") / "registry_rows")
    n = F.col("id") % 20_000
    spark.range(40_000).select(
        F.col("id").alias("row_id"), F.lpad((n + 1).cast("string"), 11, "0").alias("cpf"), F.concat(F.lit("NOME "), n).alias("nome"),
        F.concat(F.lit("MAE "), n).alias("nome_mae"), F.expr("date '1990-01-01'").alias("dta_nasc"), F.expr("date '2025-01-01'").alias("dat_atual_fam"),
        F.floor(n / 4).cast("string").alias("cod_fam"), F.lit(1).alias("cod_parentesco"), F.lit(100.0).alias("renda_media"),
    ).write.parquet(path)
    return with_standard_cpf(spark.read.parquet(path))


@pytest.fixture(scope="module")
def pupils(spark):
    rows = spark.range(200).select(
        F.col("id").alias("matricula"), F.concat(F.lit("NOME "), "id").alias("nm_aluno"), F.concat(F.lit("MAE "), "id").alias("nm_mae"),
        F.expr("date '1990-01-01'").alias("dt_nascimento"), F.when(F.col("id") % 2 == 0, F.lpad((F.col("id") + 1).cast("string"), 11, "0")).alias("cpf"),
    )
    return with_standard_cpf(rows)


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_between(plan: str, table: str) -> list[str]:
    """Exchanges above the scan of ``table`` and below the join that cuts it."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if table in line and "FileScan" in line)
    above = []
    for line in reversed(lines[:at]):
        if "Join" in line:
            break
        above.append(line)
    return [line for line in above if "Exchange" in line and "BroadcastExchange" not in line]


def test_waterfall_scans_the_registry_once_and_shuffles_only_what_matches(spark, registry, pupils, written):
    found = matching.match_waterfall(pupils, registry)
    assert found.filter("cad_row_id is not null").count() == 200
    registry_writes = [(name, plan, rows) for name, plan, rows in written if "registry_rows" in plan]
    assert len(registry_writes) == 1 and "registry_rows" not in executed(found)
    name, plan, rows = registry_writes[0]
    physical = plan[plan.index("Physical Plan") :]
    assert physical.count("FileScan") - physical.count("wanted-") >= 1 and len(re.findall(r"FileScan parquet[^\n]*registry_rows", physical)) == 1
    assert "BroadcastHashJoin" in physical and not exchanges_between(physical, "registry_rows")
    assert rows <= 3 * 200  # one per rule and student
    assert all(rows <= 3 * 200 for _, _, rows in written)


def test_enriching_and_the_funnel_write_no_registry_rows_without_a_student(spark, registry, pupils, written):
    matched = workdir.settle(matching.match_waterfall(pupils, registry), "matched")
    written.clear()
    rich = layout.enrich_matched(matched, registry)
    assert rich.count() == 200 and rich.filter("cad_nome = nm_aluno").count() == 200
    assert not exchanges_between(executed(rich)[executed(rich).index("Initial Plan") if "Initial Plan" in executed(rich) else 0 :], "registry_rows")
    assert tuple(matching.eligibility_funnel(matched, registry, 50).first()) == (200, 200, 0, 0, 200)
    assert tuple(matching.eligibility_funnel(matched, registry, 660).first()) == (200, 200, 0, 200, 0)
    assert written and all(rows <= 200 for _, _, rows in written)


@pytest.mark.parametrize("query", ["unique_persons", "merge_newest", "unmatched", "cpf_conflicts"])
def test_ids_are_cut_before_ranking(spark, registry, pupils, written, query):
    df = getattr(matching, query)(pupils.select("cpf_std", "matricula", "nm_aluno"), registry)
    assert df.count() == {"unique_persons": 100, "merge_newest": 100, "unmatched": 100, "cpf_conflicts": 0}[query]
    for plan in [plan[plan.index("Physical Plan") :] for _, plan, _ in written if "registry_rows" in plan] + [executed(df)]:
        if "registry_rows" in plan:
            assert not exchanges_between(plan, "registry_rows")
    assert all(rows <= 200 for _, _, rows in written)


def test_more_keys_than_are_sent(spark, registry, pupils, monkeypatch):
    few = matching.match_waterfall(pupils, registry)
    monkeypatch.setattr(keys, "MOST_SENT_KEYS", 10)
    many = matching.match_waterfall(pupils, registry)
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def test_cut_to_drops_null_keys_and_keeps_the_rest(spark):
    big = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "k string, v int")
    wanted = keys.wanted_keys(spark.createDataFrame([("a",), (None,), ("a",), ("z",)], "k string"), "k")
    assert wanted.count() == 2
    assert sorted(r.v for r in keys.cut_to(big, wanted, "k").collect()) == [1, 4]


def test_ids_of_no_person(spark):
    rows = [("000.000.000-00", None), ("0", None), ("11111111111", None), ("1111111111", "1111111111"), ("123", "123"), ("--", None), (None, None)]
    df = spark.createDataFrame(rows, "cpf string, digits string")
    assert [r[0] for r in df.select(person_cpf(F.col("cpf"))).collect()] == [d for _, d in rows]


def test_students_with_a_zeroed_id_keep_their_match(spark, tmp_path):
    """Three students share the id 00000000000; each is in the registry by name and mother."""
    people = [("Ana", "Rita"), ("Bia", "Eva"), ("Caio", "Zoe")]
    students = spark.createDataFrame([(i, n, m, D1, "000.000.000-00") for i, (n, m) in enumerate(people, 1)], "matricula bigint, nm_aluno string, nm_mae string, dt_nascimento date, cpf string")
    text = ["bairro", "tipo_end", "titulo_end", "nome_end", "num_end", "complem_1", "complem_2", "cep", "cd_ibge", "ddd_contato1", "num_tel_contato1", "ddd_contato2", "num_tel_contato2"]
    registry = spark.createDataFrame(
        [(10 + i, "00000000000" if i % 2 else "11111111111", n, m, dt.date(1999, 1, 1), D1, f"F{i}", 1, 100.0) for i, (n, m) in enumerate(people)],
        "row_id bigint, cpf string, nome string, nome_mae string, dta_nasc date, dat_atual_fam date, cod_fam string, cod_parentesco int, renda_media double",
    ).withColumns({c: F.lit("x") for c in text})
    tables = {
        "student": students, "registry": registry,
        "enrolment": spark.createDataFrame([(i, 1, 1, 1, 1) for i in (1, 2, 3)], "matricula bigint, nro_int_turma bigint, nro_int_situacao int, nro_int_calend_estab bigint, idt_estab bigint"),
        "school": spark.createDataFrame([(1, "N", 1, 43)], "idt_estab bigint, in_esc_prisional string, nro_int_designacao int, cd_munic_ibge int"),
        "school_class": spark.createDataFrame([(1, "S2")], "nro_int_turma bigint, cd_tipo_ensino string"),
        "school_calendar": spark.createDataFrame([(1, D1, dt.date(2025, 12, 31))], "nro_int_calend_estab bigint, dt_inicio date, dt_fim date"),
        "manual_roster": spark.createDataFrame([], "matricula bigint, cpf string"),
        "previous_accumulated": spark.createDataFrame([], "matricula bigint, cpf string, mesano string"),
    }
    students_young = tables["student"].withColumn("dt_nascimento", F.lit(dt.date(2010, 1, 1)))
    paths = run_beneficiaries(spark, {**tables, "student": students_young}, "202507", str(tmp_path))
    assert spark.read.parquet(paths["removidas_cpf_duplicado"]).count() == 0
    got = spark.read.csv(paths["layout"], sep=";", header=True)
    assert sorted(r[0] for r in got.select("NOME_BENEFICIARIO").collect()) == ["Ana", "Bia", "Caio"]
    assert {r[0] for r in got.select("ORIGEM_CPF").collect()} == {"NENHUM"}
