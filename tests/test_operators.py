"""Operators on small tables: edge cases, skew, errors."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import columns, history, keys, layout, matching, reconcile, registry, students

D1, D2, D3 = dt.date(2025, 1, 1), dt.date(2025, 2, 1), dt.date(2025, 3, 1)
REGISTRY = "row_id bigint, cpf string, nome string, dat_atual_fam date, renda_media double"


def people(spark, rows):
    return registry.with_standard_cpf(spark.createDataFrame(rows, REGISTRY))


def test_latest_per_person_ties_and_nulls(spark):
    df = people(spark, [
        (1, "123", "A", D1, 1.0), (2, "1-23", "B", D2, 1.0), (3, "123", "C", D2, 1.0),
        (4, None, "N", D1, 1.0), (5, "--", "M", D1, 1.0), (6, "9", "Z", None, 1.0), (7, "9", "Y", D1, 1.0),
    ])
    assert sorted(r.row_id for r in registry.latest_per_person(df).collect()) == [2, 4, 5, 7]
    assert sorted(r.row_id for r in registry.latest_with_cpf(df).collect()) == [2, 7]
    assert sorted(r.row_id for r in registry.superseded_rows(df).collect()) == [1, 3, 6]
    assert [tuple(r) for r in registry.cpf_duplicates(df).orderBy("cpf_std").collect()] == [("123", 3, D2), ("9", 2, D1)]


def test_rows_without_id_stay_whatever_their_columns(spark):
    same = [(None, None, "N", D1, 1.0)] * 5 + [(7, "", "N", D1, 1.0)] * 3
    df = people(spark, [*same, (1, "1", "A", D1, 1.0), (1, "1", "A", D1, 1.0)])
    assert registry.latest_per_person(df).count() == 9
    assert "_line" not in registry.latest_per_person(df).columns


def test_row_number_is_limited_before_the_shuffle(spark):
    df = people(spark, [(1, "1", "A", D1, 1.0)])
    plan = registry.latest_per_person(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_income_filter_text_and_numbers(spark):
    df = spark.createDataFrame([(1, "660.00"), (2, "660.01"), (3, "x"), (4, None), (5, "0")], "row_id int, renda string")
    assert [r.row_id for r in registry.income_filter(df, 660, "renda").orderBy("row_id").collect()] == [1, 5]
    assert tuple(registry.income_filter_counts(df, 660, "renda").first()) == (5, 2, 2)


def test_income_filter_reaches_the_scan(spark, tmp_path):
    people(spark, [(1, "1", "A", D1, 1.0)]).write.parquet(str(tmp_path / "r"))
    plan = registry.income_filter(spark.read.parquet(str(tmp_path / "r")))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(renda_media,660.0)" in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_join_per_key_equals_plain_join(spark, how):
    # One key holds a third of the rows, another third has no key.
    left = spark.range(3000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"),
    )
    right = spark.range(0, 3000, 2).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([("hot", -1)], "k string, v bigint")
    )
    plain = left.join(right, "k", how)
    salted = keys.join_per_key(left, right, "k", how, "row")
    assert sorted(salted.columns) == sorted(plain.columns)
    assert sorted(map(tuple, salted.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_newest_row_ids(spark):
    big = 2**63 - 1
    rows = [("a", D1, 5), ("a", D2, 9), ("a", D2, 7), ("b", None, 3), ("b", None, 2), ("c", D1, -4), ("c", D1, 4),
            ("d", D1, big), ("e", D1, -big), ("f", None, 1), ("f", D1, 2), (None, D1, 8), ("g", dt.date(1900, 1, 1), 0),
            ("h", dt.date(9999, 12, 31), big), ("h", dt.date(9999, 12, 31), -big)]
    df = spark.createDataFrame(rows, "k string, d date, row_id bigint")
    got = {r.k: r.row_id for r in keys.newest_row_ids(df, "k", "d", "row_id").collect()}
    assert got == {"a": 7, "b": 2, "c": -4, "d": big, "e": -big, "f": 2, None: 8, "g": 0, "h": -big}
    plan = keys.newest_row_ids(df, "k", "d", "row_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


STUDENT = "matricula bigint, nm_aluno string, nm_mae string, dt_nascimento date, cpf string"


def students_of(spark, rows):
    return registry.with_standard_cpf(spark.createDataFrame(rows, STUDENT))


def matched_registry(spark):
    ddl = "row_id bigint, cpf string, nome string, nome_mae string, dta_nasc date, dat_atual_fam date"
    return registry.with_standard_cpf(spark.createDataFrame([
        (10, "111", "Ana Lima", "Rita", D1, D1), (11, "111", "Ana Lima", "Rita", D1, D2),
        (12, "", "Bruno Sá", "Eva", D1, D1), (13, "333", "Carla", "outra", D2, D1),
        (14, None, None, None, None, D1), (15, None, " ", "Eva", D3, D1),
    ], ddl))


def test_waterfall_rules_in_order(spark):
    rows = [
        (1, "x", "y", D3, "1-11"),            # by id
        (2, "BRUNO  SA", "eva", D3, None),    # by name and mother
        (3, "carla", "other", D2, "---"),     # by name and birth date
        (4, "ana lima", "rita", D1, "999"),   # id unknown, name and mother
        (5, "nobody", "none", D1, None),      # no rule
        (6, None, None, None, None),          # nothing to match on: nulls never match
        (7, " ", "Eva", D3, None),            # an empty name is not a name
    ]
    cad = matched_registry(spark)
    found = matching.match_waterfall(students_of(spark, rows), cad)
    got = layout.enrich_matched(found, cad, ["nome"]).orderBy("matricula").collect()
    assert [r.cad_nome for r in got] == ["Ana Lima", "Bruno Sá", "Carla", "Ana Lima", None, None, None]
    assert [(r.matricula, r.regra, r.cad_row_id, r.cad_cpf) for r in got] == [
        (1, "cpf", 11, "111"), (2, "nome_mae", 12, None), (3, "nome_nascimento", 13, "333"),
        (4, "nome_mae", 11, "111"), (5, None, None, None), (6, None, None, None), (7, None, None, None),
    ]


def test_zeroed_ids_match_nobody(spark):
    rows = [(1, "Zoe", "Um", D1, "000.000.000-00"), (2, "Yan", "Dois", D2, "111.111.111-11"), (3, "Ana", "Rita", D1, None)]
    ddl = "row_id bigint, cpf string, nome string, nome_mae string, dta_nasc date, dat_atual_fam date"
    cad = spark.createDataFrame([(10, "00000000000", "Outro", "Alguem", D3, D1), (11, "11111111111", "Mais", "Um", D3, D1)], ddl)
    got = matching.match_waterfall(students_of(spark, rows), registry.with_standard_cpf(cad))
    assert [r.cad_row_id for r in got.collect()] == [None, None, None]


def test_newest_known_id_wins_and_masks_do_not_count(spark):
    ddl = "matricula bigint, cpf string, mesano string"
    old = spark.createDataFrame([(1, "111", "202506"), (2, "22-2", "202506")], ddl)
    new = spark.createDataFrame([(1, None, "202507"), (2, "", "202507"), (3, "222", "202507")], ddl)
    base = history.accumulate(old, new)
    assert {r.matricula: r.cpf for r in base.collect()} == {1: "111", 2: "22-2", 3: "222"}
    assert [r.matricula for r in history.unique_cpf(base).orderBy("matricula").collect()] == [1, 3]


def test_waterfall_against_brute_force(spark):
    rng = random.Random(7)
    names, mothers = ["ANA", "BIA", "CAIO", "", None], ["RITA", "EVA", None]
    dates, ids = [D1, D2, D3, None], ["1", "2", "3", "", None, "9"]
    pupils = [(i, rng.choice(names), rng.choice(mothers), rng.choice(dates), rng.choice(ids)) for i in range(300)]
    cad = [(100 + i, rng.choice(ids[:5]), rng.choice(names), rng.choice(mothers), rng.choice(dates), rng.choice(dates[:3]))
           for i in range(25)]
    ddl = "row_id bigint, cpf string, nome string, nome_mae string, dta_nasc date, dat_atual_fam date"
    got = matching.match_waterfall(students_of(spark, pupils), registry.with_standard_cpf(spark.createDataFrame(cad, ddl)))

    def first(pairs):
        hits = [c for c in cad if all(a and a == c[i] for a, i in pairs)]
        return min(hits, key=lambda c: (-c[5].toordinal(), c[0]))[0] if hits else None

    expected = {}
    for number, name, mother, born, cpf in pupils:
        rules = {"cpf": [(cpf, 1)], "nome_mae": [(name, 2), (mother, 3)], "nome_nascimento": [(name, 2), (born, 4)]}
        found = ((rule, first(pairs)) for rule, pairs in rules.items())
        expected[number] = next(((r, row) for r, row in found if row is not None), (None, None))
    assert {r.matricula: (r.regra, r.cad_row_id) for r in got.collect()} == expected
    assert {rule for rule, _ in expected.values()} == {"cpf", "nome_mae", "nome_nascimento", None}


def test_merge_newest_gives_one_row_per_student(spark):
    cad = people(spark, [(1, "1", "old", D1, 1.0), (2, "1", "new", D2, 1.0), (3, None, "x", D1, 1.0)])
    pupils = students_of(spark, [(1, "a", "b", D1, "1"), (2, "a", "b", D1, "1"), (3, "a", "b", D1, None)])
    got = matching.merge_newest(pupils.select("cpf_std", "matricula", "cpf"), cad)
    assert sorted((r.matricula, r.nome) for r in got.collect()) == [(1, "new"), (2, "new")]
    assert {"cpf_ALUNO", "cpf_CADUNICO"} <= set(got.columns)


def test_merge_metrics_guard(spark):
    cad = people(spark, [(1, "123", "A", D1, 1.0)])
    nobody = students_of(spark, [(1, "a", "b", D1, "--"), (2, "a", "b", D1, None)])
    with pytest.raises(ValueError, match="students"):
        matching.require_cpfs(matching.merge_metrics(nobody, cad))
    somebody = students_of(spark, [(1, "a", "b", D1, "12-3"), (2, "a", "b", D1, "123")])
    with pytest.raises(ValueError, match="registry"):
        matching.require_cpfs(matching.merge_metrics(somebody, people(spark, [(1, "", "A", D1, 1.0)])))
    assert tuple(matching.merge_metrics(somebody, cad).first()) == (2, 2, 1, 1, 2, 1)


def test_null_ids_never_merge(spark):
    left = students_of(spark, [(1, "a", "b", D1, None), (2, "a", "b", D1, "")]).select("cpf_std", "matricula")
    right = people(spark, [(1, None, "A", D1, 1.0), (2, "", "A", D1, 1.0)]).select("cpf_std", "row_id")
    assert matching.merge_on(left, right, "cpf_std").count() == 0


def test_merge_needs_its_key(spark):
    with pytest.raises(ValueError, match="nro_int_aluno_estado"):
        matching.merge_by_cpf_or_enrolment(spark.range(1), None, spark.range(1))


def test_merge_with_documents_uses_trimmed_cpf(spark):
    docs = spark.createDataFrame([(1, " 12 "), (2, "1-2"), (3, " ")], "nro_int_aluno_estado bigint, cpf string")
    cad = spark.createDataFrame([("12", "A"), ("", "B")], "cpf string, nome string")
    got = matching.merge_by_cpf_or_enrolment(docs.select("nro_int_aluno_estado"), docs, cad).collect()
    assert [(r.nro_int_aluno_estado, r.nome) for r in got] == [(1, "A")]


def test_collisions_ignore_case(spark):
    left = spark.createDataFrame([("1", "a", "x")], "k string, Nome string, so_a string")
    right = spark.createDataFrame([("1", "b", "y")], "k string, NOME string, so_b string")
    assert matching.merge_on(left, right, "k").columns == ["k", "Nome_ALUNO", "so_a", "NOME_CADUNICO", "so_b"]


def test_find_cpf_column():
    assert columns.find_cpf_column(["x", "CPF_ALUNO", "cpf"]) == "cpf"
    assert columns.find_cpf_column(["x", "Num_Cpf_Titular"]) == "Num_Cpf_Titular"
    with pytest.raises(ValueError):
        columns.find_cpf_column(["nome"])


def test_ensure_standard_cpf_again(spark):
    df = spark.createDataFrame([("1-2",)], "CPF_PADRONIZADO string")
    assert columns.ensure_standard_cpf(df).first()[0] == "12"


def test_alias_projection(spark):
    df = spark.createDataFrame([("1", "A", "z")], ["p.num_cpf_pessoa", "p.nom_pessoa", "extra"])
    got = columns.select_aliases(df, ["NOME", "extra", "COD_CPF", "COD_NIS", "nada"])
    assert got.columns == ["NOME", "extra", "COD_CPF"]
    both = columns.select_aliases(df, ["NOME", "NOME_PESSOA"])
    assert both.columns == ["NOME", "NOME_PESSOA"]
    assert columns.keep_known_as_raw(df).columns == df.columns
    assert columns.keep_known_as_raw(got).columns == ["p.nom_pessoa", "p.num_cpf_pessoa"]


def test_cpf_conflicts(spark):
    rows = [(1, "Ana", "m", D1, "111"), (2, "ANA ", "m", D1, "1.11"), (3, "Bia", "m", D1, "222"), (4, "Eva", "m", D1, "222"),
            (5, "Zoe", "m", D1, "444"), (6, "Lia", "m", D1, "444")]
    cad = people(spark, [(1, "222", "Éva", D1, 1.0), (2, "222", "BIA", D2, 1.0), (3, "111", "x", D1, 1.0)])
    got = matching.cpf_conflicts(students_of(spark, rows), cad).orderBy("matricula").collect()
    assert [(r.matricula, r.manter) for r in got] == [(3, True), (4, False)]


def test_history(spark):
    ddl = "matricula bigint, cpf string, mesano string"
    before = spark.createDataFrame([(1, "11", "202506"), (2, "22", "202506"), (3, "33", "202506")], ddl)
    now = spark.createDataFrame([(2, "44", "202507"), (4, "11", "202507")], ddl)
    total = history.accumulate(before, now)
    assert sorted(map(tuple, total.select("matricula", "cpf").collect())) == [(1, "11"), (2, "44"), (3, "33"), (4, "11")]
    assert sorted(r.matricula for r in history.inactive(total, now).collect()) == [1, 3]
    assert sorted((r.cpf, r.matricula) for r in history.unique_cpf(total).collect()) == [("11", 4), ("33", 3), ("44", 2)]


def test_manual_roster_yields_to_automatic(spark):
    auto = spark.createDataFrame([(1, "a")], "matricula bigint, cpf string")
    manual = spark.createDataFrame([(1, "z"), (2, "y")], "matricula bigint, cpf string")
    got = history.with_manual_roster(auto, manual).orderBy("matricula").collect()
    assert [(r.matricula, r.cpf, r.origem) for r in got] == [(1, "a", "AUTOMATICO"), (2, "y", "MANUAL")]


def test_reconcile(spark):
    ddl = "k int, v string, w string"
    a = spark.createDataFrame([(1, "a", None), (2, "b", "q"), (3, "c", "q")], ddl)
    b = spark.createDataFrame([(1, "a", None), (2, "x", "q"), (4, "d", None)], ddl)
    assert sorted(map(tuple, reconcile.compare_status(a, b, "k", ["v", "w"]).collect())) == [
        ("differs", 1), ("only_a", 1), ("only_b", 1), ("same", 1)]
    assert sorted(map(tuple, reconcile.compare_columns(a, b, "k", ["v", "w"]).collect())) == [("v", 1), ("w", 0)]
    assert tuple(reconcile.compare_key_sets(a, b, "k").first()) == (2, 1, 1, 0.666667)


def test_family_responsible(spark):
    ddl = "row_id bigint, cpf string, cod_fam string, cod_parentesco int, nome string, dat_atual_fam date"
    cad = registry.with_standard_cpf(spark.createDataFrame([
        (1, "1", "F", 1, "old head", D1), (2, "2", "F", 1, "head", D2), (3, None, "F", 3, "child", D3),
        (4, None, "G", 1, "head without id", D1), (5, "5", None, 2, "no family", D1), (6, None, None, 2, "nobody", D1),
    ], ddl))
    got = layout.with_responsible(cad, cad).orderBy("row_id").collect()
    assert [(r.row_id, r.cpf_resp, r.origem_cpf) for r in got] == [
        (1, "2", "PROPRIO"), (2, "2", "PROPRIO"), (3, "2", "RESPONSAVEL"),
        (4, None, "NENHUM"), (5, None, "PROPRIO"), (6, None, "NENHUM")]


def test_eligible_by_any_enrolment(spark):
    enrol = "matricula bigint, nro_int_turma bigint, nro_int_situacao int, nro_int_calend_estab bigint, idt_estab bigint"
    enrolments = spark.createDataFrame([
        (1, 1, 1, 1, 1),                    # 25 years, I2: too old ...
        (1, 2, 8, 1, 1),                    # ... but S2 allows 29
        (2, 1, 1, 1, 1),                    # 25 years, only I2
        (3, 1, 2, 1, 1),                    # situation not active
        (4, 1, 1, 2, 1),                    # calendar closed
        (5, 1, 1, 1, 2), (6, 1, 1, 1, 3), (7, 1, 1, 1, 4),  # prison, unknown kind, designation
        (8, 3, 1, 1, 1),                    # other teaching type
        (9, 1, 1, 1, 1), (9, 1, 8, 1, 1),   # young, twice
    ], enrol)
    classes = spark.createDataFrame([(1, "I2"), (2, "S2"), (3, "XX")], "nro_int_turma bigint, cd_tipo_ensino string")
    calendars = spark.createDataFrame([(1, D1, dt.date(2025, 7, 31)), (2, D1, dt.date(2025, 7, 30))],
                                      "nro_int_calend_estab bigint, dt_inicio date, dt_fim date")
    schools = spark.createDataFrame([(1, "N", 1), (2, "S", 1), (3, None, 1), (4, "N", 489)],
                                    "idt_estab bigint, in_esc_prisional string, nro_int_designacao int")
    old, young = dt.date(2000, 6, 1), dt.date(2010, 6, 1)
    pupils = spark.createDataFrame([(i, old if i < 3 else young) for i in range(1, 10)], "matricula bigint, dt_nascimento date")
    got = students.eligible_students(enrolments, classes, calendars, schools, pupils, F.lit(dt.date(2025, 7, 31)))
    assert sorted(r.matricula for r in got.collect()) == [1, 9]
