"""The registry laid out by id, the bucketed incremental base, two-step comparison, file heads, observed counts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rollcall.fixtures import PERIOD, view
from rollcall.operators import matching, reconcile
from rollcall.operators.registry import latest_per_person, with_standard_cpf
from rollcall.plans import monthly
from rollcall.registered.files import MONTH_TABLES
from rollcall.sources.files import head_rows
from rollcall.sources.registry_by_id import store_by_id
from rollcall.streaming import buckets

SF = "/root/testdata/sf0.001"
D1, D2, D3 = (dt.date(2025, m, 1) for m in (1, 2, 3))
REGISTRY = "row_id bigint, cpf string, nome string, dat_atual_fam date"


def people(spark, rows):
    return with_standard_cpf(spark.createDataFrame(rows, REGISTRY))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("query", ["unique_with_latest", "merge_with_latest", "unmatched_with_latest", "conflicts_with_latest"])
def test_joins_by_id_do_not_shuffle_the_registry(spark, tmp_path, no_broadcast, query):
    rng = random.Random(2)
    cad = people(spark, [(i, str(rng.randrange(100, 400)) if i % 9 else None, f"N{rng.randrange(5)}", rng.choice([D1, D2, D3])) for i in range(2000)])
    pupils = with_standard_cpf(spark.createDataFrame([(i, f"N{i % 5}", str(rng.randrange(50, 300)) if i % 7 else "0") for i in range(300)], "matricula bigint, nm_aluno string, cpf string")).drop("cpf")
    latest = store_by_id(cad.drop("cpf"), f"latest_{query}", str(tmp_path / "latest"), buckets=8)
    assert latest.count() == cad.select("cpf_std").dropna().distinct().count()
    got = getattr(matching, query)(pupils, latest)
    plain = {"unique_with_latest": matching.unique_persons, "merge_with_latest": matching.merge_newest, "unmatched_with_latest": matching.unmatched, "conflicts_with_latest": matching.cpf_conflicts}[query](pupils, cad.drop("cpf"))
    columns = sorted(set(got.columns) & set(plain.columns))
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, plain.select(columns).collect()), key=str) != []
    # conflicts write the few shared ids with their registry row, so the join itself is looked at
    planned = matching.shared_ids(pupils).join(latest, "cpf_std") if query == "conflicts_with_latest" else got
    lines = planned._jdf.queryExecution().executedPlan().toString().split("\n")
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and f"latest_{query}" in line]
    assert scans
    for at in scans:
        depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
        for line in reversed(lines[:at]):
            here = len(line) - len(line.lstrip(" :+-"))
            if here < depth:
                depth = here
                assert "Exchange" not in line
                if "Join" in line:
                    break


def arrivals(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", None, "0", *map(str, range(1, 60))]), f"n{i}", rng.choice([D1, D2, D3, None])) for i in range(400)]
    return [rows[:250], rows[250:260], rows[260:]]


def test_base_is_the_same_in_any_batches_and_order(spark, tmp_path):
    parts = arrivals(spark)
    whole = sorted(map(tuple, latest_per_person(people(spark, [r for p in parts for r in p])).collect()), key=str)
    for name, order in (("a", [0, 1, 2]), ("b", [2, 0, 1])):
        base = str(tmp_path / name)
        for batch_id, i in enumerate(order):
            buckets.merge_batch(people(spark, parts[i]), batch_id, base, 8)
            buckets.merge_batch(people(spark, parts[i]), batch_id, base, 8)  # run again after a failure
        got = buckets.read_buckets(spark, base)
        assert sorted(map(tuple, got.select("row_id", "cpf", "nome", "dat_atual_fam", "cpf_std").collect()), key=str) == whole


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    base = str(tmp_path / "base")
    buckets.merge_batch(people(spark, [(i, str(1000 + i), "x", D1) for i in range(300)]), 0, base, 32)
    before = set(buckets.read_buckets(spark, base).inputFiles())
    buckets.merge_batch(people(spark, [(900, "1007", "new", D2), (901, None, "no id", D2)]), 1, base, 32)
    after = set(buckets.read_buckets(spark, base).inputFiles())
    folders = lambda files: {f.rsplit("/", 1)[0] for f in files}
    assert len(folders(before) - folders(after)) == 1 and len(folders(after) - folders(before)) == 2
    assert len(folders(before) & folders(after)) == len(folders(before)) - 1
    got = {r.cpf_std: r.nome for r in buckets.read_buckets(spark, base).collect()}
    assert got["1007"] == "new" and got[None] == "no id" and len(got) == 301
    assert buckets.sweep_buckets(spark, base) == []  # the first batch still has buckets in use
    buckets.merge_batch(people(spark, [(5000 + i, str(1000 + i), "y", D3) for i in range(300)]), 2, base, 32)
    assert len(buckets.sweep_buckets(spark, base)) == 1 and buckets.read_buckets(spark, base).count() == 301


def test_a_batch_that_dies_leaves_the_base(spark, tmp_path):
    base = str(tmp_path / "base")
    buckets.merge_batch(people(spark, [(1, "11", "a", D1)]), 0, base, 4)
    broken = people(spark, [(2, "11", "b", D2)]).withColumn("nome", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        buckets.merge_batch(broken, 1, base, 4)
    assert [r.nome for r in buckets.read_buckets(spark, base).collect()] == ["a"]
    buckets.merge_batch(people(spark, []), 1, base, 4)
    with pytest.raises(FileNotFoundError):
        buckets.read_buckets(spark, str(tmp_path / "none"))


def test_two_step_comparison_equals_the_plain_one(spark):
    rng = random.Random(9)
    ddl = "k bigint, v string, w double, x string"
    make = lambda part: spark.createDataFrame([(i, rng.choice(["a", "b", None, ""]), rng.choice([1.0, 2.0, None]), rng.choice(["", None])) for i in range(300) if i % part], ddl)
    a, b = make(7), make(5)
    parts = reconcile.final_analysis(a, b, "k", ["v", "w", "x"])
    plain = reconcile.compare_rows(a, b, "k", ["v", "w", "x"])
    assert sorted(map(tuple, parts["chaves"].collect())) == sorted(map(tuple, plain.select("k", "status").collect()))
    expected = {(r.k, c) for r in plain.collect() for c in "vwx" if r[f"{c}_difere"]}
    assert {(r.k, r.coluna) for r in parts["diferencas"].collect()} == expected != set()
    assert sum(r.linhas for r in parts["resumo"].collect()) == plain.count()
    one = parts["diferencas"].filter("coluna = 'w'").first()
    sides = {r.k: r.w for r in a.collect()}, {r.k: r.w for r in b.collect()}
    assert [None if x is None else float(x) for x in (one.valor_a, one.valor_b)] == [s[one.k] for s in sides]


def test_comparing_with_an_empty_output(spark):
    a = spark.createDataFrame([(1, "a")], "k bigint, v string")
    parts = reconcile.final_analysis(a, a.limit(0), "k", ["v"])
    assert [tuple(r) for r in parts["resumo"].collect()] == [("only_a", 1, 1.0)] and parts["diferencas"].count() == 0


def test_head_of_a_file_reads_its_first_lines_only(spark, tmp_path):
    path = tmp_path / "big file.csv"
    with path.open("w", encoding="latin-1") as out:
        out.write('a;"b;b";c\n1;"x;y";São\n\n2;;z\n3;only\n' + "9;9;9\n" * 200_000)
    got = head_rows(spark, str(path), 4)
    assert got.columns == ["linha", "a", "b;b", "c"]
    assert [tuple(r) for r in got.orderBy("linha").collect()] == [(1, "1", "x;y", "São"), (2, "2", None, "z"), (3, "3", "only", None)]
    assert "FileScan" not in got._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "empty.csv").write_text("")
    assert head_rows(spark, str(tmp_path / "empty.csv")).count() == 0


def test_month_counts_ids_while_writing_and_aggregates_once(spark, tmp_path, monkeypatch):
    tables = {n: view(spark, SF, n) for n in MONTH_TABLES}
    calls = []
    counted = monthly.merge_metrics
    monkeypatch.setattr(monthly, "merge_metrics", lambda *a: calls.append(1) or counted(*a))
    row = monthly.run_month(spark, tables, PERIOD, str(tmp_path / "m")).first()
    assert len(calls) == 1 and row.alunos_total > 0 and row.cad_com_cpf > 0
    none = {**tables, "registry": tables["registry"].withColumn("cpf", F.lit("000.000.000-00"))}
    with pytest.raises(ValueError, match="registry"):
        monthly.run_month(spark, none, PERIOD, str(tmp_path / "n"))
    assert len(calls) == 1 and not (tmp_path / "n").exists()  # known before anything was merged or written
