"""Sources, sinks and the streaming ingest on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.fixtures import PERIOD, view
from rollcall.operators.history import union_versions
from rollcall.plans.monthly import run_month
from rollcall.registered.files import MONTH_TABLES, RAW, raw_registry
from rollcall.schema import REGISTRY_SCAN_COLUMNS
from rollcall.session import shuffle_partitions
from rollcall.sinks import files as sink
from rollcall.sources import files as src
from rollcall.sources import lake, registry_csv
from rollcall.sources.roster import read_manual_roster
from rollcall.streaming import incremental
from rollcall.workdir import fresh_path, path_exists, work_root

SF = "/root/testdata/sf0.001"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_short_and_long_lines(spark, tmp_path):
    path = write(tmp_path / "r.csv", "p.num_cpf_pessoa;p.nom_pessoa;x\n1;São João;a\n2;short\n3;long;b;c;d\n", "latin-1")
    df = registry_csv.read_raw_csv(spark, path)
    assert df.columns == ["p.num_cpf_pessoa", "p.nom_pessoa", "x"] and {t for _, t in df.dtypes} == {"string"}
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "São João", "a"), ("2", "short", None), ("3", "long", "b")]
    # The same rows when columns are pruned.
    assert df.select("`p.num_cpf_pessoa`").count() == 3


def test_windows_1252(spark, tmp_path):
    path = write(tmp_path / "r.csv", "p.nom_pessoa;d.cd_ibge\nD’Ávila – “Zé”;€\n", "cp1252")
    assert tuple(registry_csv.read_raw_csv(spark, path, encoding="cp1252").first()) == ("D’Ávila – “Zé”", "€")


def test_version_read_keeps_newest_and_unidentified(spark, tmp_path):
    header = "p.num_cpf_pessoa;p.nom_pessoa;p.num_nis_pessoa_atual;d.dat_atual_fam;d.vlr_renda_media_fam\n"
    rows = ["001;OLD;1;2025-01-01;10", "0-01;NEW;2;2025-02-01;20", ";NONE;3;2025-01-01;1", ";NONE;3;2025-01-01;1",
            "7;TIE B;9;2025-01-01;1", "7;TIE A;8;2025-01-01;1", "7;BAD DATE;1;x;1"]
    path = write(tmp_path / "r.csv", header + "\n".join(rows) + "\n", "cp1252")
    got = registry_csv.read_registry_version(spark, "agosto", {"agosto": path}, ["NOME", "COD_CPF", "nada", "VLR_RENDA_MEDIA"])
    assert got.columns == ["NOME", "COD_CPF", "VLR_RENDA_MEDIA"]
    assert sorted(r.NOME for r in got.collect()) == ["NEW", "NONE", "NONE", "TIE A"]
    assert registry_csv.read_registry_version(spark, path, {}, ["NOME"], keep_duplicates=True).count() == 7


def test_scan_needs_its_columns(spark, tmp_path):
    path = write(tmp_path / "r.csv", "a;b\n1;2\n")
    with pytest.raises(ValueError, match="lacks columns"):
        registry_csv.scan_registry(spark, path)


def test_cache_is_built_once_and_only_if_committed(spark, tmp_path):
    csv = sink.write_csv(raw_registry(spark, SF).limit(20), str(tmp_path / "csv"), encoding="ISO-8859-1")
    table = str(tmp_path / "table")
    assert registry_csv.cached_registry(spark, table, ["/missing", csv]).count() == 20
    assert registry_csv.cached_registry(spark, table, ["/missing"]).count() == 20
    (tmp_path / "half").mkdir()
    assert registry_csv.cached_registry(spark, str(tmp_path / "half"), [csv]).count() == 20
    with pytest.raises(FileNotFoundError):
        registry_csv.cached_registry(spark, str(tmp_path / "other"), ["/missing"])
    assert set(RAW) > set(REGISTRY_SCAN_COLUMNS)


@pytest.mark.parametrize("delimiter", [",", ";", "|", "\t"])
def test_delimiter(spark, tmp_path, delimiter):
    path = write(tmp_path / "d.txt", "\n".join(delimiter.join(["a", "b", "c"]) for _ in range(5)) + "\n")
    got = {r.delimitador: (r.ocorrencias, r.escolhido) for r in src.delimiter_profile(src.read_lines(spark, path)).collect()}
    assert got.pop(delimiter) == (10, 1) and set(got.values()) == {(0, 0)}


def test_delimiter_ties_go_to_the_first(spark, tmp_path):
    path = write(tmp_path / "d.txt", "a;b|c\n")
    chosen = [r.delimitador for r in src.delimiter_profile(src.read_lines(spark, path)).collect() if r.escolhido]
    assert chosen == [";"]


def test_trailer_over_many_splits(spark, tmp_path):
    big = "\n".join(f"D;{i};{i % 7}" for i in range(30000)) + f"\nT;30000;{sum(i % 7 for i in range(30000))}\n"
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "big.txt", big)
    write(tmp_path / "in" / "small.txt", "D;1;5\nT;2;5")
    write(tmp_path / "in" / "unreadable.txt", "D;1;5\nD;2;x\nT;2;5")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = src.read_lines(spark, str(tmp_path / "in"))
        assert lines.rdd.getNumPartitions() > 8
        found = {r.arquivo.rsplit("/", 1)[1]: (r.trailer, r.campos) for r in src.trailer_records(lines).collect()}
        assert found["small.txt"] == ("T;2;5", ["T", "2", "5"])
        assert found["big.txt"][0] == big.rstrip("\n").rsplit("\n", 1)[1]
        checked = {r.arquivo.rsplit("/", 1)[1]: r.confere for r in src.trailer_check(lines, "D", 2, 1, 2).collect()}
        assert checked == {"big.txt": 1, "small.txt": 0, "unreadable.txt": 0}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bom_is_in_every_part(spark, tmp_path):
    df = spark.range(100).select("id", F.lit("São").alias("nome")).repartition(4)
    path = sink.write_csv(df, str(tmp_path / "bom"), bom=True)
    parts = list((tmp_path / "bom").glob("part-*.csv"))
    assert len(parts) == 4
    for part in parts:
        assert part.read_bytes().startswith(b"\xef\xbb\xbfid;nome\n")
    assert spark.read.csv(path, sep=";", header=True).columns == ["id", "nome"]


def test_csv_keeps_text_as_it_is(spark, tmp_path):
    rows = [("  padded  ", 'say "hi"; ok'), ("x", None)]
    df = spark.createDataFrame([*rows, (None, "")], "a string, b string")
    rows.append((None, None))
    back = registry_csv.read_raw_csv(spark, sink.write_csv(df, str(tmp_path / "c")), encoding="UTF-8")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_period_rerun_replaces_only_its_period(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "202506"), (2, "202507"), (3, "202507")], "k int, mesano string")
    sink.write_period(rows, path)
    sink.write_period(rows.filter("k = 3"), path)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 3]
    listed = sink.outputs_of_period(spark, path, "202507").collect()
    assert [r.linhas for r in listed] == [1] and "mesano=202507" in listed[0].arquivo
    plan = spark.read.parquet(path).filter("mesano = 202507")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mesano" in plan


def test_lists_of_tables_must_fit(spark, tmp_path):
    with pytest.raises(ValueError):
        sink.write_lists([spark.range(1)], ["a", "b"], str(tmp_path))
    with pytest.raises(ValueError):
        sink.write_lists([spark.range(1), spark.range(1)], ["a", "a"], str(tmp_path))


def test_manual_roster(spark, tmp_path):
    path = write(tmp_path / "m.csv", "matricula;cpf\n1;123.456\n;9\nx;9\n2;\n")
    assert sorted(map(tuple, read_manual_roster(spark, path).collect()), key=str) == [(1, "123456"), (2, None)]


def test_jdbc_options():
    connection = {"url": "jdbc:db:", "user": "someone"}
    assert lake.jdbc_options(connection, "select 1")["query"] == "select 1"
    options = lake.jdbc_options(connection, "select a from t", "a", (0, 100), 8)
    assert options["dbtable"] == "(select a from t) lote" and "query" not in options
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"], options["numPartitions"]) == (
        "a", "0", "100", "8")
    assert connection == {"url": "jdbc:db:", "user": "someone"}
    with pytest.raises(ValueError):
        lake.jdbc_options(connection, "select a from t", "a")


class FakeLake:
    """A reader that remembers its options; the aggregate query answers with ``bounds``."""

    def __init__(self, bounds):
        self.bounds, self.loads, self.current = bounds, [], {}

    read = property(lambda self: self)

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        self.current = options
        return self

    def load(self):
        self.loads.append(self.current)
        return self

    def first(self):
        return self.bounds


def test_jdbc_reads_in_ranges_between_the_bounds():
    connection = {"url": "jdbc:db:"}
    session = FakeLake((10, 99))
    lake.read_jdbc(session, connection, "select a from t", "a", num_partitions=4)
    assert "min(a)" in session.loads[0]["query"]
    assert (session.loads[1]["lowerBound"], session.loads[1]["upperBound"]) == ("10", "100")
    empty = FakeLake((None, None))
    lake.read_jdbc(empty, connection, "select a from t", "a")
    assert empty.loads[1]["query"] == "select a from t"
    whole = FakeLake(None)
    lake.read_jdbc(whole, connection, "select a from t")
    assert len(whole.loads) == 1


def test_typed_registry_numbers_rows(spark):
    raw = raw_registry(spark, SF).limit(50).withColumn("p.num_nis_pessoa_atual", F.lit("1"))
    typed = registry_csv.typed_registry(raw)
    assert typed.select("row_id").distinct().count() == 50
    assert dict(typed.dtypes)["renda_media"] == "double" and dict(typed.dtypes)["dat_atual_fam"] == "date"


def test_shuffle_partitions():
    assert shuffle_partitions(1) == 200
    assert shuffle_partitions(10 * 2**40) == 40960


def test_shared_folder_comes_from_the_session(spark):
    assert work_root(spark) == spark.conf.get("spark.checkpoint.dir")
    first, second = fresh_path(spark, "x"), fresh_path(spark, "x")
    assert first != second and first.startswith(work_root(spark)) and not path_exists(spark, first)


SCHEMA = "row_id bigint, cpf string, dat_atual_fam date"


def test_ingest_restarts_without_loss_or_double(spark, tmp_path):
    source, base, check = (str(tmp_path / n) for n in ("in", "base", "check"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def ingest():
        incremental.start_ingest(spark, source, SCHEMA, base, check, files_per_batch=1).awaitTermination()
        return sorted(r.row_id for r in incremental.read_base(spark, base).collect())

    d1, d2, d3 = (dt.date(2025, m, 1) for m in (1, 2, 3))
    arrive((1, "1-1", d2), (2, "22", d1), (3, None, d1))
    assert ingest() == [1, 2, 3]
    assert ingest() == [1, 2, 3]
    arrive((4, "11", d1), (5, "22", d3), (6, "", d1))
    arrive((7, "22", d2))
    assert ingest() == [1, 3, 5, 6]
    compacted = incremental.compact_base(spark, base, str(tmp_path / "compact"))
    assert sorted(r.row_id for r in compacted.collect()) == [1, 3, 5, 6]


def test_month_can_be_run_again(spark, tmp_path):
    tables = {n: view(spark, SF, n) for n in MONTH_TABLES}
    out = str(tmp_path / "month")
    first = run_month(spark, tables, PERIOD, out).collect()
    rows = spark.read.parquet(f"{out}/pessoas_unicas").count()
    assert rows == first[0]["pessoas_unicas"] > 0
    assert run_month(spark, tables, PERIOD, out).collect() == first
    one_each = spark.read.parquet(f"{out}/matriculas")
    assert one_each.count() == one_each.select("matricula").distinct().count()
    run_month(spark, tables, PERIOD, out, all_registry_rows=True)
    assert spark.read.parquet(f"{out}/matriculas").count() == first[0]["merge_linhas"]
    assert spark.read.parquet(f"{out}/pessoas_unicas").count() == rows
    with pytest.raises(ValueError):
        run_month(spark, tables, "2025-07", out)


def test_files_with_columns_in_another_order_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("p.num_cpf_pessoa;p.nom_pessoa\n111;ANA\n")
    (tmp_path / "b.csv").write_text("p.nom_pessoa;p.num_cpf_pessoa\nBIA;222\n")
    with pytest.raises(Exception, match="(?i)header"):
        registry_csv.read_raw_csv(spark, str(tmp_path)).collect()
    parts = [registry_csv.read_raw_csv(spark, str(tmp_path / name)) for name in ("a.csv", "b.csv")]
    both = union_versions(*parts)
    assert sorted(map(tuple, both.select("`p.num_cpf_pessoa`", "`p.nom_pessoa`").collect())) == [("111", "ANA"), ("222", "BIA")]
    assert both.count() == 2
