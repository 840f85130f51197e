"""Row ids, faulty lines, mixed layouts and the table built from registry files."""

import pytest
from pyspark.sql import functions as F

from rollcall.fixtures import view
from rollcall.operators.registry import income_filter
from rollcall.operators.row_ids import with_content_ids
from rollcall.registered.files import raw_registry
from rollcall.schema import INCOME_CUT
from rollcall.sinks import files as sink
from rollcall.sources import registry_csv, registry_files

SF = "/root/testdata/sf0.001"
HEADER = "p.num_cpf_pessoa;p.nom_pessoa;x"


def write(path, text, encoding="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def ids_of(df):
    return sorted(r.row_id for r in df.select("row_id").collect())


def test_ids_are_the_same_in_any_split_order_and_batch(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 1000).cast("string").alias("a"), F.when(F.col("id") % 7 != 0, "x").alias("b"))
    path = sink.write_csv(rows.coalesce(1), str(tmp_path / "r"))
    read = lambda: registry_csv.read_raw_csv(spark, path, encoding="UTF-8")
    seen = []
    for size in ("1000000", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            raw = read()
            seen.append((raw.rdd.getNumPartitions(), ids_of(with_content_ids(raw))))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (few, one), (many, other) = seen
    assert few < many and one == other and len(set(one)) == 3000
    assert ids_of(with_content_ids(read().repartition(5).orderBy(F.desc("a")))) == one
    # a batch of its own gives a row the id that it has among all
    part = read().filter("a < '2'").dropDuplicates()
    assert set(ids_of(with_content_ids(part))) <= set(one)


def test_equal_rows_null_and_empty(spark):
    rows = [(None, "a"), ("a", None), ("", "a"), (None, "a"), ("a", ""), ("\u0000", "a")]
    df = spark.createDataFrame(rows * 50 + [("single", "row")], "x string, y string")
    got = with_content_ids(df)
    assert got.columns == ["x", "y", "row_id"] and len(set(ids_of(got))) == 301
    assert with_content_ids(df.limit(0)).count() == 0
    only = with_content_ids(spark.createDataFrame([("single", "row")], "x string, y string")).first().row_id
    assert only == got.filter("x = 'single'").first().row_id


def test_one_content_in_a_third_of_the_rows_is_not_gathered(spark):
    df = spark.range(30_000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a"))
    got = with_content_ids(df)
    assert got.select("row_id").distinct().count() == 30_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan  # numbered per part that read them


def test_lines_that_are_no_rows(spark, tmp_path):
    lines = ["1;São João;a", "2;short", "3;long;b;c;d", '4;"quoted; field";e', '5;"open;f', "", "6;;", '7;"two ""q""";g']
    write(tmp_path / "in/r.csv", "\n".join([HEADER, *lines]) + "\n")
    divided = registry_files.divide_registry(spark, str(tmp_path / "in"))
    assert sorted(map(tuple, divided.rows.collect()), key=str) == sorted(
        [("1", "São João", "a"), ("4", "quoted; field", "e"), ("6", None, None), ("7", 'two "q"', "g")], key=str)
    assert sorted((r.linha, r.motivo, r.campos) for r in divided.rejects.collect()) == [
        ("2;short", "campos_a_menos", 2), ("3;long;b;c;d", "campos_a_mais", 5), ('5;"open;f', "aspas", None)]
    assert all(r.arquivo.endswith("r.csv") for r in divided.rejects.collect())
    assert {r.motivo: r.linhas for r in divided.counts().collect()} == {"aceita": 4, "campos_a_menos": 1, "campos_a_mais": 1, "aspas": 1}
    padded = registry_files.divide_registry(spark, str(tmp_path / "in"), pad_short=True)
    assert ("2", "short", None) in map(tuple, padded.rows.collect()) and padded.rejects.count() == 2
    # the same when columns are pruned
    assert divided.rows.select("x").count() == 4


def test_every_line_is_a_row_or_rejected_in_any_split(spark, tmp_path):
    body = [f"{i};n{i}" + (";x" if i % 3 else "") + (";y" if i % 7 == 0 else "") for i in range(5000)]
    write(tmp_path / "in/r.csv", "\n".join([HEADER, *body]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        divided = registry_files.divide_registry(spark, str(tmp_path / "in"))
        assert divided.rows.count() + divided.rejects.count() == 5000
        fits = [line for line in body if line.count(";") == 2]
        assert divided.rows.count() == len(fits)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_of_several_layouts(spark, tmp_path):
    write(tmp_path / "in/a.csv", "p.num_cpf_pessoa;p.nom_pessoa\n111;ANA\n")
    write(tmp_path / "in/b.csv", "p.nom_pessoa;p.num_cpf_pessoa\nBIA;222\n")
    write(tmp_path / "in/deep er/c.csv", '"p.nom_pessoa";d.cd_ibge\nCAIO;43\nDORA;44;1\n')
    write(tmp_path / "in/d.csv", "p.num_cpf_pessoa;p.nom_pessoa\n333;EVA\n")
    write(tmp_path / "in/empty.csv", "")
    layouts = registry_files.files_by_header(spark, str(tmp_path / "in"))
    assert sorted((len(names), len(files)) for names, files in layouts.items()) == [(2, 1), (2, 1), (2, 2)]
    divided = registry_files.divide_registry(spark, str(tmp_path / "in"))
    got = divided.rows.select("`p.num_cpf_pessoa`", "`p.nom_pessoa`", "`d.cd_ibge`")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("111", "ANA", None), ("222", "BIA", None), (None, "CAIO", "43"), ("333", "EVA", None)], key=str)
    assert [(r.linha, r.campos) for r in divided.rejects.collect()] == [("DORA;44;1", 3)]
    write(tmp_path / "twice/e.csv", "a;A\n1;2\n")
    with pytest.raises(ValueError, match="repeated"):
        registry_files.divide_registry(spark, str(tmp_path / "twice"))


def test_windows_1252_rows_and_rejects(spark, tmp_path):
    write(tmp_path / "in/r.csv", f"{HEADER}\n1;“Zé”;€\n2;D’Ávila\n", "cp1252")
    divided = registry_files.divide_registry(spark, str(tmp_path / "in"), encoding="windows-1252")
    assert [tuple(r) for r in divided.rows.collect()] == [("1", "“Zé”", "€")]
    assert [r.linha for r in divided.rejects.collect()] == ["2;D’Ávila"]


def test_table_follows_its_files(spark, tmp_path):
    source, table = str(tmp_path / "csv"), str(tmp_path / "table")
    rows = raw_registry(spark, SF).limit(60).coalesce(1)
    sink.write_csv(rows, f"{source}/june", encoding="ISO-8859-1")
    first = registry_files.build_registry_table(spark, table, source)
    assert first.count() == 60 and len(set(ids_of(first))) == 60
    again = registry_files.build_registry_table(spark, table, source)
    assert again.inputFiles() == first.inputFiles()  # nothing has changed
    sink.write_csv(rows.limit(5).withColumn("p.nom_pessoa", F.lit("NOVA")), f"{source}/july", encoding="ISO-8859-1")
    assert registry_files.build_registry_table(spark, table, source).count() == 65  # a file was added
    sink.write_csv(rows.limit(7), f"{source}/july", encoding="ISO-8859-1")
    replaced = registry_files.build_registry_table(spark, table, source)  # replaced, some rows there twice
    assert replaced.count() == 67 and len(set(ids_of(replaced))) == 67 and set(ids_of(first)) <= set(ids_of(replaced))
    write(tmp_path / "csv/bad.csv", "p.nom_pessoa;p.num_cpf_pessoa\n1;2;3\n")
    registry_files.build_registry_table(spark, table, source)
    assert [r.motivo for r in registry_files.rejected_lines(spark, table).collect()] == ["campos_a_mais"]
    (tmp_path / "csv/broken.csv").write_text("a;a\n")
    with pytest.raises(ValueError):
        registry_files.build_registry_table(spark, table, source)
    assert first.sparkSession.read.parquet(*replaced.inputFiles()).count() == 67  # the old files are still there


def test_typed_rows_reach_the_filters(spark, tmp_path):
    source = sink.write_csv(raw_registry(spark, SF), str(tmp_path / "csv"), encoding="ISO-8859-1")
    table = registry_files.build_registry_table(spark, str(tmp_path / "table"), source)
    plan = income_filter(table)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(renda_media,660.0)" in plan
    assert income_filter(table).count() == view(spark, SF, "registry").filter(f"renda_media <= {INCOME_CUT}").count()
