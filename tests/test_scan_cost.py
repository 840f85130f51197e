"""Work per registry row and per task, whatever the size of the tables."""

import pytest
from pyspark.sql import functions as F

from rollcall.operators.keys import cut_to, wanted_keys
from rollcall.operators.registry import latest_with_cpf, with_standard_cpf
from rollcall.registered import files


def test_digits_are_taken_out_few_times_per_row(spark, tmp_path):
    rows = [(i, f"{i:011d}" if i % 3 else None, "2024-01-01") for i in range(40)]
    spark.createDataFrame(rows, "row_id long, cpf string, day string").select("*", F.to_date("day").alias("dat_atual_fam")).write.parquet(f"{tmp_path}/r")
    people = with_standard_cpf(spark.read.parquet(f"{tmp_path}/r"))
    wanted = wanted_keys(people.filter("row_id < 20"), "cpf_std")
    found = latest_with_cpf(cut_to(people, wanted, "cpf_std"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # two replacements for the column and two for the test for null that Spark moves into the scan
    assert plan.count("regexp_replace(") + plan.count("RLIKE") <= 4, plan
    assert sorted(r.row_id for r in found.collect()) == [i for i in range(20) if i % 3]


@pytest.fixture
def many_rows(spark, monkeypatch):
    # column values of the view do not matter here, only how many files and tasks its rows make
    columns = ", ".join(f"cast(id as string) as `{c}`" for c in files.RAW)
    monkeypatch.setattr(files, "PART_ROWS", 100, raising=False)
    monkeypatch.setattr(files, "FAULTY", "cast(row_id as string)")
    monkeypatch.setattr(files, "view", lambda *_: spark.range(1000).select(F.col("id").alias("row_id")))
    monkeypatch.setattr(files, "raw_registry", lambda *_: spark.range(999).selectExpr(*columns.split(", ")))


def test_files_of_the_faulty_registry_grow_in_number(spark, many_rows):
    lines = spark.read.text(files._faulty_files(spark, "")).select("value", F.col("_metadata.file_path").alias("file"))
    sizes = [r.n for r in lines.groupBy("file").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 14 and max(sizes) <= 101 and sum(sizes) == 1014


def test_tasks_of_the_second_order_grow_in_number(spark, many_rows, monkeypatch):
    seen = []

    def ids(df):
        seen.append(df.rdd.getNumPartitions())
        return df.select(F.col("`p.num_nis_pessoa_atual`").alias("row_id"))

    monkeypatch.setattr(files, "with_content_ids", ids)
    files.registry_row_ids(spark, "").collect()
    assert seen[1] == 7 + 13
