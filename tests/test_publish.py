"""Publishing a run as a whole."""

import pytest
from pyspark.sql import functions as F

from rollcall.fixtures import PERIOD, view
from rollcall.plans import monthly
from rollcall.plans.beneficiaries import publish_beneficiaries
from rollcall.registered.files import BENEFICIARY_TABLES, MONTH_TABLES
from rollcall.sinks import publish as publishing
from rollcall.workdir import list_names, path_exists

SF = "/root/testdata/sf0.001"


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def values(spark, out, output, period="202507"):
    return sorted(r.v for r in publishing.read_published(spark, out, period, output).collect())


def test_a_run_that_dies_between_two_outputs_leaves_the_old_month(spark, tmp_path):
    out = str(tmp_path / "out")
    publishing.publish_tables(spark, out, "202507", {"a": numbers(spark, 1), "b": numbers(spark, 2)})
    broken = numbers(spark, 9).select(F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        publishing.publish_tables(spark, out, "202507", {"a": numbers(spark, 3), "b": broken})
    assert values(spark, out, "a") == [1] and values(spark, out, "b") == [2]
    assert len(list_names(spark, f"{out}/runs/202507")) == 2
    assert len(publishing.sweep(spark, out, "202507")) == 1
    publishing.publish_tables(spark, out, "202507", {"a": numbers(spark, 3), "b": numbers(spark, 4)})
    assert values(spark, out, "a") == [3] and values(spark, out, "b") == [4]


def test_readers_keep_their_files_until_the_sweep(spark, tmp_path):
    out = str(tmp_path / "out")
    publishing.publish_tables(spark, out, "202507", {"a": numbers(spark, 1)})
    reader = publishing.read_published(spark, out, "202507", "a")
    for v in range(2, 13):  # more than nine markers: numbers compare as numbers
        publishing.publish_tables(spark, out, "202507", {"a": numbers(spark, v)})
    assert reader.first().v == 1 and values(spark, out, "a") == [12]
    publishing.sweep(spark, out, "202507", keep=2)
    assert len(list_names(spark, f"{out}/runs/202507")) == len(list_names(spark, f"{out}/published/202507")) == 2
    assert values(spark, out, "a") == [12]


def test_what_is_not_complete_is_not_published(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="nothing"):
        publishing.publish(spark, out, "202507", lambda folder: None)

    def half(folder):
        numbers(spark, 1).write.parquet(f"{folder}/a")
        (tmp_path / "out/runs/202507" / folder.rsplit("/", 1)[1] / "b").mkdir()

    with pytest.raises(ValueError, match="'b'"):
        publishing.publish(spark, out, "202507", half)
    with pytest.raises(FileNotFoundError):
        publishing.published_folder(spark, out, "202507")
    assert publishing.published_periods(spark, out) == []


def test_periods_are_apart_and_may_be_empty(spark, tmp_path):
    out = str(tmp_path / "out")
    publishing.publish_tables(spark, out, "202506", {"a": numbers(spark, 6)})
    publishing.publish_tables(spark, out, "202507", {"a": numbers(spark).limit(0)})
    assert publishing.published_periods(spark, out) == ["202506", "202507"]
    assert values(spark, out, "a", "202506") == [6] and values(spark, out, "a") == []


def test_month_and_beneficiaries_are_published_as_a_whole(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "month")
    tables = {n: view(spark, SF, n) for n in {*MONTH_TABLES, *BENEFICIARY_TABLES}}
    paths = monthly.publish_month(spark, tables, PERIOD, out)
    rows = {n: spark.read.parquet(p).count() for n, p in paths.items() if n != "cpf_invalidos"}
    assert rows["pessoas_unicas"] > 0 and rows["metricas"] == 1 and path_exists(spark, paths["cpf_invalidos"])

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(monthly, "invalid_cpf_rows", lost)  # after three of five outputs
    with pytest.raises(RuntimeError, match="lost"):
        monthly.publish_month(spark, {**tables, "registry": tables["registry"].limit(0).unionByName(tables["registry"].limit(50))}, PERIOD, out)
    folder = publishing.published_folder(spark, out, PERIOD)
    assert {n: spark.read.parquet(f"{folder}/{n}").count() for n in rows} == rows
    written = publish_beneficiaries(spark, tables, PERIOD, str(tmp_path / "run"))
    assert written["layout"].startswith(publishing.published_folder(spark, str(tmp_path / "run"), PERIOD))
    assert spark.read.parquet(written["mapeados"]).count() > 0
