"""Column expressions on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.functions import cpf, period, rates, text


def values(spark, rows, ddl, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*exprs).collect()]


def test_cpf_digits_and_canonical(spark):
    rows = [("123.456.789-09",), (" 12 ",), ("---",), ("",), (None,), ("123456789012",)]
    got = values(spark, rows, "cpf string", cpf.cpf_digits(F.col("cpf")), cpf.cpf_canonical(F.col("cpf")))
    assert got == [
        ("12345678909", "12345678909"),
        ("12", "00000000012"),
        (None, None),
        (None, None),
        (None, None),
        ("123456789012", "123456789012"),
    ]


def test_cpf_trim_keeps_mask(spark):
    assert values(spark, [(" 123.4-5 ",), (None,)], "cpf string", cpf.cpf_trimmed(F.col("cpf"))) == [("123.4-5",), (None,)]


@pytest.mark.parametrize(
    "value, expected",
    [
        (None, "missing"), ("", "missing"), ("abc", "missing"), ("0", "zeroed"), ("000.000.000-00", "zeroed"),
        ("1234", "incomplete"), ("123456789099", "invalid"), ("12345678900", "invalid"), ("11111111111", "invalid"),
        ("12345678909", "valid"), ("123.456.789-09", "valid"), ("123 456 789 09", "irregular_format"),
        ("111.444.777-35", "valid"), ("52998224725", "valid"), ("52998224724", "invalid"),
    ],
)
def test_cpf_quality(spark, value, expected):
    df = spark.createDataFrame([(value,)], "cpf string")
    assert cpf.with_cpf_quality(df, "cpf").first()["qualidade"] == expected


def test_normalise_name(spark):
    rows = [("  José\t da  Conceição ",), ("ÁÉÍÓÚ ãõ ç ñ Ü",), ("   ",), (None,)]
    got = values(spark, rows, "n string", text.normalise_name(F.col("n")))
    assert got == [("JOSE DA CONCEICAO",), ("AEIOU AO C N U",), (None,), (None,)]


def test_address_and_phone(spark):
    rows = [("RUA", None, " ", "A", "12", "51", "999"), (None, None, None, None, None, "51", None), ("R", "D", "X", "Y", "1", None, "7")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, ddd string, tel string")
    got = df.select(text.full_address(*[F.col(c) for c in "abcde"]), text.phone(F.col("ddd"), F.col("tel"))).collect()
    assert [tuple(r) for r in got] == [("RUA A 12", "51999"), (None, None), ("R D X Y 1", "7")]


def test_cp1252_letters(spark):
    original = "€ ‘aspas’ – São João …"
    as_latin1 = original.encode("cp1252").decode("latin-1")
    assert values(spark, [(as_latin1,)], "t string", text.latin1_to_cp1252(F.col("t"))) == [(original,)]


def test_period(spark):
    rows = [("202402",), ("202502",), ("202512",), ("202513",), ("20251",), ("abcdef",), ("202500",), (None,)]
    got = values(spark, rows, "p string", period.period_last_day(F.col("p")))
    assert [g[0] for g in got] == [
        dt.date(2024, 2, 29), dt.date(2025, 2, 28), dt.date(2025, 12, 31), None, None, None, None, None,
    ]
    assert period.reference_date("202402") == dt.date(2024, 2, 29)
    for bad in ("202413", "2024", "", None, "2024-1"):
        with pytest.raises(ValueError):
            period.reference_date(bad)


def test_age(spark):
    rows = [(dt.date(2025, 7, 31), dt.date(2004, 7, 31)), (dt.date(2025, 7, 31), dt.date(2004, 7, 29)),
            (dt.date(2025, 7, 31), dt.date(2025, 8, 1)), (dt.date(2025, 7, 31), None)]
    got = values(spark, rows, "d date, b date", period.age_in_years(F.col("d"), F.col("b")))
    # 7670 days / 365.25 is just below 21: a birthday counts a day or so late.
    assert [g[0] for g in got] == [20, 21, 0, None]


def test_months(spark):
    got = values(spark, [(2025, 7), (2025, 11)], "y int, m int", period.year_month(F.col("y"), F.col("m")))
    assert got == [("2025/07",), ("2025/11",)]


def test_rates(spark):
    rows = [(10, 3, 1), (0, 0, 0), (10, 30, 0), (10, 0, 2), (3, 1, 0), (None, 1, 1)]
    ratio = rates.attendance_ratio(F.col("a"), F.col("f"), F.col("j"))
    got = values(spark, rows, "a int, f int, j int", ratio, rates.clip_unit(ratio))
    assert got == [(0.8, 0.8), (None, None), (-2.0, 0.0), (1.2, 1.0), (0.6666667, 0.6666667), (None, None)]


def test_percent_text_rounds_up_on_doubles(spark):
    rows = [(0.07,), (0.57,), (1.0,), (0.0,), (None,)]
    assert [g[0] for g in values(spark, rows, "x double", rates.percent_text(F.col("x")))] == ["8%", "57%", "100%", "0%", None]


def test_split_fields(spark):
    rows = [('T;"a;b";3',), ("T;;x|y;",), ('"say ""hi""";z',), ("plain",), (None,)]
    got = [g[0] for g in values(spark, rows, "v string", text.split_fields(F.col("v"), ";"))]
    assert got == [["T", "a;b", "3"], ["T", "", "x|y", ""], ['say "hi"', "z"], ["plain"], None]
    assert values(spark, [("a|b;c",)], "v string", text.split_fields(F.col("v"), "|")) == [(["a", "b;c"],)]
