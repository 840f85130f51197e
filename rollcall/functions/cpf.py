"""Person-id (CPF) column expressions. A CPF is text, never a number."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CPF_LENGTH = 11


def _or_null(text: Column) -> Column:
    """``text``, null when empty.

    It names ``text`` once: ``nullif`` and ``when`` name it twice, and filters on the result that
    Spark moves into the scan would take out the digits of every row again for each name.
    """
    return F.get(F.array_remove(F.array(text), ""), F.lit(0))


def cpf_digits(cpf: Column) -> Column:
    """Only the digits; null when there are none, so that such rows never join."""
    return _or_null(F.regexp_replace(cpf.cast("string"), "[^0-9]", ""))


# Ids that stand for no person: only zeros, or one digit eleven times.
NO_PERSON = r"^(0+|([0-9])\2{10})$"


def person_cpf(cpf: Column) -> Column:
    """The digits of an id that can stand for one person, else null: it then matches and merges nobody."""
    digits = F.regexp_replace(cpf.cast("string"), "[^0-9]", "")
    return _or_null(F.regexp_replace(digits, NO_PERSON, ""))


def cpf_trimmed(cpf: Column) -> Column:
    """The text without surrounding blanks, mask kept."""
    return F.trim(cpf.cast("string"))


def cpf_canonical(cpf: Column) -> Column:
    """Digits padded with leading zeros to full length; longer ids stay as they are."""
    digits = cpf_digits(cpf)
    return F.when(F.length(digits) < CPF_LENGTH, F.lpad(digits, CPF_LENGTH, "0")).otherwise(digits)


def _check_digit(number: Column, count: int) -> Column:
    """Mod-11 check digit over the first ``count`` of 11 digits, weights count+1 down to 2."""
    weighted = [_digit(number, i) * F.lit(count + 1 - i) for i in range(count)]
    rest = reduce(add, weighted) % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def _digit(number: Column, place: int) -> Column:
    """The digit at ``place`` (0 is the leftmost) of an 11-digit number."""
    return F.floor(number / F.lit(10 ** (CPF_LENGTH - 1 - place))) % 10


def cpf_check_ok(digits: Column) -> Column:
    """Whether 11 digits have the right check digits and are not one repeated digit.

    Digits must come from ``cpf_digits``; any other length is not right.
    """
    number = F.when(F.length(digits) == CPF_LENGTH, digits.try_cast("bigint"))
    ok = (
        (number % 11111111111 != 0)
        & (_digit(number, 9) == _check_digit(number, 9))
        & (_digit(number, 10) == _check_digit(number, 10))
    )
    return F.coalesce(ok, F.lit(False))


USUAL_FORMS = r"^([0-9]{11}|[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2})$"


def with_cpf_quality(df: DataFrame, cpf: str, name: str = "qualidade") -> DataFrame:
    """Adds one quality class per id: the first that applies, in this order.

    ``missing`` no digits; ``zeroed`` only zeros; ``incomplete`` fewer than 11 digits;
    ``invalid`` more than 11 digits or wrong check digits; ``irregular_format`` neither
    11 plain digits nor the usual mask; ``valid``. The digits are taken out once, in a
    step of their own.
    """
    digits = F.col("_digitos")
    quality = (
        F.when(digits.isNull(), "missing")
        .when(digits.rlike("^0+$"), "zeroed")
        .when(F.length(digits) < CPF_LENGTH, "incomplete")
        .when(~cpf_check_ok(digits), "invalid")
        .when(~F.col(cpf).rlike(USUAL_FORMS), "irregular_format")
        .otherwise("valid")
    )
    return df.select("*", cpf_digits(F.col(cpf)).alias("_digitos")).withColumn(name, quality).drop("_digitos")
