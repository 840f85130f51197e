"""Choosing and naming columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.cpf import person_cpf
from rollcall.schema import COLUMN_DICTIONARY

STANDARD_CPF = "CPF_PADRONIZADO"
# Names an id column may have.
CPF_CANDIDATES = ("cpf", "CPF", "CPF_ALUNO", "CPF_CADUNICO", "p.num_cpf_pessoa", "num_cpf_pessoa")


def quoted(name: str) -> Column:
    """A column by its exact name; raw registry names contain dots."""
    return F.col(f"`{name}`")


def select_aliases(
    df: DataFrame, wanted: Sequence[str], dictionary: Mapping[str, str] = COLUMN_DICTIONARY
) -> DataFrame:
    """The wanted columns in the wanted order, given by alias or raw name.

    An alias is looked up in the dictionary and names the result; anything the table
    does not have is left out.
    """
    present = set(df.columns)
    raw = {name: dictionary.get(name, name) for name in dict.fromkeys(wanted)}
    return df.select(*[quoted(source).alias(name) for name, source in raw.items() if source in present])


def keep_known_as_raw(df: DataFrame, dictionary: Mapping[str, str] = COLUMN_DICTIONARY) -> DataFrame:
    """Only the dictionary's aliases, renamed to raw names; all columns if none is present."""
    known = [c for c in df.columns if c in dictionary]
    return df.select(*[quoted(c).alias(dictionary[c]) for c in known]) if known else df


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Without these columns; names the table does not have are ignored."""
    return df.drop(*names)


def keep_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    present = set(df.columns)
    return df.select(*[quoted(c) for c in names if c in present])


def find_cpf_column(columns: Sequence[str], candidates: Sequence[str] = CPF_CANDIDATES) -> str:
    """The first candidate present, else the first name that contains "cpf"."""
    for name in candidates:
        if name in columns:
            return name
    for name in columns:
        if re.search("cpf", name, re.IGNORECASE):
            return name
    raise ValueError(f"no CPF column among {list(columns)}")


def ensure_standard_cpf(df: DataFrame, candidates: Sequence[str] = CPF_CANDIDATES) -> DataFrame:
    """The table with ``CPF_PADRONIZADO``: digits only, null when there are none or the id stands for no person."""
    source = STANDARD_CPF if STANDARD_CPF in df.columns else find_cpf_column(df.columns, candidates)
    return df.withColumn(STANDARD_CPF, person_cpf(quoted(source)))


def suffix_collisions(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Both tables with a suffix on every non-key name they share.

    Names that differ only in case also collide: Spark resolves them to the same column.
    """
    key_names = {k.lower() for k in keys}
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    shared -= key_names

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.toDF(*[c + suffix if c.lower() in shared else c for c in df.columns])

    return renamed(left, suffixes[0]), renamed(right, suffixes[1])
