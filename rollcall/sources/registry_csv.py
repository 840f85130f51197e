"""The registry file: raw scan, versioned read, cached table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.cpf import person_cpf
from rollcall.functions.period import iso_date
from rollcall.functions.text import latin1_to_cp1252
from rollcall.operators.columns import STANDARD_CPF, quoted, rename_columns, select_aliases
from rollcall.operators.keys import first_per_key
from rollcall.operators.row_ids import with_content_ids
from rollcall.schema import REGISTRY_DEFAULT_COLUMNS, REGISTRY_RENAMES, REGISTRY_SCAN_COLUMNS
from rollcall.workdir import path_exists

CPF_COLUMN = "p.num_cpf_pessoa"
UPDATED_COLUMN = "d.dat_atual_fam"


def read_raw_csv(
    spark: SparkSession, path: str | Sequence[str], sep: str = ";", encoding: str = "ISO-8859-1"
) -> DataFrame:
    """Every column as text, names from the header, one task per input split.

    All files must have the same columns in the same order: a file whose header differs is an
    error, never read by position (read such files one by one and put them together with
    ``history.union_versions``). Short lines are padded with nulls and long ones cut, none is dropped. Empty fields are
    null, quoted or not. windows-1252 is read as ISO-8859-1, which keeps all bytes, and the differing letters put right.
    """
    is_cp1252 = encoding.lower().replace("-", "") in ("windows1252", "cp1252", "1252")
    df = (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("encoding", "ISO-8859-1" if is_cp1252 else encoding)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .option("escape", '"')
        .csv(path)
    )
    if is_cp1252:
        df = df.select(*[latin1_to_cp1252(quoted(c)).alias(c) for c in df.columns])
    return df


def scan_registry(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] = REGISTRY_SCAN_COLUMNS,
    renames: Mapping[str, str] = REGISTRY_RENAMES,
    encoding: str = "ISO-8859-1",
) -> DataFrame:
    """A column subset of the raw file under the cached table's names, with the standard id."""
    raw = read_raw_csv(spark, path, encoding=encoding)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"registry file lacks columns {missing}")
    df = rename_columns(raw.select(*[quoted(c) for c in columns]), renames)
    cpf = renames.get(CPF_COLUMN, CPF_COLUMN)
    return df.withColumn(STANDARD_CPF, person_cpf(quoted(cpf))) if cpf in df.columns else df


def read_registry_version(
    spark: SparkSession,
    version: str,
    versions: Mapping[str, str],
    columns: Sequence[str] = REGISTRY_DEFAULT_COLUMNS,
    keep_duplicates: bool = False,
    encoding: str = "windows-1252",
) -> DataFrame:
    """A registry file by version name (or path), columns by alias, newest row per person.

    Ids are text, so leading zeros stay. Rows without an id are never duplicates. Ties on
    the update date go to the lower social number, then to the whole row's hash.
    """
    raw = read_raw_csv(spark, versions.get(version, version), encoding=encoding)
    if not keep_duplicates:
        keyed = raw.select(
            "*",
            person_cpf(quoted(CPF_COLUMN)).alias("_cpf"),
            F.xxhash64(*[quoted(c) for c in raw.columns]).alias("_hash"),
        )
        newest = iso_date(quoted(UPDATED_COLUMN)).desc_nulls_last()
        order = [newest, quoted("p.num_nis_pessoa_atual").asc(), F.asc("_hash")]
        raw = first_per_key(keyed, F.col("_cpf"), order, keep_null=True)
    return select_aliases(raw, columns)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, in order of preference."""
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(paths)} exists")


def cached_registry(
    spark: SparkSession, parquet_path: str, csv_paths: Sequence[str], refresh: bool = False
) -> DataFrame:
    """The registry table, built from the first existing file unless it is already there.

    Only a table whose write was committed counts as there: an interrupted build is redone.
    """
    if refresh or not path_exists(spark, f"{parquet_path}/_SUCCESS"):
        scan_registry(spark, first_existing(spark, csv_paths)).write.mode("overwrite").parquet(parquet_path)
    return spark.read.parquet(parquet_path)


def typed_registry(raw: DataFrame, row_id: Column | None = None) -> DataFrame:
    """Raw text columns as the typed columns the operators use.

    Income becomes a number here, once, so later income filters reach the Parquet scan.
    ``row_id`` is a number that is unique in the file, if it has one; the social number is
    not, a person may be there several times. By default ids are made from the rows' content
    (``row_ids.with_content_ids``), so they are the same in every scan, split and batch.
    """
    if row_id is None:
        raw = with_content_ids(raw, "_row_id")
    text = {
        "cpf": CPF_COLUMN,
        "nome": "p.nom_pessoa",
        "nis": "p.num_nis_pessoa_atual",
        "nome_mae": "p.nom_completo_mae_pessoa",
        "cod_fam": "d.cod_familiar_fam",
        "cd_ibge": "d.cd_ibge",
        "cep": "d.num_cep_logradouro_fam",
        "tipo_end": "d.nom_tip_logradouro_fam",
        "titulo_end": "d.nom_titulo_logradouro_fam",
        "nome_end": "d.nom_logradouro_fam",
        "num_end": "d.num_logradouro_fam",
        "complem_1": "d.des_complemento_fam",
        "complem_2": "d.des_complemento_adic_fam",
        "bairro": "d.nom_localidade_fam",
        "ddd_contato1": "d.num_ddd_contato_1_fam",
        "num_tel_contato1": "d.num_tel_contato_1_fam",
        "ddd_contato2": "d.num_ddd_contato_2_fam",
        "num_tel_contato2": "d.num_tel_contato_2_fam",
    }
    return raw.select(
        (F.col("_row_id") if row_id is None else row_id).alias("row_id"),
        *[quoted(source).alias(name) for name, source in text.items() if source in raw.columns],
        person_cpf(quoted(CPF_COLUMN)).alias("cpf_std"),
        iso_date(quoted("p.dta_nasc_pessoa")).alias("dta_nasc"),
        quoted("p.cod_parentesco_rf_pessoa").try_cast("int").alias("cod_parentesco"),
        quoted("d.vlr_renda_media_fam").try_cast("double").alias("renda_media"),
        iso_date(quoted(UPDATED_COLUMN)).alias("dat_atual_fam"),
    )
