"""Registry files as they come: several layouts, faulty lines, and the table built from them."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.text import latin1_to_cp1252, split_fields
from rollcall.operators.columns import quoted
from rollcall.operators.history import union_versions
from rollcall.sinks.publish import publish, published_folder, read_published
from rollcall.sources.registry_csv import typed_registry
from rollcall.workdir import read_head, settle

LINE, FILE = "_linha", "_arquivo"
HEADER_READERS = 16


def list_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``arquivo``, ``bytes`` and ``alterado`` of the files under a path, a pattern or several; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("arquivo"), F.col("length").alias("bytes"), F.col("modificationTime").alias("alterado"))


def files_by_header(spark: SparkSession, path: str | Sequence[str], sep: str = ";", encoding: str = "ISO-8859-1") -> dict[tuple[str, ...], list[str]]:
    """The files of each layout by its column names. One line is read of each file, empty files are left out."""
    files = [row.arquivo for row in list_files(spark, path).filter("bytes > 0").orderBy("arquivo").toLocalIterator()]
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        firsts = list(pool.map(lambda file: "".join(read_head(spark, file, encoding)), files))
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, first in zip(files, firsts, strict=True):
        names = tuple(name.strip().strip('"') for name in first.removeprefix("﻿").split(sep))
        if len({name.lower() for name in names}) < len(names) or not all(names):
            raise ValueError(f"{file} has empty or repeated column names: {list(names)}")
        layouts.setdefault(names, []).append(file)
    return layouts


@dataclass(frozen=True)
class Divided:
    """Registry lines read once and written: those that fit their file's layout, and the rest."""

    table: DataFrame

    @property
    def rows(self) -> DataFrame:
        """All columns of all layouts as text, null where a file lacks one."""
        return self.table.filter("_motivo is null").drop(LINE, FILE, "_motivo", "_campos")

    @property
    def rejects(self) -> DataFrame:
        """``arquivo``, ``linha`` as it was, ``motivo`` and the number of fields (null for a broken quote)."""
        return self.table.filter("_motivo is not null").select(
            F.col(FILE).alias("arquivo"), F.col(LINE).alias("linha"), F.col("_motivo").alias("motivo"), F.col("_campos").alias("campos")
        )

    def counts(self) -> DataFrame:
        """Lines by reason, ``aceita`` for those that are rows; together they are all lines but headers and blank ones."""
        return self.table.groupBy(F.coalesce("_motivo", F.lit("aceita")).alias("motivo")).agg(F.count(F.lit(1)).alias("linhas"))


def divide_registry(
    spark: SparkSession, path: str | Sequence[str], sep: str = ";", encoding: str = "ISO-8859-1", pad_short: bool = False
) -> Divided:
    """Read registry files of any mix of layouts in one pass and keep what is no row of its layout.

    A line is a row if it has as many fields as its file's header. ``campos_a_mais`` and
    ``campos_a_menos`` have more or fewer, ``aspas`` an opening quote that is not closed. With
    ``pad_short`` lines with fewer fields are rows too, nulls in the place of what they lack.
    Files are grouped by their header, each group is read by its own names, and the groups are
    united by name. Empty fields are null, quoted or not. Without any file there are no columns.
    """
    cp1252 = encoding.lower().replace("-", "") in ("windows1252", "cp1252", "1252")
    read_as = "ISO-8859-1" if cp1252 else encoding
    parts = [_divided(spark, names, files, sep, read_as, cp1252, pad_short) for names, files in files_by_header(spark, path, sep, read_as).items()]
    if not parts:
        return Divided(spark.createDataFrame([], f"{LINE} string, {FILE} string, _motivo string, _campos int"))
    return Divided(settle(union_versions(*parts), "divided"))


def _divided(spark: SparkSession, names: Sequence[str], files: list[str], sep: str, encoding: str, cp1252: bool, pad_short: bool) -> DataFrame:
    schema = ", ".join(f"`{name}` string" for name in (*names, LINE))
    df = (
        spark.read.schema(schema)
        .options(sep=sep, header=True, encoding=encoding, mode="PERMISSIVE", escape='"', columnPruning=False)
        .option("columnNameOfCorruptRecord", LINE)
        .csv(files)
    )
    if cp1252:
        df = df.select(*[latin1_to_cp1252(quoted(c)).alias(c) for c in df.columns], F.col("_metadata"))
    fields = F.size(split_fields(F.col(LINE), sep))
    quotes = F.length(LINE) - F.length(F.replace(F.col(LINE), F.lit('"'), F.lit("")))
    reason = F.when(quotes % 2 == 1, "aspas").when(fields > len(names), "campos_a_mais").when(fields < len(names), "campos_a_menos").otherwise("ilegivel")
    marked = df.select(*[quoted(c) for c in df.columns if c != "_metadata"], F.col("_metadata.file_path").alias(FILE), F.when(F.col(LINE).isNotNull(), reason).alias("_motivo"), fields.alias("_campos"))
    if pad_short:
        marked = marked.withColumn("_motivo", F.when(F.col("_motivo") != "campos_a_menos", F.col("_motivo")))
    unread = F.col("_motivo") != "aspas"
    return marked.withColumn("_campos", F.when(unread, F.col("_campos")))


def build_registry_table(spark: SparkSession, table: str, path: str | Sequence[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """The typed registry of all files under ``path``, built if it isn't there or the files have changed.

    Published as a whole with its rejected lines and the list of files it was made of
    (``rows``, ``rejects``, ``files``). A file that was added, replaced or taken away, by size
    or time, makes it be built again; as long as that runs, and if it dies, readers have the
    old table. Row ids depend on the rows' content only.
    """
    files = settle(list_files(spark, path), "files")
    if not _same_files(spark, table, files):

        def build(folder: str) -> None:
            divided = divide_registry(spark, path, encoding=encoding)
            typed_registry(divided.rows).write.parquet(f"{folder}/rows")
            divided.rejects.write.parquet(f"{folder}/rejects")
            files.write.parquet(f"{folder}/files")

        publish(spark, table, "registry", build)
    return read_published(spark, table, "registry", "rows")


def rejected_lines(spark: SparkSession, table: str) -> DataFrame:
    """The lines that the published table's files have and it has not."""
    return read_published(spark, table, "registry", "rejects")


def _same_files(spark: SparkSession, table: str, files: DataFrame) -> bool:
    try:
        published_folder(spark, table, "registry")
    except FileNotFoundError:
        return False
    known = read_published(spark, table, "registry", "files")
    return files.exceptAll(known).isEmpty() and known.exceptAll(files).isEmpty()
