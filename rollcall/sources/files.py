"""Looking at files before loading them: delimiter, preview, trailer lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.functions.text import split_fields
from rollcall.operators.columns import quoted
from rollcall.schema import DELIMITERS
from rollcall.workdir import read_head


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with the file they come from and their place in it."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("arquivo"),
        F.col("_metadata.file_block_start").alias("bloco"),
        F.monotonically_increasing_id().alias("linha"),
    )


def delimiter_profile(lines: DataFrame, column: str = "value", candidates: Sequence[str] = DELIMITERS) -> DataFrame:
    """How often each candidate occurs in all lines, the most frequent one marked.

    Equal counts go to the candidate named first.
    """
    text = F.col(column)
    names = [f"d{i}" for i in range(len(candidates))]
    counts = lines.agg(
        *[
            F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit(d), F.lit("")))), F.lit(0)).alias(n)
            for n, d in zip(names, candidates)
        ]
    )
    most = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    chosen = F.lit(candidates[-1])
    for name, candidate in reversed(list(zip(names, candidates))):
        chosen = F.when(F.col(name) == most, candidate).otherwise(chosen)
    rows = F.array(
        *[F.struct(F.lit(d).alias("delimitador"), F.col(n).alias("ocorrencias")) for n, d in zip(names, candidates)]
    )
    return (
        counts.select(chosen.alias("_escolhido"), F.explode(rows).alias("r"))
        .select("r.delimitador", "r.ocorrencias", (F.col("r.delimitador") == F.col("_escolhido")).cast("int").alias("escolhido"))
    )


def inspect_header(df: DataFrame, order: str, n: int = 3) -> DataFrame:
    """Column names with their place and the first ``n`` values, rows by ``order``."""
    number = F.row_number().over(Window.orderBy(quoted(order)))
    sample = df.orderBy(quoted(order)).limit(n).withColumn("linha", number)
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("posicao"), F.lit(c).alias("coluna"), quoted(c).cast("string").alias("valor"))
            for i, c in enumerate(df.columns, 1)
        ]
    )
    return sample.select("linha", F.explode(cells).alias("c")).select("linha", "c.*")


def preview(df: DataFrame, order: str, n: int = 200, shown: int = 5) -> DataFrame:
    """The first ``shown`` rows and the number of rows a preview of ``n`` would hold."""
    top = df.orderBy(quoted(order)).limit(n)
    size = top.agg(F.count(F.lit(1))).scalar()
    return top.orderBy(quoted(order)).limit(shown).withColumn("linhas_previa", size)


def trailer_records(lines: DataFrame, sep: str = ";") -> DataFrame:
    """The last line of each file, also of files read in many splits, and its fields.

    One pass: each task reduces its split to one line per file, the last by place, before
    anything is shuffled. Line numbers are only compared within the scan that gave them;
    another scan may cut the files differently.
    """
    last = lines.groupBy("arquivo").agg(F.max_by("value", F.struct("bloco", "linha")).alias("trailer"))
    return last.withColumn("campos", split_fields(F.col("trailer"), sep))


def trailer_check(
    lines: DataFrame, detail_mark: str, value_field: int, count_field: int, sum_field: int, sep: str = ";"
) -> DataFrame:
    """Per file the trailer's declared count and sum against its detail lines.

    Fields count from 0; detail lines start with ``detail_mark``. Amounts are whole numbers; a
    file with an amount that is none (``valores_ilegiveis`` counts them) does not agree.
    """
    amount = F.get(split_fields(F.col("value"), sep), F.lit(value_field)).try_cast("bigint")
    detail = (
        lines.filter(F.col("value").startswith(detail_mark + sep))
        .groupBy("arquivo")
        .agg(F.count(F.lit(1)).alias("linhas"), F.sum(amount).alias("soma"), F.count_if(amount.isNull()).alias("valores_ilegiveis"))
    )
    declared = trailer_records(lines, sep).select(
        "arquivo",
        F.get("campos", F.lit(count_field)).try_cast("bigint").alias("linhas_declaradas"),
        F.get("campos", F.lit(sum_field)).try_cast("bigint").alias("soma_declarada"),
    )
    ok = F.col("linhas").eqNullSafe(F.col("linhas_declaradas")) & F.col("soma").eqNullSafe(F.col("soma_declarada"))
    ok = ok & F.coalesce(F.col("valores_ilegiveis") == 0, F.lit(True))
    return declared.join(detail, "arquivo", "left").withColumn("confere", ok.cast("int"))


def head_rows(spark: SparkSession, path: str, n: int = 200, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """The first ``n`` rows of a delimited file in file order, all columns as text and ``linha`` from 1.

    Only these lines are read, whatever the size of the file: they pass the driver, so ``n``
    should stay small. Blank lines are no rows, empty fields are null, a quoted field ends in its line.
    """
    lines = read_head(spark, path, encoding, n + 1)
    if not lines:
        return spark.createDataFrame([], "linha int")
    rows = spark.createDataFrame([(i, line) for i, line in enumerate((x for x in lines[1:] if x.strip()), 1)], "linha int, value string")
    names = spark.createDataFrame([(lines[0].removeprefix("\ufeff"),)], "value string").select(split_fields(F.col("value"), sep)).first()[0]
    fields = split_fields(F.col("value"), sep)
    cells = [F.nullif(F.get("_fields", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(names)]
    return rows.select("linha", fields.alias("_fields")).select("linha", *cells)
