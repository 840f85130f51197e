"""Registry files that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rollcall.operators.registry import latest_per_person, with_standard_cpf


def start_ingest(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    base: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    file_format: str = "parquet",
    prepare: Callable[[DataFrame], DataFrame] = with_standard_cpf,
    **options: str,
) -> StreamingQuery:
    """Read the files not yet seen and add each batch's newest rows to ``base``.

    ``prepare`` makes ``row_id``, ``cpf_std`` and ``dat_atual_fam`` of a batch's columns, for
    raw CSV files with ``registry_csv.typed_registry``, whose row ids don't depend on the batch. A batch only writes its own
    partition, replaced when the batch is run again after a failure, so every row counts
    once and no earlier data is rewritten. ``read_base`` settles which row is newest over
    all batches.
    """
    def add_batch(batch: DataFrame, batch_id: int) -> None:
        latest_per_person(prepare(batch)).write.mode("overwrite").parquet(f"{base}/lote={batch_id}")

    # a CSV file whose header differs from the schema is an error, never read by position
    reader = spark.readStream.format(file_format).schema(schema).options(enforceSchema=False, **options)
    arriving = reader.option("maxFilesPerTrigger", files_per_batch).load(source)
    return (
        arriving.writeStream.foreachBatch(add_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_base(spark: SparkSession, base: str) -> DataFrame:
    """The newest row per person over all batches, equal to one batch over all files."""
    return latest_per_person(spark.read.parquet(base).drop("lote"))


def compact_base(spark: SparkSession, base: str, target: str) -> DataFrame:
    """The settled base as the first batch of a new folder, to keep reads short."""
    read_base(spark, base).write.mode("overwrite").parquet(f"{target}/lote=-1")
    return spark.read.parquet(target)
