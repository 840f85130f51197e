"""An incremental base of which a batch rewrites only what it touches.

Rows are in buckets by person id. A batch merges its rows into the buckets of its ids and
writes these anew; a list of the folders that make up the base is published with them as a
whole, so readers see the base before or after a batch, and a batch that dies leaves no
trace. Rows without an id can't replace one another; each batch adds a folder of its own with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rollcall.operators.registry import latest_per_person, with_standard_cpf
from rollcall.sinks.publish import publish, published_folder, read_published
from rollcall.workdir import delete_path, list_names, settle

BUCKETS = 256
NO_ID = -1
NAME = "base"


def _in_buckets(df: DataFrame, buckets: int) -> DataFrame:
    bucket = F.when(F.col("cpf_std").isNull(), F.lit(NO_ID)).otherwise(F.pmod(F.xxhash64("cpf_std"), F.lit(buckets)))
    return df.withColumn("balde", bucket.cast("int"))


def _parts(spark: SparkSession, base: str) -> DataFrame | None:
    """``balde``, ``pasta`` and ``lote`` of the folders that make up the base, none before the first batch."""
    try:
        published_folder(spark, base, NAME)
    except FileNotFoundError:
        return None
    return read_published(spark, base, NAME, "partes")


def merge_batch(batch: DataFrame, batch_id: int, base: str, buckets: int = BUCKETS) -> None:
    """Merge one batch into ``base``; a batch that is there already changes nothing.

    Reads the batch and the buckets of its ids, at most ``buckets`` names pass the driver.
    ``buckets`` must stay the same for a base.
    """
    spark = batch.sparkSession
    parts = _parts(spark, base)
    if parts is not None and parts.filter(F.col("lote") >= batch_id).count():
        return
    newest = settle(_in_buckets(latest_per_person(batch), buckets), "batch")
    touched = sorted(row.balde for row in newest.select("balde").distinct().collect())
    if not touched:
        return
    old = [] if parts is None else parts.collect()
    kept = [row for row in old if row.balde == NO_ID or row.balde not in touched]
    merged = newest
    replaced = [f"{row.pasta}/balde={row.balde}" for row in old if row.balde != NO_ID and row.balde in touched]
    if replaced:
        known = _in_buckets(spark.read.parquet(*replaced), buckets).select(newest.columns)
        with_id = latest_per_person(newest.filter(F.col("balde") != NO_ID).unionByName(known))
        merged = with_id.unionByName(newest.filter(F.col("balde") == NO_ID))

    def build(folder: str) -> None:
        # several tasks per bucket, one only where it is small
        merged.repartition("balde", F.pmod(F.xxhash64("row_id"), F.lit(4))).write.partitionBy("balde").parquet(f"{folder}/linhas")
        rows = [(row.balde, row.pasta, row.lote) for row in kept] + [(k, f"{folder}/linhas", batch_id) for k in touched]
        # the newest batch is named even where all its buckets are replaced later
        spark.createDataFrame(rows, "balde int, pasta string, lote bigint").coalesce(1).write.parquet(f"{folder}/partes")

    publish(spark, base, NAME, build)


def read_buckets(spark: SparkSession, base: str) -> DataFrame:
    """The newest row per person over all batches; rows without an id are all there."""
    parts = _parts(spark, base)
    if parts is None:
        raise FileNotFoundError(f"no batch has been merged into {base}")
    folders = [f"{row.pasta}/balde={row.balde}" for row in parts.collect()]
    return spark.read.parquet(*folders)


def start_bucket_ingest(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    base: str,
    checkpoint: str,
    buckets: int = BUCKETS,
    files_per_batch: int = 1000,
    file_format: str = "parquet",
    prepare: Callable[[DataFrame], DataFrame] = with_standard_cpf,
    **options: str,
) -> StreamingQuery:
    """Read the files not yet seen and merge each batch into the buckets of its ids.

    Late files may come in any order: the newest update wins, whenever it arrives.
    """
    reader = spark.readStream.format(file_format).schema(schema).options(enforceSchema=False, **options)
    arriving = reader.option("maxFilesPerTrigger", files_per_batch).load(source)
    return (
        arriving.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(prepare(batch), batch_id, base, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sweep_buckets(spark: SparkSession, base: str) -> list[str]:
    """Delete folders of batches of which no bucket is in use any more; not while a batch is merged or a reader is at work."""
    used = {row.pasta.split("/")[-2] for row in _parts(spark, base).select("pasta").distinct().collect()}
    used.add(published_folder(spark, base, NAME).rsplit("/", 1)[1])
    gone = [name for name in list_names(spark, f"{base}/runs/{NAME}") if name not in used]
    for name in gone:
        delete_path(spark, f"{base}/runs/{NAME}/{name}")
    return gone
