"""The registry's newest rows laid out by id, for joins that don't shuffle the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.operators.registry import latest_with_cpf

BUCKETS = 1024


def store_by_id(registry: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write the newest row of each id as table ``name`` at ``path``, in buckets by ``cpf_std``.

    Built once per registry version, with one shuffle that Spark limits to one row per id and
    task. The table has one row per id, so no bucket is larger for a hot id; rows without an id
    can't be joined by it and are left out. A join on ``cpf_std`` then shuffles its other side
    only, or sends it to all tasks if it is small.
    """
    latest = latest_with_cpf(registry).repartition(buckets, "cpf_std")
    writer = latest.write.bucketBy(buckets, "cpf_std").sortBy("cpf_std").mode("overwrite").option("path", path)
    writer.saveAsTable(name)
    return read_by_id(registry.sparkSession, name)


def read_by_id(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
