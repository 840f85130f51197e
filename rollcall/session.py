"""Session defaults for the jobs in this package."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.showConsoleProgress": "false",
}


def shuffle_partitions(shuffle_bytes: int, target_bytes: int = 256 * 2**20, least: int = 200) -> int:
    """Enough partitions for a shuffle of this size to fit executor memory."""
    return max(least, -(-shuffle_bytes // target_bytes))


def build_session(
    app_name: str = "rollcall", master: str | None = None, shuffle_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with this package's defaults; ``conf`` entries win over them.

    Keys are passed with underscores for dots (``spark_sql_shuffle_partitions="8"``).
    ``shuffle_bytes`` is the largest shuffle to expect, about the size of the columns a
    join needs of the larger table; AQE merges partitions that turn out small. Without it
    the cluster's own setting holds.
    """
    if shuffle_bytes is not None:
        conf.setdefault("spark_sql_shuffle_partitions", str(shuffle_partitions(shuffle_bytes)))
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
