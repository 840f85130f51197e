"""Where jobs put tables they write for themselves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine: on a cluster the
    executors would not see it, so there a missing setting is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier call has returned."""
    return f"{work_root(spark)}/rollcall/{name}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    """The file system that ``path`` belongs to, and the path as it knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on the file system it belongs to."""
    system, target = _located(spark, path)
    return system.exists(target)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, hidden ones and Spark's own left out; none if there is no such folder."""
    system, target = _located(spark, path)
    names = [status.getPath().getName() for status in system.listStatus(target)] if system.exists(target) else []
    return sorted(n for n in names if n[0] not in "._")


def read_head(spark: SparkSession, path: str, encoding: str, n: int = 1) -> list[str]:
    """Up to ``n`` first lines of a text file; the rest is not read."""
    system, target = _located(spark, path)
    java = spark.sparkContext._jvm.java.io
    reader = java.BufferedReader(java.InputStreamReader(system.open(target), encoding))
    try:
        lines = []
        while len(lines) < n and (line := reader.readLine()) is not None:
            lines.append(line)
        return lines
    finally:
        reader.close()


def make_empty_file(spark: SparkSession, path: str) -> None:
    """A new file without content; it is there as a whole or not at all."""
    system, target = _located(spark, path)
    system.create(target, False).close()


def delete_path(spark: SparkSession, path: str) -> None:
    system, target = _located(spark, path)
    system.delete(target, True)


def settle(df: DataFrame, name: str, **options) -> DataFrame:
    """The same rows as a table in the shared folder; ``options`` go to its writer.

    For results used more than once: they are computed once, and a lost executor costs no
    more than its own tasks. The shuffle files of the write are deleted with its end, so a
    job of many steps holds those of one step at a time.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.parquet(path)
    table.settled_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``settle`` wrote, once nothing reads it any more."""
    delete_path(table.sparkSession, table.settled_path)
