"""Query results as tables: JDBC in production, named DataFrames anywhere."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def lake_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The result of a SQL text; ``{name}`` in it stands for the table of that name."""
    return spark.sql(sql, **tables)


def jdbc_options(
    connection: Mapping[str, str],
    sql: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    num_partitions: int = 64,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options for a SQL text read in parallel ranges of ``partition_column``.

    ``connection`` comes from the job's configuration and never from this code. Rows
    outside ``bounds`` are read too, by the first and last range.
    """
    options = dict(connection)
    options["fetchsize"] = str(fetch_size)
    if partition_column is None:
        options["query"] = sql
        return options
    if bounds is None:
        raise ValueError("bounds are needed to read by ranges")
    options.update(
        dbtable=f"({sql}) lote",
        partitionColumn=partition_column,
        lowerBound=str(bounds[0]),
        upperBound=str(bounds[1]),
        numPartitions=str(num_partitions),
    )
    return options


def read_jdbc(
    spark: SparkSession,
    connection: Mapping[str, str],
    sql: str,
    partition_column: str | None = None,
    num_partitions: int = 64,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A SQL text on the lake; with ``partition_column`` as parallel range reads.

    The range bounds are one aggregate that the database computes.
    """
    def load(options: Mapping[str, str]) -> DataFrame:
        return spark.read.format("jdbc").options(**options).load()

    bounds = None
    if partition_column:
        ends = f"select min({partition_column}) lo, max({partition_column}) hi from ({sql}) faixa"
        low, high = load(jdbc_options(connection, ends)).first()
        if low is None:
            return load(jdbc_options(connection, sql))
        bounds = (int(low), int(high) + 1)
    return load(jdbc_options(connection, sql, partition_column, bounds, num_partitions, fetch_size))
