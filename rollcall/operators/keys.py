"""Grouping and joining by keys of which one may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.workdir import settle


def first_per_key(df: DataFrame, key: Column, order: Sequence[Column], keep_null: bool = False) -> DataFrame:
    """The first row of each key in ``order``, which should be a total order.

    ``row_number() = 1`` lets Spark drop all but the first row per key before the shuffle,
    so a hot key costs one row per map task. Rows without a key are dropped, or with
    ``keep_null`` all kept: each gets a number and with it a group of its own, so they
    spread evenly and none can displace another, whatever their columns hold.
    """
    if not keep_null:
        df = df.filter(key.isNotNull())
        group = [key]
    else:
        df = df.withColumn("_line", F.monotonically_increasing_id())
        group = [key, F.when(key.isNull(), F.col("_line"))]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_line")


def newest_row_ids(df: DataFrame, key: str, newest: str, row_id: str) -> DataFrame:
    """Per key the id of the row with the latest ``newest`` date, ties to the lowest id.

    Date and id form one fixed-width number, so Spark keeps the running maximum in a hash
    table, also before the shuffle, and sorts nothing. For when only the id is wanted of
    tables with long keys; ids are any 64-bit numbers, rows without a date come last.
    """
    width, half = F.lit(Decimal(2 * 10**19)), F.lit(Decimal(10**19))
    days = F.coalesce(F.unix_date(newest), F.lit(-10_000_000)).cast("decimal(10,0)")
    order = (days * width - F.col(row_id).cast("decimal(20,0)")).cast("decimal(38,0)")
    rest = F.pmod(-F.col("_order"), width)
    signed = F.when(rest >= half, rest - width).otherwise(rest)
    return df.groupBy(key).agg(F.max(order).alias("_order")).select(key, signed.cast("bigint").alias(row_id))


# Distinct keys, 8 bytes each, that a join sends to every task; more are shuffled.
MOST_SENT_KEYS = 4_000_000


def wanted_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Hashes of the distinct keys of a small table, written; for ``cut_to``."""
    keyed = df.dropna(subset=list(columns)).select(F.xxhash64(*columns).alias("_wanted"))
    return settle(keyed.distinct(), "wanted")


def cut_to(big: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``big`` whose key is among ``wanted_keys``, before anything ranks or shuffles them.

    Up to ``MOST_SENT_KEYS`` keys are counted and sent to the tasks that scan ``big``, which is
    then read once and not shuffled; with more of them the semi join shuffles the columns of
    ``big`` that are in use. Types of the key must be the same on both sides. A row with another
    key of the same 64-bit hash stays: the join on the key itself that follows drops it. Rows
    without a key have a hash that no key has; a test for null of its own would compute the key twice.
    """
    few = wanted.count() <= MOST_SENT_KEYS
    hashed = big.withColumn("_wanted", F.xxhash64(*columns))
    return hashed.join(F.broadcast(wanted) if few else wanted, "_wanted", "left_semi").drop("_wanted")


def join_per_key(left: DataFrame, right: DataFrame, key: str, how: str, row_id: str) -> DataFrame:
    """Join on ``key``, compared as text; ``right`` has at most one row per key, ``left`` many.

    ``right`` is written to the shared folder first, so cut it to the keys of ``left`` before
    (``cut_to``). Both sides are then read and shuffled for this join alone, and AQE splits a
    key with many left rows by its size; after an aggregate or window on the key it would not.
    """
    return join_written(left, settle(right, "per-key"), key, how, row_id)


def join_written(left: DataFrame, right: DataFrame, key: str, how: str, row_id: str) -> DataFrame:
    """``join_per_key`` with a ``right`` that is a written table, or a scan without aggregates.

    In outer and anti joins left rows without a key would all meet in one task; here each
    gets a key of its own made from the unique column ``row_id``, which matches nothing.
    """
    join_key = F.col(key).cast("string")
    right = right.withColumn("_key", join_key).drop(key)
    if how in ("left", "left_anti"):
        join_key = F.coalesce(join_key, F.concat(F.lit("\u0000"), F.col(row_id).cast("string")))
    return left.withColumn("_key", join_key).join(right, "_key", how).drop("_key")
