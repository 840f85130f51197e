"""Running sums over very large groups without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def running_start(rows: DataFrame, group: list[str], weight: Column, name: str, bucket: Column, order: list[Column]) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the rows before it in its group, as ``name``.

    The order within a group is (``bucket``, ``order``) and must be total. Sums per bucket
    come first and are small; each row then only needs the rows of its own bucket. ``rows``
    are read twice, so they should be a written table. Group columns must not be null.
    """
    marked = rows.withColumn("_bucket", bucket).withColumn("_weight", weight.cast("long"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(*group, "_bucket").agg(F.sum("_weight").alias("_sum"))
    starts = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.join(starts, [*group, "_bucket"])
        .withColumn(name, (F.col("_before") + F.coalesce(F.sum("_weight").over(within), F.lit(0))).cast("long"))
        .drop("_bucket", "_weight", "_before")
    )


def shuffled(rows: DataFrame, group: list[str], weight: Column, name: str, uid: str, seed: int, buckets: int = BUCKETS) -> DataFrame:
    """``running_start`` in a pseudo-random order that is the same on every run."""
    hashed = F.xxhash64(F.col(uid), F.lit(seed))
    return running_start(rows, group, weight, name, F.pmod(F.shiftright(hashed, 20), F.lit(buckets)), [hashed, F.col(uid)])
