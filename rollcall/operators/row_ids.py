"""Row ids that depend on a row's content only, not on scans, splits or batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.operators.columns import quoted
from rollcall.operators.keys import MOST_SENT_KEYS
from rollcall.workdir import settle


def with_content_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds a 64-bit id, unique in the table, made from all columns and, for equal rows, their rank.

    A row has the same id however the files are split, in whichever order they are read and
    in whichever batch they come. Equal rows are interchangeable, so it doesn't matter which
    of them has which rank: they are numbered within the tasks that read them, with the
    counts of the tasks before added, and a content that many rows share is never gathered.
    Only hashes are shuffled to find equal rows; rows without an equal one are not.
    """
    # a null is not the same as an empty text, and keeps its place among the columns
    content = [F.coalesce(quoted(c).cast("string"), F.lit("\u0000")) for c in df.columns]
    marked = df.withColumn(name, F.xxhash64(*content))
    repeated = settle(marked.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(name), "repeated")
    number = repeated.count()
    if not number:
        return marked
    known = F.broadcast(repeated) if number <= MOST_SENT_KEYS else repeated
    # a second hash tells apart different rows that share the first one
    several = marked.join(known, name, "left_semi").select("*", F.xxhash64(F.lit(1), *content).alias("_second"), F.spark_partition_id().alias("_part"))
    several = settle(several, "several")
    same = [name, "_second"]
    per_part = several.groupBy(*same, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("_second").over(Window.partitionBy(name)) == F.col("_second")
    starts = per_part.select(*same, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), first.alias("_first"))
    within = F.row_number().over(Window.partitionBy(*same, "_part").orderBy(F.lit(0))) - 1
    ranked = several.withColumn("_rank", within).join(starts, [*same, "_part"]).withColumn("_rank", F.col("_before") + F.col("_rank"))
    own = F.when(F.col("_first") & (F.col("_rank") == 0), F.col(name)).otherwise(F.xxhash64(name, "_second", "_rank"))
    numbered = ranked.withColumn(name, own).select(*[quoted(c) for c in marked.columns])
    return marked.join(known, name, "left_anti").select(*[quoted(c) for c in marked.columns]).unionByName(numbered)
