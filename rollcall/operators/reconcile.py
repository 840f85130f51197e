"""Comparing two outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.cpf import cpf_digits
from rollcall.operators.keys import cut_to, wanted_keys
from rollcall.workdir import settle


def compare_rows(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per key with ``status`` and, per column, whether the two sides differ.

    ``key`` is unique on each side. Two nulls are equal.
    """
    left = a.select(key, F.lit(1).alias("_in_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(key, F.lit(1).alias("_in_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    joined = left.join(right, key, "full_outer").select(
        "*", *[(both & ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))).alias(f"{c}_difere") for c in columns]
    )
    differs = F.lit(False)
    for column in columns:
        differs = differs | F.col(f"{column}_difere")
    status = (
        F.when(F.col("_in_b").isNull(), "only_a")
        .when(F.col("_in_a").isNull(), "only_b")
        .when(differs, "differs")
        .otherwise("same")
    )
    return joined.withColumn("status", status).drop("_in_a", "_in_b")


def compare_status(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Number of keys per status."""
    return compare_rows(a, b, key, columns).groupBy("status").agg(F.count(F.lit(1)).alias("linhas"))


def compare_columns(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column the number of keys in both outputs on which it differs."""
    counts = compare_rows(a, b, key, columns).agg(
        *[F.count_if(f"{c}_difere").alias(c) for c in columns]
    )
    return counts.unpivot([], list(columns), "coluna", "divergencias")


def compare_key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct ids are in both, only in A and only in B, and the agreement.

    Ids are compared by their digits; those without any are left out.

    Each side is reduced to its distinct keys before the shuffle.
    """
    a, b = (side.select(cpf_digits(F.col(key).cast("string")).alias(key)) for side in (a, b))
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    per_key = sides.dropna(subset=[key]).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per_key.agg(
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("em_comum"),
        F.count_if(F.col("b") == 0).alias("somente_a"),
        F.count_if(F.col("a") == 0).alias("somente_b"),
    ).withColumn("aderencia", F.round(F.try_divide("em_comum", F.col("em_comum") + F.col("somente_a")), 6))


def key_status(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``status`` per key from two hashes of each side's columns; no column itself is shuffled.

    ``key`` is unique on each side. Nulls are equal to nulls only.
    """
    def hashed(df: DataFrame, name: str) -> DataFrame:
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
        return df.select(key, F.struct(F.xxhash64(F.lit(0), *texts), F.xxhash64(F.lit(1), *texts)).alias(name))

    joined = hashed(a, "_a").join(hashed(b, "_b"), key, "full_outer")
    status = (
        F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("_a") == F.col("_b"), "same").otherwise("differs")
    )
    return joined.select(key, status.alias("status"))


def final_analysis(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Two outputs compared in two steps: keys by hash first, then the columns of keys that differ.

    ``chaves`` has the status of every key (a written table), ``resumo`` the keys per status and
    the agreement, ``diferencas`` one row per key and column that differs, with both values as text.
    """
    keys = settle(key_status(a, b, key, columns), "status")
    wanted = wanted_keys(keys.filter("status = 'differs'"), key)
    sides = [
        cut_to(df.select(key, *columns), wanted, key).select(key, F.array(*[F.col(c).cast("string") for c in columns]).alias(name))
        for df, name in ((a, "_a"), (b, "_b"))
    ]
    pairs = [
        F.struct(F.lit(c).alias("coluna"), F.get("_a", F.lit(i)).alias("valor_a"), F.get("_b", F.lit(i)).alias("valor_b")) for i, c in enumerate(columns)
    ]
    each = sides[0].join(sides[1], key).select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*")
    total = keys.agg(F.count_if(F.col("status") != "only_b")).scalar()
    summary = keys.groupBy("status").agg(F.count(F.lit(1)).alias("linhas"))
    return {
        "chaves": keys,
        "resumo": summary.withColumn("parte", F.round(F.try_divide("linhas", total), 6)),
        "diferencas": each.filter(~F.col("valor_a").eqNullSafe(F.col("valor_b"))),
    }
