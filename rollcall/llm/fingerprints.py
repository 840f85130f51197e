"""Document fingerprints by consistent weighted sampling, in built-in expressions.

A document's terms are its words, weighted by how often they occur. For each of ``SAMPLES``
samples a term gets, from hashes of the term, two gamma(2, 1) draws r and c and a uniform
draw b; with weight w, t = floor(ln w / r + b) and a = c exp(-r (t + 1 - b)). The term of
the smallest a, with its t, is the sample. Two documents agree in a sample with the
probability of their generalised Jaccard similarity, the sum of the smaller over the sum of
the larger weights. A term and its t give a value of a that no other gives, so a sample is a
plain minimum, aggregated where the document is, ``BLOCK`` samples at a time so that the
generated code stays small. The share of samples that agree has a standard error of at most
0.045 with 128 samples (0.035 at 0.8).

The draws are taken as sums of exponential ones, which have just these distributions: with
c = a1 + a2, u = a1 / c is uniform and independent of c, so with e1 a third exponential draw
r = e1 - ln u is gamma(2, 1) and b = e1 / r uniform, all three independent. Then t = 0 gives
a = a1, so that a word seen once, and any with w u < 1, needs a hash and no logarithm: the
bits of a's distribution function 1 - exp(-a) are the hash itself. Because a is at least
a1 exp(-e1) / w, a word for which this exceeds ``SURELY`` / n, n the document's words, keeps
t = 0: the smallest a is exponential with rate n, so that this touches a sample with a
probability of exp(-32).

Successors by descending id are found without sorting all rows in one task: bucket bounds
come from approximate quantiles of the ids (at most ``BUCKETS`` numbers), each bucket is
ordered by itself, and the first row of a bucket is copied behind the last of the one before.
The texts are shuffled once, by bucket; terms and samples stay in that partition.

Null text counts as empty; a text without words has a fingerprint of its own, alike only to
the same. Rows with equal ids are ordered by text, null ids come last. The only row of a
table is its own successor. Texts of any length are used whole. An empty table gives an empty
result. Only ``doc_id`` and ``text`` are read, so further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.quality_rules import let, words
from rollcall.workdir import settle

SAMPLES = 128
BLOCK = 32
BUCKETS = 1024
FINE = 32
SURELY = 32.0


def buckets(ids: DataFrame, most: int) -> list[int]:
    """At most ``most`` increasing bounds that cut the ids into parts of about equal size."""
    shares = [i / most for i in range(1, most)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 10 * most).alias("q")).first().q
    return sorted(set(found or []))


def bucket_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``doc_id``, searched coarse then fine; -1 for null."""
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    every = F.array(*[F.lit(b).cast("long") for b in bounds])
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[::FINE]])

    def at_most(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= doc_id))

    start = F.greatest(at_most(coarse) - 1, F.lit(0)) * FINE
    return F.when(doc_id.isNull(), -1).otherwise(let(start, lambda s: s + at_most(F.slice(every, s + 1, FINE))))


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows with ``bucket``, place ``rn`` in it, and the ``following`` row's text.

    ``ghost`` rows are copies of a bucket's first row behind the bucket before it (of the
    very first row behind the last); they are there to be followed and no results.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    most = max(2, min(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bucketed = rows.withColumn("own", bucket_of(F.col("doc_id"), buckets(rows.select("doc_id"), most)))
    order = Window.orderBy("own")
    # one row per bucket, BUCKETS + 1 at most
    firsts = bucketed.groupBy("own").agg(F.max("doc_id").alias("top"))
    firsts = settle(firsts.select("own", "top", F.coalesce(F.lead("own").over(order), F.min("own").over(Window.partitionBy(F.lit(0)))).alias("before")), "firsts")
    placed = bucketed.join(F.broadcast(firsts), "own")
    at = F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ghost")))
    ghost = F.array(F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost")))
    placed = placed.withColumn("at", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.concat(at, ghost)).otherwise(at)))
    window = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return placed.select("at.bucket", "at.ghost", "doc_id", "text").select(
        "*", F.row_number().over(window).alias("rn"), F.coalesce(F.lead("text").over(window), F.lit("")).alias("following")
    )


def edited_text(text: Column, following: Column) -> Column:
    """``text`` whose last half is replaced by the first as many characters of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def terms(text: Column) -> Column:
    """Hashes of the different words with their counts and the number of all words."""
    def counted(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: ~F.get(h, i).eqNullSafe(F.get(h, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda a, j: F.struct(F.get(h, a).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(h)) - a).alias("count"), F.size(h).alias("all"))))

    w = words(text)
    hashes = F.sort_array(F.transform(w, lambda x: F.xxhash64(x)))
    return let(hashes, lambda h: F.when(F.size(h) > 0, counted(h)).otherwise(F.array().cast("array<struct<term:bigint,count:int,all:int>>")))


def uniform(bits: Column, n: int) -> Column:
    """A number in (0, 1) from ``n`` bits."""
    return (bits.cast("double") + 0.5) / float(1 << n)


def draw(i: int) -> Column:
    """Sample ``i`` of a term's block, from the column ``seed`` of both: 63 bits of 1 - exp(-a)."""
    count = F.col("count")
    one = F.xxhash64(F.col("seed").bitwiseXOR(i))
    two = F.xxhash64(one)
    at_once = F.shiftrightunsigned(one, 1)
    below = uniform(F.shiftrightunsigned(one, 12), 52)
    exp_e1 = uniform(F.shiftrightunsigned(two, 32), 32)
    a1, a2 = -F.ln(1.0 - below), -F.ln(uniform(two.bitwiseAND(0xFFFFFFFF), 32))
    one_by_u = 1.0 + a2 / a1
    exp_r = exp_e1 / one_by_u
    t = F.floor(F.ln(count / exp_e1) / -F.ln(exp_r))
    a = (a1 + a2) * F.pow(exp_r, t + 1) / exp_e1
    later = (-F.expm1(-a) * float(1 << 63)).cast("long")
    too_large = below * exp_e1 * F.col("all") >= SURELY * count
    return F.when((count == 1) | too_large | (one_by_u > count), at_once).otherwise(later)


def fingerprint(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``signature``, an array of ``samples`` numbers, from rows with ``keys`` and ``text``.

    -1 stands for every sample of a text without words.
    """
    each = rows.select(*keys, F.explode_outer(terms(F.col("text"))).alias("t")).select(*keys, *[F.col(f"t.{c}").alias(c) for c in ("term", "count", "all")])
    blocks = each.select("*", F.explode(F.array(*[F.lit(b) for b in range(-(-samples // BLOCK))])).alias("block"))
    blocks = blocks.select(*keys, "block", "count", "all", F.xxhash64("term", "block").alias("seed"))
    least = blocks.groupBy(*keys, "block").agg(*[F.min(draw(i)).alias(f"s{i}") for i in range(BLOCK)])
    part = F.array(*[F.when(F.col(f"s{i}").isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(f"s{i}").bitwiseAND(0xFFFFFFFF)) for i in range(BLOCK)])
    parts = least.select(*keys, F.struct("block", part.alias("part")).alias("p")).groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("parts"))
    return parts.select(*keys, F.slice(F.flatten(F.transform("parts", lambda p: p["part"])), 1, samples).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two signatures agree."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.size(a).cast("double")


def shown(signature: Column) -> Column:
    """Eight hexadecimal digits a sample; empty for a text without words."""
    return F.when(F.get(signature, 0) == -1, F.lit("")).otherwise(F.concat_ws("", F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))))


def report(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses."""
    keys = ["bucket", "rn", "ghost", "doc_id", "n_chars", "edited_sha256", "side"]
    placed = with_successors(docs).withColumn("edited", edited_text(F.col("text"), F.col("following")))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"))))
    rows = placed.select("bucket", "rn", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), sides.alias("s"))
    prints = settle(fingerprint(rows.select("*", "s.side", "s.text"), keys, samples), "prints")
    same = ["bucket", "rn", "ghost", "doc_id", "n_chars", "edited_sha256"]
    both = prints.groupBy(*same).agg(*[F.max(F.when(F.col("side") == side, F.col("signature"))).alias(name) for side, name in ((0, "own"), (1, "edit"))])
    both = both.withColumn("next", F.lead("own").over(Window.partitionBy("bucket").orderBy("rn")))
    return both.filter(~F.col("ghost")).select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
