"""Mixing sources to target weights by a low-discrepancy schedule.

Every source gets a target number of words: weights share all words, but no source exceeds
``CAP`` times its size; what it can't take is shared again by weight. Slots 0, 1, 2, ... are
golden-ratio points, mapped through the cumulative targets to sources, so every stretch of
the schedule has nearly the right mix. A source's slots are ranked; the k-th takes the k-th
block of its stream, which is its documents in shuffled order, over and over, cut into equal
blocks so that its slots together take exactly its target. Blocks may start and end within
a document.

Positions in a stream are sums over (source, bucket) first, so a source with a third of all
rows is spread over many tasks; slots find their source by an equal join on grid cells, and
documents their slots by an equal join on (source, block). No point passes the driver but
the water level of the targets (two sums a round). Work is linear in documents and slots.

Null text has size 0, a null source is a source of its own (the last). Rows are told apart by
ids made from their content, equal rows by a rank, so repeated rows and ids are separate
documents, and reruns agree however the table is split. An empty table
gives an empty mix. Only ``doc_id``, ``source`` and ``text`` are read; further columns are
left out. Without any words all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.order import running_start, shuffled
from rollcall.llm.quality_rules import words
from rollcall.operators.row_ids import with_content_ids
from rollcall.workdir import settle

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK = 256
SEED = 20
CELLS = 4096
SLOT_BUCKETS = 1024
GOLDEN = 0.6180339887498949
# golden ratio times 2^20, fraction only: a slot number is split so that no product loses its fraction
GOLDEN_HIGH = 0.6077874097403510


def fraction(n: Column) -> Column:
    """Fraction of n times the golden ratio, to about nine digits for n below 2^40."""
    high, low = F.shiftright(n, 20).cast("double"), n.bitwiseAND((1 << 20) - 1).cast("double")
    total = high * GOLDEN_HIGH - F.floor(high * GOLDEN_HIGH) + low * GOLDEN - F.floor(low * GOLDEN)
    return total - F.floor(total)


def sizes(docs: DataFrame) -> DataFrame:
    """One row per document with its number of words; a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    size = F.size(words(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("size")
    return settle(with_content_ids(rows, "uid").select("doc_id", "source", size, "uid"), "sizes")


def targets(meta: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source_no`` (by code point, null last), ``source``, ``source_size``, ``target``; a written table.

    A source's target is the smaller of its cap and weight times a water level; the level
    rises until the targets add up to all words.
    """
    ranged = settle(
        meta.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    numbered = ranged.join(parts, "part").withColumn("source_no", (F.col("before") + F.row_number().over(within) - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    weighed = settle(numbered.select("source_no", "source", "source_size", weight.cast("double").alias("weight")), "sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        capped = F.col("weight") * level > cap * F.col("source_size")
        row = weighed.agg(
            F.coalesce(F.sum(F.when(capped, cap * F.col("source_size"))), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("left"),
        ).first()
        risen = (total - row.taken) / row.left if row.left else level
        if risen <= level:
            break
        level = risen
    target = F.least(cap * F.col("source_size").cast("double"), F.col("weight") * F.lit(level))
    return settle(weighed.select("source_no", "source", "source_size", target.alias("target")), "targets")


def schedule(aims: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per slot: ``slot``, ``source_no``, its rank ``k`` in the source, and the source's words and slots."""
    spark = aims.sparkSession
    shares = settle(aims.select("source_no", F.floor("target").cast("long").alias("share")).filter("share > 0"), "shares")
    placed = settle(shuffled(shares.withColumn("one", F.lit(1)), ["one"], F.col("share"), "low", "source_no", SEED).drop("one"), "places")
    total, n_sources = placed.agg(F.coalesce(F.sum("share"), F.lit(0)), F.count("*")).first()
    slots, cells = -(-total // block), max(CELLS, 4 * n_sources)
    width = F.lit(max(total, 1) / cells)
    cell = lambda at: F.least(F.floor(at / width).cast("long"), F.lit(cells - 1))
    grid = placed.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("low") + F.col("share") - 1))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.least(F.floor(fraction(F.col("id")) * float(total)).cast("long"), F.lit(max(total - 1, 0))).alias("at")).withColumn("cell", cell(F.col("at")))
    hit = points.join(grid, "cell").filter((F.col("at") >= F.col("low")) & (F.col("at") < F.col("low") + F.col("share"))).select("slot", "source_no", "share")
    found = settle(hit, "slots")
    # a source too small to be hit takes one slot of its own at the end
    missed = shares.join(found.select("source_no").distinct(), "source_no", "left_anti").select((F.lit(slots) + F.col("source_no")).alias("slot"), "source_no", "share")
    every = settle(found.unionByName(missed), "slots")
    ranked = running_start(every, ["source_no"], F.lit(1), "k", F.floor(F.col("slot") / F.lit(max(1, -(-slots // SLOT_BUCKETS)))), [F.col("slot")])
    return ranked.join(every.groupBy("source_no").agg(F.count("*").alias("n_slots")), "source_no")


def edge(k: Column) -> Column:
    """First word of block ``k`` in a source's stream."""
    return F.when(k >= F.col("n_slots"), F.col("share")).otherwise(F.floor(k * F.col("width"))).cast("long")


def mix(meta: DataFrame, aims: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: ``slot``, ``source_no``, ``uid``, ``epoch``, and the words [``first``, ``end``) of the document it takes."""
    slots = settle(schedule(aims, block), "schedule")
    per_source = slots.groupBy("source_no").agg(F.first("share").alias("share"), F.first("n_slots").alias("n_slots"))
    sources = settle(aims.join(per_source, "source_no").withColumn("width", F.col("share") / F.col("n_slots")).withColumn("source", F.to_json(F.struct("source"))), "streams")
    rows = settle(meta.filter("size > 0").withColumn("source", F.to_json(F.struct("source"))).join(sources.select("source", "source_no"), "source").select("uid", "source_no", "size"), "rows")
    placed = shuffled(rows, ["source_no"], F.col("size"), "start", "uid", SEED + 1).join(sources.drop("source", "target"), "source_no")
    epochs = F.explode(F.sequence(F.lit(0), F.floor((F.col("share") - 1 - F.col("start")) / F.col("source_size")).cast("int")))
    copies = placed.filter(F.col("start") < F.col("share")).withColumn("epoch", epochs).withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size"))
    copies = copies.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("share")))
    last = F.least(F.ceil(F.col("b") / F.col("width")).cast("long"), F.col("n_slots") - 1)
    pieces = copies.withColumn("k", F.explode(F.sequence(F.least(F.floor(F.col("a") / F.col("width")).cast("long"), F.col("n_slots") - 1), last)))
    joined = pieces.join(slots.select("slot", "source_no", "k"), ["source_no", "k"])
    first, end = F.greatest(F.col("a"), edge(F.col("k"))), F.least(F.col("b"), edge(F.col("k") + 1))
    return joined.select("slot", "source_no", "uid", "epoch", (first - F.col("a")).alias("first"), (end - F.col("a")).alias("end")).filter(F.col("end") > F.col("first"))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and the words the mix takes of each document."""
    meta = sizes(docs)
    aims = targets(meta)
    taken = mix(meta, aims).groupBy("uid").agg(F.sum(F.col("end") - F.col("first")).alias("taken"))
    named = aims.select(F.to_json(F.struct("source")).alias("source"), "source_size", "target")
    return (
        meta.withColumn("source", F.to_json(F.struct("source"))).join(named, "source").join(taken, "uid", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as often as the mix takes them, rounded to whole documents, in all their columns.

    A document that is taken by half or more of its words in an epoch counts for that epoch.
    """
    kept = settle(with_content_ids(docs, "_uid"), "mixed")
    meta = settle(kept.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words(F.coalesce(F.col("text").cast("string"), F.lit("")))).cast("long").alias("size"), F.col("_uid").alias("uid")), "sizes")
    taken = mix(meta, targets(meta)).groupBy("uid", "epoch").agg(F.sum(F.col("end") - F.col("first")).alias("taken"))
    times = taken.join(meta.select("uid", "size"), "uid").filter(2 * F.col("taken") >= F.col("size")).groupBy("uid").agg(F.count("*").cast("int").alias("_times"))
    repeated = kept.join(times.withColumnRenamed("uid", "_uid"), "_uid").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.select(docs.columns)
