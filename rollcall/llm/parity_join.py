"""Near-duplicate join of shingle sets by parity sketches.

Every shingle's hash flips one bit of its document's sketch, so two sketches differ in no
more bits than the sets differ in shingles. Documents of a band of set sizes have sketches of
equally many blocks of 64 bits. Sets of sizes a and b at least p % alike differ in at most
d = (100 - p)(a + b) / (100 + p) shingles, so of d + m blocks at least m are untouched and
equal. A key is a block's number, parity bits and the XOR of its shingles' hashes; documents
that share a key are candidates. Blocks without shingles say nothing and would be hot: they
are left out unless a document has m or more of them, in which case all its blocks are keys. A document that leaves out l blocks shares at least q = m - l keys with any linked
one (the others at least one). The rarest of them is not among either document's q - 1 most
frequent keys, so each document drops these: passages that many documents share make no
candidates, and no link is lost. A document is in its own band and, where it can have
partners there, in the next.

Links are found without writing out the pairs of a group. Equal sets are one class, kept by
its smallest id. Keys are reduced by partial aggregates to those with two classes or more,
with the smallest as pivot. First each class is verified against its smallest pivot only,
and the verified ones become components. Keys whose members are in one component are done,
since only reachability is asked for. Of the others, 2, 16, 128, ... members per key are pivots and
compared with the members in other components, each pivot in one round only, until no key is
open or all its members were compared. Pivots are the members first in one order of all
documents, so the many keys of a group of near copies have the same few, and the group is one
component before more are asked: its pairs grow with its size, not with the square. The comparing join itself sets sizes and ``SKETCH``-bit parity sketches of
whole sets against the bound d, so members of a key that only share a passage make no row;
what is left is verified on whole sets. So no link between different components is missed.
A key that stays open costs a comparison of sketches for each two of its members.

Texts are read again for the pairs of a round that are left, and for these only. The only
collected data are bit maps that spare shuffling keys without any partner; they have 16 bits
per key, at most ``MOST_BITS``, and are exact in what they let through, as joins follow.

Null and text without words have an empty set, linked with nothing. Rows with the same id
count as one document. Rows with a null id are linked with nothing; their component is null.
An empty table gives an empty result. Texts of any length are used whole. Only ``doc_id``
and ``text`` are read, so further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.shingles import mix, shingle_sets
from rollcall.operators.keys import MOST_SENT_KEYS, cut_to, wanted_keys
from rollcall.operators.row_ids import with_content_ids
from rollcall.workdir import discard, settle

SPREAD = 1.5
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
FIRST_PIVOTS, MORE_PIVOTS = 2, 8
OUT_ROWS = 100_000
# Bits of a whole set's sketch, in words of 64. More bits only spare comparisons of sets with more than about 3,000 shingles.
SKETCH = 1024
# Blocks beyond those that are needed, as a share of d; the more, the more frequent keys can be dropped.
EXTRA = 0.2


@lru_cache(maxsize=None)
def band(number: int, percent: int) -> tuple[int, int, int, int]:
    """Sizes from ``low`` to below ``high``, largest difference ``d``, and number of blocks."""
    low = 1
    for _ in range(number):
        low = max(low + 1, math.ceil(low * SPREAD))
    high = max(low + 1, math.ceil(low * SPREAD))
    d = (100 - percent) * 2 * (high - 1) // (100 + percent)
    spare = 1
    for _ in range(4 if d else 0):
        per_block = low / (d + spare)
        empty = (d + spare) * math.exp(-per_block)
        spare = math.ceil(EXTRA * d) + min(max(2, d), 1 + math.ceil(empty + 3 * math.sqrt(empty)))
    return low, high, d, d + spare


def bands(size: int, percent: int) -> list[int]:
    """The band of a size, and the next if a set of it can be ``percent`` % like one there."""
    number = 0
    while band(number, percent)[1] <= size:
        number += 1
    return [number, number + 1] if 100 * size >= percent * band(number, percent)[1] else [number]


def block_keys(shingles: np.ndarray, number: int, percent: int) -> tuple[np.ndarray, int]:
    """Keys of one document in one band, and how many of them it shares with a linked one at least."""
    _, _, d, blocks = band(number, percent)
    place = mix(shingles + np.uint64(0x51ED2701)) % np.uint64(64 * blocks)
    block = (place >> np.uint64(6)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, hashes, bits = block[order], shingles[order], np.uint64(1) << (place[order] & np.uint64(63))
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    numbers = block[starts]
    value = np.bitwise_xor.reduceat(hashes, starts)
    parity = np.bitwise_xor.reduceat(bits, starts)
    sure = len(numbers) - d
    if sure <= 0:
        every = np.zeros((2, blocks), np.uint64)
        every[0, numbers], every[1, numbers] = value, parity
        numbers, value, parity = np.arange(blocks), every[0], every[1]
    of_band = np.uint64(number * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    return mix(mix(value + mix(parity)) + numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + of_band), max(1, sure)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets are at least ``percent`` % alike; sizes first, then sketches, then the sets."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    most = (100 - percent) * (small + large) // (100 + percent)
    width = 64 * (most + 16)
    parity = np.bincount((a % np.uint64(width)).astype(np.int64), minlength=width) + np.bincount((b % np.uint64(width)).astype(np.int64), minlength=width)
    if int((parity & 1).sum()) > most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _positions(values: np.ndarray, bits: int) -> np.ndarray:
    return mix(values.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)


def bit_map(values: DataFrame, column: str) -> np.ndarray:
    """A bit per hash of the column's values, 16 times as many as values: says no only where there is none."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * values.count()).bit_length()))

    def run(batches):
        for batch in batches:
            at = _positions(batch.column(0).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"]
            )

    words = values.select(F.col(column).cast("long").alias("v")).mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    if words.num_rows:
        out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _maybe(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _positions(values, 64 * len(known))
    return (known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def whole_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bits of a whole set as ``SKETCH`` / 64 numbers."""
    counts = np.bincount((mix(shingles + np.uint64(0x3C6EF372)) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches (columns named with the prefixes) allow a link: no linked pair fails."""
    small, large = F.least(f"{x}_n", f"{y}_n"), F.greatest(f"{x}_n", f"{y}_n")
    differing = sum((F.bit_count(F.get(f"{x}_sketch", i).bitwiseXOR(F.get(f"{y}_sketch", i))) for i in range(SKETCH // 64)), F.lit(0))
    return (100 * small >= percent * large) & ((100 + percent) * differing <= (100 - percent) * (small + large))


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, few at a time as Python strings."""
    for at in range(0, len(column), 64):
        yield from column.slice(at, 64).to_pylist()


def set_sizes(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, two sums of hashes that tell sets apart (128 bits), and the set's ``sketch``."""

    def run(batches):
        for batch in batches:
            sizes, one, two, sketches = [], [], [], [np.zeros(0, np.int64)]
            for s in shingle_sets(texts_of(batch.column(1)), words):
                sizes.append(len(s))
                sketches.append(whole_sketch(s))
                one.append(int(mix(s).sum(dtype=np.uint64)))
                two.append(int(mix(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(np.concatenate(sketches))),
                ],
                names=["doc_id", "n_shingles", "one", "two", "sketch"],
            )

    return rows.mapInArrow(run, "doc_id long, n_shingles long, one long, two long, sketch array<long>")


def keys(rows: DataFrame, words: int, percent: int, known=None) -> DataFrame:
    """``key``, ``doc_id``, ``band`` and ``sure`` (see ``block_keys``) of every document's blocks.

    With the broadcast bit map ``known``, only keys that may be in it.
    """
    names = ["key", "doc_id", "band", "sure"]

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(column)) for column in zip(*held, strict=True)], names=names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(texts_of(batch.column(1)), words), strict=True):
                if doc_id is None or not len(s):
                    continue
                for number in bands(len(s), percent):
                    found, sure = block_keys(s, number, percent)
                    found = found.view(np.int64)
                    if known is not None:
                        found = found[_maybe(known.value, found)]
                    held.append((found, np.full(len(found), doc_id, np.int64), np.full(len(found), number, np.int32), np.full(len(found), sure, np.int32)))
                    n += len(found)
                if n >= OUT_ROWS:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    return rows.mapInArrow(run, "key long, doc_id long, band int, sure int")


def verified(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``, a written table) whose sets are alike, by their texts in ``rows``; a written table."""

    def run(batches):
        last, first = None, None
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                if (text := batch.column(2)[i].as_py()) != last:
                    last, (first,) = text, list(shingle_sets([text], words))
                (second,) = shingle_sets([batch.column(3)[i].as_py()], words)
                keep.append(alike(first, second, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    texts = settle(cut_to(rows, wanted_keys(ids, "doc_id"), "doc_id"), "texts")
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    links = settle(pairs.join(two, "b").join(one, "a").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long").distinct(), "links")
    discard(texts)
    return links


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for the nodes of links (``a``, ``b``); a written table.

    Each node points to its smallest neighbour if that is smaller; pointers are followed to
    their roots, links are moved to the roots, and so on until no link joins two roots.
    """
    labels = None
    while True:
        both = settle(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "both")
        if both.isEmpty():
            break
        parent = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = settle(parent.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "parents")
            moved = not jumped.filter("moved").isEmpty()
            parent = jumped.drop("moved")
            if not moved:
                break
        root = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        if labels is None:
            labels = root
        else:
            higher = root.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = settle(labels.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        a = root.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links between nodes."""
    named = links
    for c in ("a", "b"):
        other = labels.select(F.col("node").alias(c), F.col("root").alias("r"))
        named = named.join(other, c, "left").withColumn(c, F.coalesce("r", c)).drop("r")
    more = components(named.select("a", "b"))
    old = labels.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return settle(old.union(more.join(labels, "node", "left_anti").select("node", "root")), "labels")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = settle(set_sizes(rows, words), "sets")
    # one class per set, named by its smallest id
    sets = sizes.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "one", "two")
    heads = settle(sets.groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("head")), "heads")
    counted = keys(rows, words, percent).groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    shared = settle(counted.filter("low < high").select("key", "n"), "keys")
    known = spark.sparkContext.broadcast(bit_map(shared, "key"))
    frequent_first = Window.partitionBy("doc_id", "band").orderBy(F.desc("n"), "key")
    ranked = keys(rows, words, percent, known).join(shared, "key").join(heads.select(F.col("head").alias("doc_id")), "doc_id", "left_semi").distinct()
    members = settle(ranked.withColumn("place", F.row_number().over(frequent_first)).filter("place >= sure").select("key", "doc_id"), "members")
    pivots_of = settle(members.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("high")).filter("pivot < high").select("key", "pivot"), "pivots")
    reduced, members = members, settle(members.join(pivots_of, "key"), "members")
    for table in (reduced, shared, pivots_of):
        discard(table)
    sketches = sizes.filter("n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n"), "sketch")
    nearest = members.filter("pivot < doc_id").groupBy("doc_id").agg(F.min("pivot").alias("a")).select("a", F.col("doc_id").alias("b"))
    for c in ("a", "b"):
        nearest = nearest.join(sketches.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch")), c)
    tested = settle(nearest.filter(may_link("a", "b", percent)).select("a", "b").distinct(), "pairs")
    labels = components(verified(tested, rows, words, percent))
    before, pivots = 0, FIRST_PIVOTS
    while True:
        placed = members.select("key", "doc_id").join(labels.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        placed = settle(placed, "placed")
        open_keys = settle(placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high").filter(F.col("n") > before).select("key", "n"), "open")
        most = open_keys.agg(F.max("n")).first()[0]
        if most is None:
            break
        members_open = settle(placed.join(open_keys, "key").join(sketches.withColumnRenamed("n", "n_shingles"), "doc_id"), "candidates")

        def among(number: int) -> Column:
            """Whether a member is one of about ``number`` pivots of its key, all of them where it has no more members."""
            share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * number / F.col("n")
            return (F.col("n") <= number) | share

        def side(rows: DataFrame, x: str) -> DataFrame:
            return rows.select("key", F.col("doc_id").alias(x), *[F.col(c).alias(f"{x}_{name}") for c, name in (("root", "root"), ("n_shingles", "n"), ("sketch", "sketch"))])

        left = side(members_open.filter(among(pivots) & ~among(before)), "x").withColumnRenamed("key", "x_key")
        apart = (F.col("x_key") == F.col("key")) & (F.col("x_root") != F.col("y_root"))
        met = left.join(side(members_open, "y"), apart & may_link("x", "y", percent))
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = settle(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = verified(pairs, rows, words, percent)
        for table in (placed, open_keys, members_open):
            discard(table)
        if not links.isEmpty():
            labels = merged(labels, links)
        tested = tested.union(pairs.select("a", "b"))
        if pivots >= most:
            break
        before, pivots = pivots, MORE_PIVOTS * pivots
    by_head = heads.join(labels.select(F.col("node").alias("head"), "root"), "head", "left").select("n_shingles", "one", "two", F.coalesce("root", "head").alias("component"))
    of_set = sets.join(by_head, ["n_shingles", "one", "two"]).groupBy("doc_id").agg(F.min("component").alias("component"))
    return sizes.select("doc_id", "n_shingles").join(of_set, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all columns, of each group of near duplicates only the row with the smallest id.

    Every row is a document of its own and is decided on by its own text, also where ids repeat
    or are null; a null id comes after all others, among equal ids the smaller hash of the row
    stays. Of equal rows one stays. Rows without words are in no group and all stay.
    """
    marked = with_content_ids(docs, "_uid")
    rows = marked.select(F.col("_uid").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = near_duplicates(rows, words, percent).select(F.col("doc_id").alias("_uid"), "component_id")
    # tables of their own, so that a group with a large part of all rows can be split by the joins
    found = settle(found, "found")
    large = settle(found.filter("_uid <> component_id").select("component_id").distinct(), "large")
    several = settle(found.join(large, "component_id"), "groups")
    ids = cut_to(marked.select("_uid", F.col("doc_id").cast("long").alias("_id")), wanted_keys(several, "_uid"), "_uid")
    best = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_uid"))).alias("_best")
    members = settle(several.join(ids, "_uid"), "groups")
    staying = settle(members.groupBy("component_id").agg(best), "staying")
    gone = settle(members.join(staying, "component_id").filter(F.col("_uid") != F.col("_best._uid")).select("_uid"), "gone")
    return marked.join(F.broadcast(gone) if gone.count() <= MOST_SENT_KEYS else gone, "_uid", "left_anti").select(docs.columns)
