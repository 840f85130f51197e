"""Balanced label propagation: documents to shards, linked ones together, counts even.

Documents are linked through hubs (here: equal texts). Linked documents start in a shard by
hash; in each round every hub counts its documents per shard, and its documents elsewhere
want to move to its fullest shard. Wishes from shard i to j are granted up to what moves
from j to i at the same time plus the room that j has left, whole hubs first. Rounds end
when no wish is granted, or the wishes (a document outside its hub's fullest shard has one) no
longer get fewer; the placement with the fewest holds. Documents without links have no wishes;
they, and what exceeds a shard's share, fill the shards to counts that are at most one apart.

Hub counts are partial sums and a hub's counts are one row, so a hub with a third of all
rows costs no more than its join, which AQE splits; it spans as many shards as it must. The
driver sees an 8 x 8 table of wishes per round. Positions come from sums per bucket, never
from one sorted group.

Null text counts as empty; empty texts are equal texts. Rows are told apart by their place in
the table, so repeated ids are separate documents. An empty table gives an empty result.
Only ``doc_id`` and ``text`` are read; further columns are left out.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.order import running_start, shuffled
from rollcall.operators.row_ids import with_content_ids
from rollcall.workdir import settle

SHARDS = 8
SEED = 50


def hub_order(uid: str) -> tuple[Column, list[Column]]:
    """Bucket and order that keep a hub's rows nearly together but spread a very large hub."""
    hub, own = F.xxhash64("hub"), F.xxhash64(F.col(uid), F.lit(SEED))
    return F.pmod(hub, F.lit(256)) * 16 + F.pmod(own, F.lit(16)), [hub, own, F.col(uid)]


def per_shard(rows: DataFrame, shards: int) -> list[int]:
    found = {r.shard: r["count"] for r in rows.groupBy("shard").count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def granted(wishes: dict[tuple[int, int], int], load: list[int], share: list[int]) -> dict[tuple[int, int], int]:
    """Moves per pair of shards: swaps first, then as many more as the target has room for."""
    moves = {(i, j): min(n, wishes.get((j, i), 0)) for (i, j), n in wishes.items()}
    room = [max(0, s - n) for s, n in zip(share, load, strict=True)]
    for (i, j), n in sorted(wishes.items()):
        more = min(n - moves[i, j], room[j])
        moves[i, j] += more
        room[j] -= more
        room[i] += more
    return moves


def lookup(values: dict, key: Column, default: int = 0) -> Column:
    """The value of a small dictionary at ``key``."""
    out = F.lit(default).cast("long")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v).cast("long")).otherwise(out)
    return out


def propagate(links: DataFrame, share: list[int]) -> DataFrame:
    """``uid``, ``hub``, ``shard`` of linked documents after the last round; ``links`` has ``uid`` and ``hub``."""
    shards = len(share)
    placed = settle(links.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")), "shards")
    least, best_placed = None, placed
    while True:
        counts = placed.groupBy("hub").agg(*[F.sum((F.col("shard") == s).cast("long")).alias(f"n{s}") for s in range(shards)])
        # the fullest shard; ties turn with the hub so that no shard is preferred
        votes = F.array(*[F.struct(F.col(f"n{s}").alias("n"), (-F.pmod(F.lit(s) - F.xxhash64("hub"), F.lit(shards))).alias("tie"), F.lit(s).alias("shard")) for s in range(shards)])
        best = settle(counts.select("hub", F.array_max(votes).alias("best"), F.array(*[F.col(f"n{s}") for s in range(shards)]).alias("ns")), "votes")
        wishes = settle(
            placed.join(best, "hub").filter((F.col("shard") != F.col("best.shard")))
            .select("uid", "hub", "shard", F.col("best.shard").alias("wish")),
            "wishes",
        )
        wanted = {(r.shard, r.wish): r["count"] for r in wishes.groupBy("shard", "wish").count().collect()}
        if least is not None and sum(wanted.values()) >= least:
            return best_placed
        least, best_placed = sum(wanted.values()), placed
        moves = {k: n for k, n in granted(wanted, per_shard(placed, shards), share).items() if n}
        if not moves:
            return placed
        bucket, order = hub_order("uid")
        ranked = running_start(wishes, ["shard", "wish"], F.lit(1), "rank", bucket, order)
        pair = F.col("shard") * shards + F.col("wish")
        moved = ranked.filter(F.col("rank") < lookup({i * shards + j: n for (i, j), n in moves.items()}, pair)).select("uid", "wish")
        placed = settle(placed.join(moved, "uid", "left").select("uid", "hub", F.coalesce("wish", "shard").alias("shard")), "shards")
        if sum(moves.values()) == sum(wanted.values()):
            return placed


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law`` (rows), ``shard``, ``slot`` and ``grown_shard`` (null)."""
    rows = with_content_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "uid")
    text = F.coalesce("text", F.lit(""))
    meta = settle(
        rows.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.md5(text).alias("hub"), "uid"
        ),
        "meta",
    )
    total = meta.count()
    share = [total // shards + (s < total % shards) for s in range(shards)]
    hubs = settle(meta.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1").select("hub"), "hubs")
    placed = propagate(meta.select("uid", "hub").join(hubs, "hub"), share)
    bucket, order = hub_order("uid")
    ranked = running_start(placed, ["shard"], F.lit(1), "rank", bucket, order)
    fixed = settle(ranked.filter(F.col("rank") < lookup(dict(enumerate(share)), F.col("shard"))).select("uid", "shard"), "fixed")
    left = [s - n for s, n in zip(share, per_shard(fixed, shards), strict=True)]
    free = settle(meta.join(fixed, "uid", "left_anti").select("uid", F.lit(1).alias("one")), "free")
    ends = list(accumulate(left))
    filled = shuffled(free, ["one"], F.lit(1), "rank", "uid", SEED).select("uid", sum(((F.col("rank") >= e).cast("int") for e in ends[:-1]), F.lit(0)).alias("shard"))
    full = settle(meta.join(fixed.unionByName(filled), "uid").drop("hub"), "assigned")
    return shuffled(full, ["shard"], F.lit(1), "slot", "uid", SEED + 1).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
