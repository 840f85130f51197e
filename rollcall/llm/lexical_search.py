"""Ranked lexical search by the Best Position Algorithm.

Documents are the rows of a distributed index: every task turns its documents into shards of
bounded size, each with one impact list per term (places by falling impact) and, for direct
access, the postings of each document. For an item its terms' lists are read downwards side
by side. Each document met is scored at once by direct access, which also marks its places in
all other lists as seen. A list's best position is the end of its unbroken run of seen
places; a document not yet met can't stand before any list's first unseen place, so the sum
of the impacts there bounds its score. Reading stops when that bound is strictly below the
k-th score, strictly so that equal scores are all met and the smaller ids win. The k-th score
is kept from shard to shard of a task, and only k rows per item leave a task.

Items are a stated query set. They are searched in blocks of at most ``BLOCK_BYTES`` of text
(or one longer item); a block's terms and weights are all that is sent to the tasks. Counts
of documents and terms come from all documents, in one pass per block.

Defined results: null text has no terms, an empty text neither; a document or item without
terms is in no ranking. Texts of any length are searched whole. Rows with equal ids are
documents of their own, a null document id comes after all others among equal scores. Every
row of the items is an item of its own, also with a repeated or null id. Empty tables give an
empty ranking. Only ``doc_id``, ``text`` and the items' ``item_id``, ``text`` are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.workdir import settle

BLOCK_BYTES = 4 << 20
SHARD_POSTINGS = 2_000_000
SHARD_DOCUMENTS = 1 << 17
FIRST_READ = 64
POSTINGS = "doc_id long, n long, terms array<int>, times array<int>"
HITS = "item int, doc_id long, score long"
# Bytes of a term: digits, letters (A-Z lower-cased) and everything outside ASCII; the rest separates.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their terms, in blocks of bounded text, in an order that reruns keep."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    block, size = [], 0
    for item_id, text in rows.toLocalIterator():
        length = len(text or "")
        if block and size + length > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, terms_of(text)))
        size += length
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document its number of terms, and the numbers and counts of those in the vocabulary; a written table."""

    def run(batches):
        number = vocabulary.get
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                counts = Counter(map(number, words))
                counts.pop(None, 0)
                sizes.append(len(words))
                terms.append(list(counts))
                times.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "times"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(rows.mapInArrow(run, POSTINGS), "postings")


class Shard:
    """Impact lists of some documents, and the postings of each document for direct access."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, term: np.ndarray, times: np.ndarray, lengths: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        longer = 25 + (75 * lengths * n_docs) // n_terms
        self.ids, self.term = ids, term
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.repeat(np.arange(len(ids)), sizes)
        self.impact = weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * longer[self.doc]))
        by_impact = np.lexsort((-self.impact, term))
        self.starts = np.searchsorted(term[by_impact], np.arange(len(weight) + 1))
        self.list_doc, self.list_impact = self.doc[by_impact], self.impact[by_impact]
        self.place = np.empty(len(term), np.int64)
        self.place[by_impact] = np.arange(len(term))
        self.seen = np.zeros(len(term), bool)
        self.times_asked = np.zeros(len(weight), np.int64)

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of ``best`` and this shard for the given different terms."""
        there = self.starts[terms] < self.starts[terms + 1]
        terms, times = terms[there], times[there]
        low, end = self.starts[terms], self.starts[terms + 1]
        for a, b in zip(low, end, strict=True):
            self.seen[a:b] = False
        met = np.zeros(len(self.ids), bool)
        self.times_asked[terms] = times
        unseen, depth = low.copy(), FIRST_READ
        while True:
            open_lists = unseen < end
            bound = int(np.sum(times[open_lists] * self.list_impact[unseen[open_lists]]))
            if bound <= 0 or (len(best[0]) == k and bound < best[0][-1]):
                break
            read = np.unique(np.concatenate([self.list_doc[a : min(a + depth, b)] for a, b in zip(unseen[open_lists], end[open_lists], strict=True)]))
            fresh = read[~met[read]]
            met[fresh] = True
            scores = self._score(fresh)
            best = best_of(np.concatenate([best[0], scores]), np.concatenate([best[1], self.ids[fresh]]), k)
            for i in np.flatnonzero(open_lists):
                run = self.seen[unseen[i] : end[i]]
                gap = int(run.argmin())
                unseen[i] = end[i] if run[gap] else unseen[i] + gap
            depth *= 2
        self.times_asked[terms] = 0
        return best

    def _score(self, docs: np.ndarray) -> np.ndarray:
        """Scores by direct access to all postings of the documents; marks the asked ones' places as seen."""
        sizes = self.first[docs + 1] - self.first[docs]
        offsets = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.first[docs] - offsets, sizes)
        asked = self.times_asked[self.term[at]]
        self.seen[self.place[at[asked > 0]]] = True
        return np.add.reduceat(asked * self.impact[at], offsets) if len(docs) else np.zeros(0, np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest positive scores with their ids, equal scores by id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[scores >= kth], ids[scores >= kth]
    order = np.lexsort((ids, -scores))[:k]
    order = order[scores[order] > 0]
    return scores[order], ids[order]


NO_ID = np.iinfo(np.int64).max


def search_postings(table: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item``, ``doc_id``, ``score``: each task's k best documents of every query."""

    def run(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        held, held_postings = [], 0

        def search_held():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            shard = Shard(*columns[:2], *columns[3:], columns[2], weight, n_docs, n_terms)
            for i, (terms, times) in enumerate(queries):
                if len(terms):
                    found[i] = shard.search(terms, times, k, found[i])
            held.clear()

        for batch in batches:
            some = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column(2)), 0))
            for at in range(0, len(some), 4096):
                part = some.slice(at, 4096)
                terms = part.column(2)
                held.append((
                    part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False),
                    pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64),
                    part.column(1).to_numpy(zero_copy_only=False),
                    terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                    part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                ))
                held_postings += len(held[-1][3])
                if held_postings >= SHARD_POSTINGS or 4096 * len(held) >= SHARD_DOCUMENTS:
                    search_held()
                    held_postings = 0
        if held:
            search_held()
        for i, (scores, ids) in enumerate(found):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["item", "doc_id", "score"]
                )

    return table.mapInArrow(run, HITS)


def _search_block(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    vocabulary = {term: i for i, term in enumerate(sorted({t for _, terms in block for t in terms}))}
    table = postings(docs, vocabulary)
    n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row per term of the block at most
    holding = dict(table.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator())
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    queries = []
    for _, terms in block:
        counts = Counter(vocabulary[t] for t in terms)
        queries.append((np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)))
    hits = search_postings(table, queries, weight, n_docs, max(1, n_terms), k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    named = docs.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
    best = hits.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(named, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of every item."""
    found = [_search_block(docs, block, k) for block in blocks(items, block_bytes)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
