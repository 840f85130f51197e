"""Token counts by heap-and-linked-list byte-pair merging, without making ids.

``count_tokens`` adds to every row the number of tokens its whole text has under a
SentencePiece BPE model: the symbols a chunk starts with, less the merges done, where a
symbol that is no piece counts once per UTF-8 byte. Each text is read once, in its task;
nothing is shuffled. A worker remembers the counts of short chunks in a bounded memo.

Null text counts as empty, and an empty text has 0 tokens. Texts of any length are counted
whole. Repeated rows give repeated rows, an empty table gives an empty one. Only ``doc_id``
and ``text`` are read, so further columns, whatever their names, are left out.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.pieces import MARK, Memo, chunks, merges, vocabulary

MEMO_ENTRIES = 600_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


@lru_cache(maxsize=2)
def chunk_counter(model_file: str, entries: int = MEMO_ENTRIES) -> Memo:
    """Tokens of one chunk, by chunk without its first mark; a worker keeps it from task to task."""
    rank = vocabulary(model_file).rank

    def count(rest: str) -> int:
        chunk = MARK + rest
        starts = merges(chunk, rank)
        total = len(starts)
        for start, end in zip(starts, starts[1:] + [len(chunk)], strict=True):
            if end - start == 1 and chunk[start] not in rank:
                total += len(chunk[start].encode()) - 1
        return total

    return Memo(count, entries)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, and whether the tokens exceed ``limit``."""

    def run(batches):
        counted = chunk_counter(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [sum(map(counted.__getitem__, chunks(t))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
