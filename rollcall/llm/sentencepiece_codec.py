"""SentencePiece BPE encoding by a table of last tokens, and decoding.

Every prefix of a text has one last token in the prefix's own encoding. An automaton over
the pieces gives, for each end position, the pieces that end there; the right one is the one
that is compatible with the last token of the prefix before it, that is, merging the two
pieces' characters gives back just these two. The ids are then read backwards from the end.

A chunk (a run of word marks and what follows up to the next) is encoded at a time, as no
piece crosses its start. Results of short chunks and of pairs are kept in bounded memos.

Null text counts as empty; an empty text has no id but the end id. Characters that are no
piece become byte pieces. Texts of any length are encoded whole. Repeated rows give repeated
rows, an empty table gives an empty one. Only ``doc_id`` and ``text`` are read, so further
columns are left out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.pieces import MARK, Memo, Vocabulary, chunks, merges, vocabulary

MEMO_ENTRIES = 400_000
PAIR_ENTRIES = 500_000
ROWS_AT_A_TIME = 200
SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Encoder:
    def __init__(self, words: Vocabulary):
        import ahocorasick

        self.words = words
        self.automaton = ahocorasick.Automaton()
        for piece in words.id:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.alphabet = frozenset(piece for piece in words.id if len(piece) == 1)
        self.compatible = Memo(self._compatible, PAIR_ENTRIES)

    def _compatible(self, pair: tuple[str, str]) -> bool:
        """Whether merging the characters of both pieces ends with just these two."""
        first, second = pair
        joined = first + second
        expected = [0, len(first)] if first else [0]
        return merges(joined, self.words.rank) == expected

    def last_tokens(self, chunk: str) -> list[str | None]:
        """For each end position the last token of the prefix that ends there, None if no token does.

        ``chunk`` has only characters that are pieces.
        """
        last: list[str | None] = [""] + [None] * len(chunk)
        compatible = self.compatible
        for end, piece in self.automaton.iter(chunk):
            end += 1
            if last[end] is None:
                before = last[end - len(piece)]
                if before is not None and compatible[before, piece]:
                    last[end] = piece
        return last

    def _known_ids(self, chunk: str) -> list[int]:
        last, found, at = self.last_tokens(chunk), [], len(chunk)
        while at:
            token = last[at]
            found.append(self.words.id[token])
            at -= len(token)
        return found[::-1]

    def ids(self, chunk: str) -> list[int]:
        """Ids of a chunk; characters that are no piece become bytes and part what is around them."""
        if self.alphabet.issuperset(chunk):
            return self._known_ids(chunk)
        found, start = [], 0
        for at, character in enumerate(chunk):
            if character not in self.alphabet:
                found += self._known_ids(chunk[start:at]) + [self.words.byte[b] for b in character.encode()]
                start = at + 1
        return found + self._known_ids(chunk[start:])

    def decode(self, ids: list[int]) -> str:
        """The text of ids, byte pieces decoded together, marks as spaces (the first mark kept)."""
        out, raw = [], bytearray()
        first = self.words.byte[0]
        for i in ids:
            if first <= i < first + 256:
                raw.append(i - first)
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.words.piece.get(i, ""))
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out).replace(MARK, " ")


@lru_cache(maxsize=2)
def worker_codec(model_file: str) -> tuple[Encoder, Memo, Memo]:
    """A worker's encoder, its ids by chunk, and its chunks shown as (count, decimal ids, text); kept from task to task."""
    encoder = Encoder(vocabulary(model_file))

    def shown(rest: str) -> tuple[int, str, str]:
        ids = encoder.ids(MARK + rest)
        return len(ids), " ".join(map(str, ids)), encoder.decode(ids)

    return encoder, Memo(lambda rest: encoder.ids(MARK + rest), MEMO_ENTRIES), Memo(shown, MEMO_ENTRIES)


def encode(text: str, encoder: Encoder) -> list[int]:
    """All ids of a text, the end id last."""
    return [i for rest in chunks(text) for i in encoder.ids(MARK + rest)] + [encoder.words.end]


def decode(ids: list[int], encoder: Encoder) -> str:
    """The text of ids; the mark that encoding puts before a text is dropped."""
    return encoder.decode(ids).removeprefix(" ")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` with the end id, and the text decoded from them."""

    def run(batches):
        encoder, known, _ = worker_codec(model_file)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                ids = [[i for rest in chunks(text or "") for i in known[rest]] + [encoder.words.end] for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([decode(x, encoder) for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return _rows(docs).mapInArrow(run, SCHEMA)


def digest_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """``encode_documents`` with digests in place of ids and decoded text.

    A chunk's ids as decimal text and its decoded text are remembered together; decoding
    chunks one by one gives what decoding all ids gives, since no character's byte pieces
    cross a chunk.
    """

    def run(batches):
        encoder, _, known = worker_codec(model_file)
        end = str(encoder.words.end)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1).to_pylist():
                parts = [known[rest] for rest in chunks(text or "")]
                counts.append(sum(n for n, _, _ in parts) + 1)
                ids_sha.append(hashlib.sha256(" ".join([*(s for _, s, _ in parts), end]).encode()).hexdigest())
                decoded = "".join([d for _, _, d in parts])
                decoded_sha.append(hashlib.sha256(decoded.removeprefix(" ").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _rows(docs).mapInArrow(run, DIGEST_SCHEMA)
