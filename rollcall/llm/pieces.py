"""The merge vocabulary of a SentencePiece BPE model, as its two users need it.

The model file is only read for its pieces and scores. Pieces never hold a word mark after
another character (checked on reading), so no merge crosses the start of a run of marks and
a text may be cut there; ``chunks`` yields these cuts.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Vocabulary:
    """Pieces with rank (0 merges first) and id, and the ids of the 256 byte pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        level = {score: rank for rank, score in enumerate(sorted({-model.get_score(i) for i in normal}))}
        self.end = model.eos_id()
        self.id = {model.id_to_piece(i): i for i in normal}
        self.rank = {model.id_to_piece(i): level[-model.get_score(i)] for i in normal}
        self.piece = {i: piece for piece, i in self.id.items()}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.id):
            raise ValueError("a piece crosses words; texts can't be cut into chunks for this model")


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def chunks(text: str) -> Iterator[str]:
    """Chunks without their first mark; put together with it they are the marked text."""
    marked = text.replace(" ", MARK)
    if MARK * 2 in marked or marked[:1] == MARK or marked[-1:] == MARK:
        return (m[0][1:] for m in CHUNK.finditer(MARK + marked))
    return iter(marked.split(MARK) if marked else ())


def merges(chunk: str, rank: dict[str, int]) -> list[int]:
    """Starts of the symbols that are left when no adjacent pair of ``chunk`` is a piece.

    Symbols are a linked list (``after``, ``before``); a heap gives the pair of lowest rank,
    the leftmost of equals. Entries whose symbols have changed since are skipped.
    """
    n = len(chunk)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank[chunk[i : i + 2]], i, i + 2) for i in range(n - 1) if chunk[i : i + 2] in rank]
    heapq.heapify(heap)
    while heap:
        _, left, end = heapq.heappop(heap)
        middle = after[left]
        if middle >= n or middle < 0 or after[middle] != end:
            continue
        after[left], after[middle] = end, -1
        if end < n:
            before[end] = left
            if (r := rank.get(chunk[left : after[end]])) is not None:
                heapq.heappush(heap, (r, left, after[end]))
        if (previous := before[left]) >= 0 and (r := rank.get(chunk[previous:end])) is not None:
            heapq.heappush(heap, (r, previous, end))
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = after[at]
    return starts


class Memo(dict):
    """A dictionary filled by a function; emptied when it holds ``most`` entries, so memory is bounded."""

    def __init__(self, function, most: int, longest: int = 64):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
