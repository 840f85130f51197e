"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SLICE_BYTES = 1 << 18
_random = np.random.Generator(np.random.PCG64(4))
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), STEP, np.uint64)]))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, and the number of words of each text."""
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends_of_texts])))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    letters = np.flatnonzero(inside)
    word = np.cumsum(first)[letters] - 1
    place = letters - starts[word]
    weight = BYTE[data[letters]] * _powers(int(place.max()) + 1)[place]
    return mix(np.add.reduceat(weight, np.flatnonzero(first[letters])) ^ STEP), counts


def shingle_sets(texts: Iterable[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted different hashes of its shingles of ``size`` words, lower-case in A-Z.

    A text of fewer words has its whole sequence as one; without words, none.
    """
    batch: list[bytes] = []
    weight = 0
    for text in texts:
        batch.append((text or "").encode())
        weight += len(batch[-1])
        if weight >= SLICE_BYTES:
            yield from _sets(batch, size)
            batch, weight = [], 0
    if batch:
        yield from _sets(batch, size)


def _sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    words, counts = word_hashes(texts)
    n = max(0, len(words) - size + 1)
    every = np.zeros(n, np.uint64)
    for i in range(size):
        every += words[i : i + n] * PLACE[i]
    every = mix(every)
    at = 0
    for count in counts.tolist():
        if count >= size:
            yield np.unique(every[at : at + count - size + 1])
        elif count:
            yield mix(np.sum(words[at : at + count] * PLACE[:count], keepdims=True) + np.uint64(count))
        else:
            yield np.zeros(0, np.uint64)
        at += count
