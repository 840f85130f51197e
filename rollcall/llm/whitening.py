"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers x = floor(64 c) + 1000000 and are written once as blocks of
rows. The covariance V is never formed: a pass lets every task multiply its centred rows,
(X - mean)' ((X - mean) Q) / n, and adds up the small dimension-by-block products. One round
of the iteration sends the block through a Chebyshev polynomial of V (one pass per degree)
that keeps [0, smallest Ritz value] small and lets the wanted end grow, makes it orthonormal
by QR, and takes Ritz pairs from one further pass. It ends when every wanted pair is
certified: its residual, which bounds the distance of the value to an eigenvalue and, over
the gap to its neighbours, the angle to the eigenvector, is near double precision. The block
holds ``SPARE`` vectors more than are wanted; after ``PATIENCE`` rounds without certificate
it is doubled, so that a flat spectrum ends too, at the latest when it spans the whole space.

Only n, the sums per dimension and the products reach the driver, at most ``FAN_IN``
products at a time; vectors stay in the tasks. Products are centred before multiplying, and
sums of whole numbers are exact.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are left
out; entries beyond ``LARGEST`` in size count as that. Shorter vectors are filled with entries 0 to the longest. Repeated rows and ids count
and are returned as often as they are there; null ids are kept. Components whose variance is
zero to double precision (constant or dependent dimensions, fewer rows than dimensions)
can't be whitened and are not returned, so without any variance the result is empty, as it is
for an empty table. ``deviation`` is null where it doesn't fit a long. Only ``vec_id`` and
``embedding`` are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.workdir import settle

COMPONENTS = 32
SPARE = 16
DEGREE = 12
PATIENCE = 8
LARGEST = 2.0**34
GAP_SHARE = 1e-9
EPSILON = np.finfo(np.float64).eps
SCALE, SHIFT = 64, 1_000_000
BLOCK_ROWS = 4096
FAN_IN = 256
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_entries(vector: Column) -> Column:
    """Entries as whole numbers, null if the vector or one of its entries is missing or not finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    bounded = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double")))
    return F.when(finite, F.transform(vector, lambda c: F.floor(bounded(c) * SCALE).cast("long") + SHIFT))


def packed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of rows (``ids`` and the whole numbers as ``values``), a written table, and the dimension."""
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole_entries(F.col("embedding")).alias("x")).filter("x is not null")
    kept = settle(whole, "vectors")
    width = kept.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                sizes = pa.compute.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                block = np.full((len(part), width), SHIFT, np.int64)
                block[np.arange(width) < sizes[:, None]] = part.column(1).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([block.tobytes()], pa.binary())], names=["ids", "values"])

    return settle(kept.mapInArrow(run, "ids array<long>, values binary"), "blocks"), width


def blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, np.ndarray]]:
    for batch in batches:
        for ids, values in zip(batch.column("ids").to_pylist(), batch.column("values"), strict=True):
            yield ids, np.frombuffer(values.as_buffer(), np.int64).reshape(len(ids), width)


def added_up(table: DataFrame, width: int, shape: tuple[int, ...], product: Callable[[np.ndarray], np.ndarray], kind=np.float64) -> np.ndarray:
    """The sum of ``product`` over all blocks, added up in the tasks first."""

    def partial(batches):
        total = np.zeros(shape, kind)
        for _, block in blocks_of(batches, width):
            total += product(block)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    def merged(batches):
        total = np.zeros(shape, kind)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    sums, tasks = table.mapInArrow(partial, "sum binary"), table.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sums = sums.repartition(tasks).mapInArrow(merged, "sum binary")
    return np.sum([np.frombuffer(row[0], kind).reshape(shape) for row in sums.collect()], axis=0, dtype=kind)


@dataclass(frozen=True)
class Centre:
    """The mean less ``SHIFT``: its whole part, taken off exactly before rows become doubles, and the rest."""

    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - SHIFT - self.whole).astype(np.float64) - self.rest


class Covariance:
    """Products with the covariance of all rows of a written table of blocks."""

    def __init__(self, table: DataFrame, width: int):
        self.table, self.width = table, width
        counted = added_up(table, width, (width + 1,), lambda x: np.append((x - SHIFT).sum(axis=0), len(x)), np.int64)
        self.n, self.sums = int(counted[-1]), counted[:-1]
        whole = self.sums // max(1, self.n)
        self.centre = Centre(whole, (self.sums - whole * self.n) / max(1, self.n))

    def times(self, block: np.ndarray) -> np.ndarray:
        centred = self.centre.centred

        def product(x):
            rows = centred(x)
            return rows.T @ (rows @ block)

        return added_up(self.table, self.width, block.shape, product) / self.n

    def trace(self) -> float:
        centred = self.centre.centred
        return float(added_up(self.table, self.width, (1,), lambda x: np.square(centred(x)).sum(keepdims=True)[0])[0]) / self.n


def filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, image: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of V that is at most 1 on [low, cut] in size, of value 1 at ``top``, applied to ``block``.

    ``image`` is V times ``block``, which the Ritz step before has already.
    """
    half, centre = (cut - low) / 2, (cut + low) / 2
    scale = first = half / (top - centre)
    before, now = block, (image - centre * block) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, (times(now) - centre * now) * (2 * after / half) - before * (scale * after)
        scale = after
    return now


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues of V, falling, their unit vectors as columns, and their residuals.

    ``times`` multiplies with V. Pairs without variance to double precision are left out.
    """
    wanted = min(wanted, width)
    size = min(width, wanted + SPARE)
    rng = np.random.default_rng(11)
    block = np.linalg.qr(rng.standard_normal((width, size)))[0]
    for turn_no in itertools.count(1):
        image = times(block)
        inner = block.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        residuals = np.linalg.norm(image - block * values, axis=0)
        gaps = np.abs(np.diff(values, append=0.0))
        gaps = np.minimum(gaps, np.concatenate([[np.inf], gaps[:-1]]))
        noise = 8 * width * EPSILON * max(values[0], 0.0)
        certified = residuals <= np.maximum(GAP_SHARE * gaps, noise)
        if size == width or certified[:wanted].all():
            break
        block = filtered(times, block, image, 0.0, max(values[-1], EPSILON * values[0]), values[0], degree)
        if turn_no % PATIENCE == 0:
            more = min(width - size, size)
            block, size = np.column_stack([block, rng.standard_normal((width, more)) * np.abs(block).max()]), size + more
        block = np.linalg.qr(block)[0]
    kept = np.flatnonzero(values[:wanted] > noise)
    return values[kept], block[:, kept], residuals[kept]


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    spark = rows.sparkSession
    table, width = packed(rows)
    if not width:
        return spark.createDataFrame([], SCHEMA)
    covariance = Covariance(table, width)
    values, vectors, _ = leading_pairs(covariance.times, width, components)
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    n, k, centred, whole, sums = covariance.n, len(values), covariance.centre.centred, covariance.centre.whole, covariance.sums
    explained = values / covariance.trace()
    to_white = vectors / np.sqrt(values)

    def moments(x):
        white = np.column_stack([centred(x) @ to_white, np.ones(len(x))])
        return white.T @ white

    sums_of = added_up(table, width, (k + 1, k + 1), moments) / n
    error = float(np.abs(sums_of[:k, :k] - np.outer(sums_of[k, :k], sums_of[k, :k]) - np.eye(k)).max())
    left = sums - n * whole

    def deviations(x: np.ndarray) -> list[int | None]:
        away = x - SHIFT - whole
        size = np.square(n * away.astype(np.float64) - left).sum(axis=1)
        if size.max(initial=0) < 2.0**62:
            return np.square(n * away - left).sum(axis=1).tolist()
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, left.tolist(), strict=True)) for row in away.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def run(batches):
        for ids, x in blocks_of(batches, width):
            rows, deviation = np.repeat(np.arange(len(ids)), k), pa.array(deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                    pa.array(np.full(len(rows), n, np.int64)), deviation.take(pa.array(rows)), pa.array((centred(x) @ to_white).ravel()),
                    pa.array(np.tile(explained, len(ids))), pa.array(np.full(len(rows), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return table.mapInArrow(run, SCHEMA)
