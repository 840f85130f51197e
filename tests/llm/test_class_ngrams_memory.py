"""Class-based scoring: what a task holds depends on the size of a slice, not on how many there are."""

import collections
import glob
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rollcall.llm import class_ngrams

DDL = "doc_id long, text string"


def texts(n, most=40):
    rng = random.Random(5)
    return [" ".join(f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(rng.randint(0, most))) for _ in range(n)]


def peak(function):
    function()
    tracemalloc.start()
    try:
        return function(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def slice_of(some, classed):
    """A slice of ``some`` texts, every third held out, where words that ``classed`` accepts have a class."""
    ids = list(range(len(some)))
    row = class_ngrams._encoded(0, ids, [i % 3 == 0 for i in ids], [t.encode() for t in some])
    at = np.flatnonzero(classed(np.arange(len(row.column("words")[0]))))
    right = pa.table({"at": pa.array(at.astype(np.int32)), "class": pa.array((class_ngrams.FIRST + at % 5).astype(np.int32))})
    return row, class_ngrams.Slice(pa.Table.from_batches([row]), right)


def test_a_slice_is_a_row_group(spark, monkeypatch):
    monkeypatch.setattr(class_ngrams, "SLICE_BYTES", 2000)
    slices = class_ngrams.encoded(spark.createDataFrame(list(enumerate(texts(400))), DDL).repartition(2))
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(slices.settled_path.removeprefix("file:") + "/*.parquet")]
    sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert len(sizes) == slices.count() > 5 and set(sizes) == {1}


def test_texts_come_in_batches_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(class_ngrams, "BATCH_BYTES", 5000)
    before = spark.conf.get(class_ngrams.ARROW_BYTES)
    frame = spark.createDataFrame([(i, "x" * 100) for i in range(1000)], DDL).coalesce(1)

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    run = class_ngrams._settle(frame.mapInArrow(counted, "n long"), "batches")
    sizes = [r.n for r in run.collect()]
    assert sum(sizes) == 1000 and max(sizes) < 100
    assert spark.conf.get(class_ngrams.ARROW_BYTES) == before


def test_memory_of_a_slice():
    some = [f"{t} {' '.join(f'u{i}x{j}' for j in range(20))}" for i, t in enumerate(texts(2000, 400))]
    size = sum(map(len, some))
    data = [t.encode() for t in some]
    _, most = peak(lambda: class_ngrams._encoded(0, list(range(len(data))), [False] * len(data), data))
    assert most < 8 * size
    _, part = slice_of(some, lambda at: at < 500)
    tokens = len(part.tokens)
    _, most = peak(lambda: part.contexts(7, True))
    assert most < 24 * tokens


@pytest.mark.parametrize("stride", [1, 7, 1 << 17])
@pytest.mark.parametrize("frequent", [True, False])
def test_contexts_by_brute_force(monkeypatch, stride, frequent):
    some = [*texts(60), "", "w1", "W1 w1 w1"]
    monkeypatch.setattr(class_ngrams, "STRIDE", stride)
    row, part = slice_of(some, lambda at: at % 2 == 0)
    words, total = row.column("words")[0].values.to_pylist(), 7
    at, lines = 0, []
    for i, n in enumerate(part.sizes.tolist()):
        if i % 3:
            lines += part.tokens[at : at + n].tolist()
        at += n
    number = [0 if w == class_ngrams.END_HASH else int(part.classes[i]) for i, w in enumerate(words)]
    want, last = collections.defaultdict(collections.Counter), class_ngrams.END
    for j, i in enumerate(lines):
        want[None][last * total + number[i]] += 1
        if words[i] != class_ngrams.END_HASH and bool(part.known[i]) == frequent:
            want[words[i]][number[lines[j + 1]]] += 1
            want[words[i]][total + last] += 1
        last = number[i]
    got = part.contexts(total, frequent).to_pylist()
    assert {r["word"]: dict(zip(r["codes"], r["times"], strict=True)) for r in got} == want and len(got) == len(want)
    counts = collections.Counter(lines)
    assert row.column("counts")[0].values.to_pylist() == [counts[i] for i in range(len(words))]


def test_moved_words_have_their_number(spark):
    total = 7
    rows = [(1, 2, [0, 3, total + 3], [2, 5, 7]), (2, 3, [total + 2, 2], [1, 1])] + [(i, 2, [2, total + 4], [i, i]) for i in range(3, 60)]
    frame = spark.createDataFrame(rows, "word long, class int, codes array<int>, times array<long>")
    got = {r.word: (r.n, r["class"]) for r in class_ngrams.moved(frame, np.ones((total, total))).collect()}
    assert {w: n for w, (n, _) in got.items()} == {1: 7, 2: 1} | {i: i for i in range(3, 60)}
    assert all(class_ngrams.FIRST <= c < total for _, c in got.values())
