"""Scoring texts with a Brown class-based bigram model.

Every training word belongs to one class, and a text has the probability of its class
transitions times its words' share of their classes. Classes come from exchange clustering:
the most frequent words open one class each, then every frequent word moves to the class where
the likelihood of the class bigrams gains most, all words at once against the counts of the
round before, ``ROUNDS`` times over; words rarer than ``FREQUENT`` follow in one step of the
same kind. Gains are those of sum N(c,d) log N(c,d) - 2 sum N(c) log N(c), the word's own
counts taken out of its present class first.

Texts are encoded once, in slices of about ``SLICE_BYTES``: the slice's different words (as
64-bit hashes) and its tokens as places in that list. Words are counted, and get their class,
by joins on the lists, so no vocabulary is sent to the tasks; a slice meets the classes of its
own words in one group of bounded size. Contexts (the classes beside a word) are counted per
slice; those of frequent words are summed per word and class before they are gathered, so a
gathered word has at most two entries per class, and a rare word fewer than 2 ``FREQUENT``.
Only totals, the class matrix and the opening words reach the driver.

A task's memory follows from these sizes, not from how many texts or slices its split has:
texts come to Python in batches of ``BATCH_BYTES``, a slice's tokens are worked on ``STRIDE``
at a time, and a slice is a row group of its own, so that readers hold one of them.

Tokens are words, A-Z lower-cased, and one end per text, which also precedes the first word.
Words not in training are one further event with the share that Good and Turing give it.
Transitions are smoothed towards the classes' shares. All probabilities of a context add up to 1.

Defined results: null text counts as empty and has its end only. Texts of any length are
scored whole, a very long one in a slice of its own. A null id counts as an empty text for the
checksum, so such rows are held out; repeated rows and ids are texts of their own. Ties between
classes go to the lower number, ties between words to the lower hash. An empty table gives an
empty result; without training texts everything is unknown and scores 0. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shingles import word_hashes
from rollcall.workdir import discard, settle

CLASSES = 64
FREQUENT = 64
ROUNDS = 2
SLICE_BYTES = 8 << 20
PART_BYTES = 1 << 18
STRIDE = 1 << 17
BATCH_BYTES = 1 << 20
PRIOR = 0.1
SMOOTHING = 4.0
END, OTHER, FIRST = 0, 1, 2  # class of the end, of words without a class (later: unknown ones), first class of words
END_HASH = 0
GAIN_ROWS = 10_000
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SLICES = "slice long, words array<long>, counts array<long>, tokens binary, sizes array<long>, ids array<long>, held array<boolean>"
CONTEXTS = "word long, codes array<int>, times array<long>"
RESOLVED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _settle(df: DataFrame, name: str, **options) -> DataFrame:
    """``settle`` with at most ``BATCH_BYTES`` (or one row) in each batch sent to Python."""
    conf = df.sparkSession.conf
    before = conf.get(ARROW_BYTES)
    conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        return settle(df, name, **options)
    finally:
        conf.set(ARROW_BYTES, before)


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts of about ``PART_BYTES``, cut at white space."""
    at = 0
    while len(data) - at > PART_BYTES and (cut := SPACE.search(data, at + PART_BYTES)):
        yield data[at : cut.end()]
        at = cut.end()
    yield data[at:]


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words of each text, about ``PART_BYTES`` at a time."""
    parts = [(i, part) for i, text in enumerate(texts) for part in _parts(text)]
    group = np.cumsum([len(part) + 1 for _, part in parts]) // PART_BYTES
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for number in np.unique(group):
        some = [parts[j] for j in np.flatnonzero(group == number)]
        found, n = word_hashes([part for _, part in some])
        hashes.append(found)
        np.add.at(counts, [i for i, _ in some], n)
    return np.concatenate(hashes), counts


def _encoded(number: int, ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
    """One slice: its different words, how often training has each, and all tokens as places in them, byte by byte."""
    hashes, counts = _hashes(texts)
    sizes = counts + 1
    is_end = np.zeros(int(sizes.sum()), bool)
    is_end[np.cumsum(sizes) - 1] = True
    tokens = np.full(len(is_end), END_HASH, np.int64)
    tokens[~is_end] = hashes.view(np.int64)
    del hashes
    rising = np.argsort(tokens)
    tokens = tokens[rising]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    words, often = tokens[first], np.diff(first, append=len(tokens))
    del tokens
    order = np.argsort(-often, kind="stable")  # frequent words get small numbers, which compress
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    words, places = words[order], np.empty(len(rising), np.int32)
    places[rising] = np.repeat(rank, often)
    del rising
    taught, training = np.repeat(~np.array(held, bool), sizes), np.zeros(len(words), np.int64)
    for at in range(0, len(places), STRIDE):
        training += np.bincount(places[at : at + STRIDE][taught[at : at + STRIDE]], minlength=len(words))
    return pa.RecordBatch.from_pylist([{
        "slice": number, "words": words, "counts": training, "tokens": places.view(np.uint8).reshape(-1, 4).T.tobytes(), "sizes": sizes, "ids": ids, "held": held,
    }], schema=pa.schema([
        ("slice", pa.int64()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("tokens", pa.binary()),
        ("sizes", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
    ]))


def encoded(docs: DataFrame) -> DataFrame:
    """The slices of all texts; a written table."""

    def run(batches):
        number, ids, held, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                held.append(out)
                texts.append(text or b"")
                size += len(texts[-1]) + 1
                if size >= SLICE_BYTES:
                    yield _encoded(number, ids, held, texts)
                    number, ids, held, texts, size = number + 1, [], [], [], 0
        if ids:
            yield _encoded(number, ids, held, texts)

    doc_id = F.col("doc_id").cast("long")
    out = F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0
    read = docs.select(doc_id.alias("doc_id"), out.alias("held"), F.col("text").cast("string").cast("binary").alias("text"))
    return _settle(read.mapInArrow(run, SLICES), "slices", **{"parquet.block.row.count.limit": 1})


def listed(slices: DataFrame) -> DataFrame:
    """One row per slice and different word: its place, the word and how often training has it there."""
    return slices.select("slice", "counts", F.posexplode("words").alias("at", "word")).select("slice", "at", "word", F.get("counts", F.col("at")).alias("n"))


def _counted(keys: Iterator[np.ndarray], n_keys: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys below ``most``, rising, and how often each is there; in a table where that is not much larger than the keys."""
    if most > 4 * n_keys:
        return np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
    table = np.zeros(most, np.int64)
    for some in keys:
        table += np.bincount(some, minlength=most)
    seen = np.flatnonzero(table)
    return seen, table[seen]


class Slice:
    """A slice with the classes of those of its words that have one."""

    def __init__(self, left: pa.Table, right: pa.Table):
        row = left.slice(0, 1)
        flat = lambda name: row.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.words, self.sizes, self.held = flat("words"), flat("sizes"), flat("held").astype(bool)
        self.tokens = np.frombuffer(row.column("tokens")[0].as_buffer(), np.uint8).reshape(4, -1).T.copy().view(np.int32)[:, 0]
        self.at = right.column("at").to_numpy()
        self.known = np.zeros(len(self.words), bool)
        self.known[self.at] = True
        self.classes = np.full(len(self.words), OTHER, np.int64)
        self.classes[self.at] = right.column("class").to_numpy()
        self.classes[self.words == END_HASH] = END

    def contexts(self, n_classes: int, frequent: bool) -> pa.Table:
        """Classes after (code: class) and before (code: n_classes + class) the words with a class, or without one.

        A further row without a word has the counts of class pairs.
        """
        tokens, classes = self.tokens[np.repeat(~self.held, self.sizes)], self.classes.astype(np.int32)
        chosen = (self.known == frequent) & (self.words != END_HASH)
        wanted = np.flatnonzero(chosen)
        number = np.zeros(len(self.words), np.int64)
        number[wanted] = np.arange(len(wanted)) * (2 * n_classes)
        pairs, n_chosen = np.zeros(n_classes * n_classes, np.int64), 0
        for at in range(0, len(tokens), STRIDE):
            before = classes[tokens[at - 1 : at + STRIDE - 1]] if at else np.append(np.int32(END), classes[tokens[: STRIDE - 1]])
            pairs += np.bincount(before[: len(tokens) - at] * np.int32(n_classes) + classes[tokens[at : at + STRIDE]], minlength=len(pairs))
            n_chosen += np.count_nonzero(chosen[tokens[at : at + STRIDE]])

        def keys() -> Iterator[np.ndarray]:
            for at in range(0, len(tokens), STRIDE):
                here = at + np.flatnonzero(chosen[tokens[at : at + STRIDE]])
                base = number[tokens[here]]
                yield base + classes[tokens[here + 1]]  # an end follows every word
                yield base + n_classes + np.where(here > 0, classes[tokens[here - 1]], END)

        keys, times = _counted(keys(), 2 * n_chosen, len(wanted) * 2 * n_classes)
        word, code = wanted[keys // (2 * n_classes)], keys % (2 * n_classes)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        seen = np.flatnonzero(pairs)
        offsets = pa.array(np.concatenate([starts, [len(word)], [len(word) + len(seen)]]).astype(np.int32))
        return pa.table({
            "word": pa.array(np.append(self.words[word[starts]], 0), pa.int64(), mask=np.arange(len(starts) + 1) == len(starts)),
            "codes": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([code, seen]).astype(np.int32))),
            "times": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([times, pairs[seen]]).astype(np.int64))),
        })


def grouped(slices: DataFrame, classed: DataFrame, function, schema: str) -> DataFrame:
    """``function`` of every ``Slice``, with the classes that ``classed`` has for its places."""
    renamed = classed.withColumnRenamed("slice", "of_slice")  # both may come from one table
    return slices.groupBy("slice").cogroup(renamed.groupBy("of_slice")).applyInArrow(lambda left, right: function(left, right), schema)


def entries(contexts: DataFrame) -> DataFrame:
    """One row per word, code and slice."""
    return contexts.select("word", "times", F.posexplode("codes").alias("at", "code")).select("word", "code", F.get("times", F.col("at")).alias("times"))


def matrix(counted: DataFrame, n_classes: int) -> np.ndarray:
    """Counts of class pairs from rows with ``code`` and ``times``."""
    found = np.zeros(n_classes * n_classes)
    for code, n in counted.groupBy("code").agg(F.sum("times")).collect():
        found[code] = n
    return found.reshape(n_classes, n_classes)


def plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(pairs: np.ndarray, word: np.ndarray, code: np.ndarray, times: np.ndarray, n: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The class with the largest gain for each word; ``word`` numbers the entries' words from 0, in order."""
    n_classes, row = len(pairs), np.arange(len(word))
    # entry j of a word changes one count per class it may join: after (N[h, c]) or before it (N[c, h])
    counts = np.concatenate([pairs.T, pairs])[code]
    counts[row, old[word]] = np.maximum(counts[row, old[word]] - times, 0)
    gain = np.add.reduceat(plogp(counts + times[:, None]) - plogp(counts), np.flatnonzero(np.diff(word, prepend=-1)))
    totals = np.tile(pairs.sum(axis=1), (len(n), 1))
    own = np.arange(len(n)), old
    totals[own] = np.maximum(totals[own] - n, 0)
    gain -= 2 * (plogp(totals + n[:, None]) - plogp(totals))
    return FIRST + np.argmax(gain[:, FIRST:], axis=1)


def moved(words: DataFrame, pairs: np.ndarray) -> DataFrame:
    """``word``, how often training has it as ``n``, and the new class of rows with ``word``, ``class``, and ``codes`` and ``times`` of their contexts."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            ends = np.cumsum(pa.compute.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate([[0], ends[:-1]])
            code, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("codes", "times"))
            n, old = np.add.reduceat(np.where(code < len(pairs), times, 0), starts), batch.column("class").to_numpy(zero_copy_only=False)
            new, at = [], 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(ends, starts[at] + GAIN_ROWS, "right")))
                part = slice(starts[at], ends[to - 1])
                new.append(best_classes(pairs, np.repeat(np.arange(to - at), (ends - starts)[at:to]), code[part], times[part], n[at:to], old[at:to].astype(np.int64)))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(n, pa.int64()), pa.array(np.concatenate(new).astype(np.int32))], names=["word", "n", "class"])

    return words.select("word", "class", "codes", "times").mapInArrow(run, "word long, n long, class int")


def learnt(slices: DataFrame, places: DataFrame, vocabulary: DataFrame, n_classes: int = CLASSES, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """``word``, ``n`` and ``class`` of all words of the training texts; a written table."""
    spark, total = slices.sparkSession, FIRST + n_classes
    words = vocabulary.filter(F.col("word") != END_HASH)
    opening = [row.word for row in words.orderBy(F.desc("n"), "word").limit(n_classes).collect()]
    opened = spark.createDataFrame([(word, FIRST + i) for i, word in enumerate(opening)], "word long, class int")
    joined = words.join(F.broadcast(opened), "word", "left")  # at most n_classes rows
    classes = _settle(joined.filter((F.col("n") >= frequent) | F.col("class").isNotNull()).select("word", "n", F.coalesce("class", F.lit(OTHER)).alias("class")), "classes")
    known = _settle(places.select("slice", "at", "word").join(classes.select("word"), "word"), "known")
    tokens = slices.select("slice", "words", "tokens", "sizes", "held")

    def around(wanted: bool) -> DataFrame:
        classed = known.join(classes, "word").select("slice", "at", "class")
        return grouped(tokens, classed, lambda left, right: Slice(left, right).contexts(total, wanted), CONTEXTS)

    for _ in range(rounds):
        contexts = _settle(around(True), "contexts")
        summed = _settle(entries(contexts).groupBy("word", "code").agg(F.sum("times").alias("times")), "summed")
        discard(contexts)
        gathered = summed.filter("word is not null").groupBy("word").agg(F.collect_list("code").alias("codes"), F.collect_list("times").alias("times"))
        classes = _settle(moved(gathered.join(classes, "word"), matrix(summed.filter("word is null"), total)), "classes")
        discard(summed)
    contexts = _settle(around(False), "contexts")
    rare = contexts.filter("word is not null").groupBy("word").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("codes", "times")))
    every = _settle(classes.unionByName(moved(rare.withColumn("class", F.lit(OTHER)), matrix(entries(contexts.filter("word is null")), total))), "classes")
    discard(contexts)
    discard(known)
    return every


def unknown_share(train_tokens: int, singles: int) -> float:
    """Good and Turing's share of unknown words, kept below 1 where all words are single."""
    return (singles + PRIOR) / (train_tokens + singles + 2 * PRIOR) if train_tokens else 1.0


def score_documents(docs: DataFrame, n_classes: int = CLASSES, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    slices, total = encoded(docs), FIRST + n_classes
    places = listed(slices)
    vocabulary = _settle(places.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    train_tokens, different, singles = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    classes = learnt(slices, places, vocabulary, n_classes, frequent, rounds)
    of_class = np.zeros(total)
    for number, n in classes.groupBy("class").agg(F.sum("n")).collect():
        of_class[number] = n
    ends = vocabulary.filter(F.col("word") == END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of_class[END] = ends
    divisor, unknown = train_tokens + PRIOR * (different + 1), unknown_share(train_tokens, singles)

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Slice(left, right)
        n = np.where(part.words == END_HASH, float(ends), 0.0)
        n[part.at] = right.column("n").to_numpy()
        base = np.log10((n + PRIOR) / divisor)
        emission = np.log10(np.where(n > 0, n, 1.0) / np.where(n > 0, of_class[part.classes], 1.0))
        known, tokens = n > 0, part.tokens
        classes = np.where(known, part.classes, OTHER).astype(np.uint8)[tokens]
        first = np.cumsum(part.sizes) - part.sizes
        per_text = lambda values: np.add.reduceat(values[tokens], first)
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table({
            "doc_id": ids, "held_out": pa.array(part.held), "n_tokens": pa.array(part.sizes.astype(np.int64)), "n_known": pa.array(per_text(known.astype(np.int64))),
            "base_score": pa.array(per_text(base)), "emission": pa.array(per_text(emission)),
            "classes": pa.array([classes[a : a + m].tobytes() for a, m in zip(first, part.sizes, strict=True)], pa.binary()),
        })

    classed = _settle(places.select("slice", "at", "word").join(classes, "word").select("slice", "at", "n", "class"), "classed")
    resolved = _settle(grouped(slices.drop("counts"), classed, resolve, RESOLVED), "resolved")
    discard(slices)
    discard(classed)
    steps = log_transitions(transitions(resolved.filter("not held_out"), total), of_class, unknown)

    def run(batches):
        for batch in batches:
            scores = []
            for value, emission in zip(batch.column("classes"), batch.column("emission").to_pylist(), strict=True):
                here = np.frombuffer(value.as_buffer(), np.uint8)
                scores.append(emission + float(steps[np.concatenate([[END], here[:-1]]), here].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores, pa.float64())], names=[*batch.schema.names[:5], "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return resolved.mapInArrow(run, schema).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def transitions(resolved: DataFrame, total: int) -> np.ndarray:
    """How often each class follows each, over all given texts."""

    def run(batches):
        found = np.zeros(total * total, np.int64)
        for batch in batches:
            for value in batch.column(0):
                here = np.frombuffer(value.as_buffer(), np.uint8).astype(np.int64)
                found += np.bincount(np.concatenate([[END], here[:-1]]) * total + here, minlength=total * total)
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(found[seen])], names=["code", "n"])

    counts = np.zeros(total * total)
    for code, n in resolved.select("classes").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n")).collect():
        counts[code] = n
    return counts.reshape(total, total)


def log_transitions(counts: np.ndarray, of_class: np.ndarray, unknown: float) -> np.ndarray:
    """Log10 probability of each class after each; every row's probabilities add up to 1."""
    share = of_class / max(of_class.sum(), 1.0)
    smooth = (counts + SMOOTHING * share) / (counts.sum(axis=1, keepdims=True) + SMOOTHING)
    smooth *= 1 - unknown
    smooth[:, OTHER] = unknown
    return np.log10(np.maximum(smooth, 1e-300))
