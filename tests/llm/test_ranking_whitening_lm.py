"""Whitening, ranked search and class-based scoring: brute force, edge cases, held-out accuracy."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import class_ngrams, lexical_search, whitening
from rollcall.workdir import settle

DDL = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
CLASHES = ("term", "terms", "times", "n", "x", "ids", "values", "item", "rank", "score", "word", "class", "slice", "held", "at", "sum", "size")


def clashing(frame):
    return settle(frame.withColumns({c: F.lit("clash") for c in CLASHES}), "clash")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# whitening

def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 60)) * np.linspace(0.5, 2.5, 60)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(base.astype(np.float32))]
    rows += [(900, None), (901, [1.0] * 59 + [None]), (902, [1.0] * 59 + [float("nan")]), (903, [float("inf")] + [0.0] * 59)]
    return rows + [rows[5], rows[5], (None, rows[6][1]), (904, rows[7][1][:10])]


def plain_whitening(rows, k=32):
    kept = [(i, [*v, *[0.0] * (60 - len(v))]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + 1_000_000
    away = x - x.mean(axis=0)
    values, vectors_ = np.linalg.eigh(away.T @ away / len(x))
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    n, sums = len(x), x.sum(axis=0)
    return [i for i, _ in kept], np.square(n * x - sums).sum(axis=1), away @ vectors_[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_by_brute_force(spark, parts):
    rows = vectors()
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts))
    got = whitening.whiten(frame).collect()
    ids, deviation, white, explained = plain_whitening(rows)
    assert len(got) == len(ids) * 32 and {r.n for r in got} == {len(ids)}
    want = sorted(zip(map(str, ids), deviation.tolist(), (tuple(w) for w in np.round(np.abs(white), 6)), strict=True))
    whole = collections.defaultdict(list)
    for i in range(0, len(got), 32):
        some = got[i : i + 32]
        assert [r.component for r in some] == list(range(1, 33))
        whole[str(some[0].vec_id)].append((some[0].deviation, np.array([abs(r.whitened) for r in some])))
    for key, dev, expected in want:
        place = next(j for j, (d, w) in enumerate(whole[key]) if d == dev and np.allclose(w, expected, atol=1e-5))
        whole[key].pop(place)
    assert not any(whole.values())
    first = {r.component: r for r in got}
    assert np.allclose([first[i].explained for i in range(1, 33)], explained, rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_signs_are_the_same_for_all_rows(spark):
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>")
    got = whitening.whiten(frame.repartition(3)).filter("component = 2").groupBy("vec_id").agg(F.countDistinct("whitened").alias("n")).filter("n > 1").count()
    assert got == 0  # equal vectors have equal coordinates


def test_dimensions_without_variance(spark):
    flat = [(i, [1.0, 2.0, float(i % 3)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0
    huge = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()} == {1}


def test_flat_spectrum_is_certified():
    rng = np.random.default_rng(1)
    for gap in (1e-3, 1e-9, 0.0):
        turn = np.linalg.qr(rng.standard_normal((120, 120)))[0]
        values = 1 - gap * np.arange(120)
        passes = []
        cov = (turn * values) @ turn.T
        found, block, residuals = whitening.leading_pairs(lambda q, c=cov, p=passes: p.append(1) or c @ q, 120, 32)
        assert np.allclose(found, values[:32], atol=1e-10) and residuals.max() < 1e-11 and np.allclose(block.T @ block, np.eye(32), atol=1e-12)


def test_filter_is_a_chebyshev_polynomial():
    values = np.linspace(0.0, 3.0, 40)
    once = whitening.filtered(lambda q: values[:, None] * q, np.ones((40, 1)), values[:, None], 0.0, 2.0, 3.0, 9)[:, 0]
    plain = np.polynomial.chebyshev.Chebyshev.basis(9)(values - 1)
    assert np.allclose(once, plain / plain[-1], atol=1e-12)


# ranked search

def plain_search(docs, items, k=10):
    words = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    big_n, big_l = sum(map(bool, words)), sum(map(len, words))
    df = collections.Counter(t for w in words for t in set(w))
    out = []
    for item_id, text in items:
        asked = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for (doc_id, _), w in zip(docs, words, strict=True):
            tf, score = collections.Counter(w), 0
            for t, times in asked.items():
                if t in tf:
                    weight = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    m = 25 + (75 * len(w) * big_n) // big_l
                    score += times * weight * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, i, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def library(n=400):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["É1", "漢字", "a_b", "x-y"]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.choice([1, 5, 40, 300]))) for _ in range(n)]
    texts += [texts[3]] * 40 + [None, "", " \t\n,.;", "W1 w1 W1!", "x" * 30_000, "w2 " * 20_000]
    docs = list(enumerate(texts)) + [(3, texts[9]), (None, texts[3]), (None, texts[4])]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 30])))) for i in range(25)]
    return docs, items + [(50, None), (51, ""), (52, "nothing here zzz"), (5, "w1 w1 w2"), (None, "w7 w8"), (53, texts[3]), (54, "w2")]


@pytest.mark.parametrize("settings", [{}, {"SHARD_POSTINGS": 500, "FIRST_READ": 2}, {"SHARD_DOCUMENTS": 1, "FIRST_READ": 1}])
def test_search_by_brute_force(spark, monkeypatch, settings):
    docs, items = library()
    for name, value in settings.items():
        monkeypatch.setattr(lexical_search, name, value)
    frame = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    asked = clashing(spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(lexical_search.search(frame, asked)) == plain_search(docs, items)
    assert rows_of(lexical_search.search(frame, asked, 3, block_bytes=40)) == plain_search(docs, items, 3)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for docs, items in ((none, some), (some, none), (none, none)):
        assert lexical_search.search(docs, items.withColumnRenamed("doc_id", "item_id")).collect() == []


def shard_of(documents):
    """A shard with weights 1: documents as lists of (term, times), all of the same length."""
    sizes = np.array([len(d) for d in documents])
    term, times = (np.array([p[i] for d in documents for p in sorted(d)], np.int64) for i in (0, 1))
    return lexical_search.Shard(np.arange(len(documents)), sizes, term, times, np.full(len(documents), 10), np.ones(3, np.int64), len(documents), 10 * len(documents))


def test_reading_stops_before_the_end_but_not_within_ties():
    high = [[(0, 50), (1, 50)] for _ in range(20)]
    shard = shard_of(high + [[(i % 2, 1)] for i in range(5000)])
    met = []
    score = shard._score
    shard._score = lambda docs: met.extend(docs.tolist()) or score(docs)
    scores, ids = shard.search(np.array([0, 1]), np.array([1, 1]), 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert ids.tolist() == list(range(10)) and len(set(scores.tolist())) == 1
    assert set(range(20)) <= set(met) and len(met) < 1000  # all equal documents, few of the others


# class-based scoring

def texts_of_two_kinds(n=600):
    """Nouns follow determiners and verbs follow nouns, so classes tell more than words alone."""
    rng = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(40)] for k in ("det", "noun", "verb")]
    make = lambda n: " ".join(rng.choice(kinds[i % 3]).upper() if rng.random() < 0.1 else rng.choice(kinds[i % 3]) for i in range(3 * n))
    rows = [(i, make(rng.randint(1, 20)), "s") for i in range(n)]
    return rows + [(n, None, "s"), (n + 1, "", "s"), (n + 2, " \n\t", "s"), (n + 3, "once é漢 noun1", None), (None, "det1 noun1", "s"), rows[0], rows[0], (3, "other text", "s"), (n + 4, make(7000), "s"), (n + 5, "y" * 40_000, "s")]


def plain_base(rows):
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows}
    tokens = [(r[0], [*WORD.findall((r[1] or "").translate(LOWER)), " "]) for r in rows]
    counts = collections.Counter(t for i, ts in tokens if not held[i] for t in ts)
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, held[i], len(ts), sum(t in counts for t in ts), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 4)) for i, ts in tokens), key=str)


@pytest.mark.parametrize("settings", [{}, {"SLICE_BYTES": 700, "PART_BYTES": 300, "GAIN_ROWS": 50}])
def test_base_score_and_held_out_perplexity(spark, monkeypatch, settings):
    rows = texts_of_two_kinds()
    for name, value in settings.items():
        monkeypatch.setattr(class_ngrams, name, value)
    got = class_ngrams.score_documents(clashing(spark.createDataFrame(rows, DDL)), 6, 4).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == plain_base(rows)
    held = [r for r in got if r.held_out and r.n_tokens == r.n_known and r.n_tokens < 100]
    assert len(held) > 30
    # 120 words in three kinds: knowing the kind leaves 40 choices
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)
    same = {r.score for r in got if r.doc_id == 0}
    assert len(same) == 1  # repeated rows score alike


def test_texts_without_training(spark):
    held = [(i, f"a b{i}", "s") for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = class_ngrams.score_documents(spark.createDataFrame(held, DDL)).collect()
    assert len(got) == len(held) and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == 0 and r.base_score == 0 for r in got)
    assert class_ngrams.score_documents(spark.createDataFrame([], DDL)).collect() == []


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(2)
    counts, of_class = rng.integers(0, 9, (7, 7)).astype(float), rng.integers(1, 50, 7).astype(float)
    counts[class_ngrams.OTHER] = counts[:, class_ngrams.OTHER] = of_class[class_ngrams.OTHER] = 0
    steps = 10 ** class_ngrams.log_transitions(counts, of_class, class_ngrams.unknown_share(1000, 30))
    assert np.allclose(steps.sum(axis=1), 1)
    assert class_ngrams.unknown_share(0, 0) == 1 and 0 < class_ngrams.unknown_share(5, 5) < 1


def test_exchange_gain_by_brute_force():
    """The gain that decides a move is the difference of the likelihood before and after, up to self pairs."""
    rng = random.Random(6)
    total, words = 6, {w: 2 + w % 4 for w in range(12)}
    tokens = [rng.randrange(12) for _ in range(400)]
    tokens = [t for i, t in enumerate(tokens) if i == 0 or tokens[i - 1] != t]

    def pairs(classes):
        m = np.zeros((total, total))
        for a, b in zip([None, *tokens], [*tokens, None], strict=True):
            m[0 if a is None else classes[a], 0 if b is None else classes[b]] += 1
        return m

    def likelihood(m):
        return class_ngrams.plogp(m).sum() - class_ngrams.plogp(m.sum(axis=0)).sum() - class_ngrams.plogp(m.sum(axis=1)).sum()

    for word in range(12):
        around = collections.Counter()
        for a, b in zip([None, *tokens], [*tokens, None], strict=True):
            if a == word:
                around[0 if b is None else words[b]] += 1
            if b == word:
                around[total + (0 if a is None else words[a])] += 1
        code, times = (np.array(x) for x in zip(*sorted(around.items()), strict=True))
        n = sum(t for c, t in around.items() if c < total)
        new = class_ngrams.best_classes(pairs(words), np.zeros(len(code), int), code, times, np.array([n]), np.array([words[word]]))[0]
        best = max(likelihood(pairs(words | {word: c})) for c in range(2, total))
        assert likelihood(pairs(words | {word: int(new)})) >= best - 3.0
