"""The work for one large group of near copies."""

import random

from rollcall.llm import parity_join


def test_pairs_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    chance = random.Random(3)
    base = [f"w{i}" for i in range(200)]

    def copy(places):
        return " ".join(f"x{chance.random()}" if i in places else w for i, w in enumerate(base))

    # document 0 has blocks in common with all, and is too far from each to link them at once
    n = 300
    rows = [(0, copy(set(range(10, 190, 25))))] + [(i, copy({chance.randrange(200)})) for i in range(1, n)]
    asked, verified = [], parity_join.verified

    def counting(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(parity_join, "verified", counting)
    got = parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.component_id for r in got if r.doc_id} == {1} and {r.component_id for r in got if not r.doc_id} == {0}
    assert sum(asked) <= 12 * n
