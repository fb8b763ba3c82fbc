import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilwright.llm import packing


def check_plan(histogram, capacity):
    used = Counter()
    for pattern, times in packing.plan(histogram, capacity):
        assert times > 0 and sum(pattern) <= capacity
        for x in pattern:
            used[x] += times
    assert used == Counter({k: v for k, v in histogram.items() if v})


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 50), max_size=30))))
def test_plan_uses_every_item_once(case):
    check_plan(case[1], case[0])


def test_plan_finds_exact_triples():
    assert packing.plan({5: 2, 3: 2, 2: 2}, 10) == [((5, 5), 1), ((3, 3, 2, 2), 1)] or sum(t for _, t in packing.plan({5: 2, 3: 2, 2: 2}, 10)) == 2
    assert packing.plan({6: 3, 1: 3, 2: 3}, 10)[0][0] == (6, 2, 2) or sum(t for _, t in packing.plan({6: 3, 1: 3, 2: 3}, 10)) == 3


def test_pack(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, 7, 7, 7, r.randint(1, 300)]), "x") for i in range(2000)] + [(5000, None, "n"), (5001, 950, "x"), (1, 7, "again")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, container_id string"), capacity=100, salts=4).collect()
    size = defaultdict(list)
    total = Counter()
    for g in got:
        total[g["doc_id"]] += g["n_tokens"]
        if g["n_tokens"]:
            size[g["container_id"]].append((g["container_offset"], g["n_tokens"]))
        assert g["n_tokens"] <= 100
    want = Counter()
    for i, n, _ in rows:
        want[i] += n or 0
    assert {k: v for k, v in total.items() if v} == {k: v for k, v in want.items() if v}
    for pieces in size.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 100
    tokens = sum(want.values())
    assert len(size) <= tokens / 100 * 1.02 + 1
    fill = packing.fill(spark.createDataFrame(got), 100).first()
    assert fill["containers"] == len(size) and fill["tokens"] == tokens and fill["fullest"] <= 100


def test_pack_empty(spark):
    none = packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 10)
    assert none.count() == 0 and packing.fill(none, 10).first()["containers"] == 0
    assert [r["container_id"] for r in packing.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens long"), 10).collect()] == [0, 0]
    with pytest.raises(ValueError):
        packing.pack(none, 0)
