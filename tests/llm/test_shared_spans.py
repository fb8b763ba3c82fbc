import random
import string

import pandas as pd

import pytest

import numpy as np

from veilwright.llm import shared_spans as S
from veilwright.llm.shared_spans import SpanIndex, merge_intervals, shared_fraction, shared_spans

L = 60


def brute(texts, length=L):
    """Covered runs by comparing every window of every record."""
    seen = {}
    for d, t in texts.items():
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], set()).add(d)
    out = set()
    for d, t in texts.items():
        mark = [False] * len(t)
        for i in range(len(t) - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                mark[i : i + length] = [True] * length
        i = 0
        while i < len(t):
            j = i
            while j < len(t) and mark[j]:
                j += 1
            if j > i:
                out.add((d, i, j))
            i = max(j, i + 1)
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(string.ascii_lowercase + "  ğ🙂") for _ in range(k))
    blocks = [word(r.randint(40, 200)) for _ in range(8)] + ["ab" * 60, "x" * 90]
    texts = {}
    for d in range(n):
        t = word(r.randint(0, 80))
        for _ in range(r.randint(0, 4)):
            b = r.choice(blocks)
            a = r.randint(0, len(b) // 2)
            t += b[a : a + r.randint(30, 200)] + word(r.randint(0, 30))
        texts[d] = t
    texts[n] = texts[0]
    texts[n + 1] = ""
    return texts


def run(spark, texts, **kw):
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()] + [(None, None, 2)], "doc_id long, text string, m int")
    return {tuple(r) for r in shared_spans(df, length=L, gram=16, buckets=4, **kw).select("doc_id", "start_pos", "end_pos").collect()}


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"batches": 1}), (3, {"group_limit": 1}), (4, {"batches": 4, "fan_in": 2}), (5, {"batches": 3, "group_limit": 1, "fan_in": 1})])
def test_equals_brute_force(spark, seed, kw):
    texts = corpus(seed)
    assert run(spark, texts, **kw) == brute(texts)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shared_spans(df, length=L, gram=16).count() == 0
    assert SpanIndex(spark).coverage().count() == 0


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 11, 12), (2, 0, 3), (2, 1, 2)], "doc_id long, start_pos int, end_pos int")
    assert {tuple(r) for r in merge_intervals(df).collect()} == {(1, 0, 9), (1, 11, 12), (2, 0, 3)}


def test_fraction(spark):
    t = "".join(random.Random(5).choice(string.ascii_lowercase) for _ in range(100))
    df = spark.createDataFrame([(1, t), (2, t + "zzzzzzzzzz" * 10), (3, ""), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["shared_fraction"] for r in shared_fraction(df, shared_spans(df, length=L, gram=16)).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0}


def test_blocks_elect_the_same_grams():
    codes = S.codes_of("".join(random.Random(7).choice("ab cd") for _ in range(3000)) + "a" * 500)
    one, two = S.contexts(codes, L, 16), S.contexts(codes, L, 16, block=37)
    assert all(np.array_equal(a, b) for a, b in zip(one, two))


def test_colliding_grams_are_verified(spark):
    """Contexts under one gram hash are compared on their text, in small and in large groups."""
    r = random.Random(9)
    word = lambda k: "".join(r.choice(string.ascii_lowercase) for _ in range(k))
    rows = [(d, word(L)) for d in range(30)]
    parts = pd.DataFrame([(7, d, d, d, 0, 3, True, t) for d, t in rows] + [(7, 77, 99, 99, 0, 3, True, rows[4][1])], columns=["m", "c", "lo", "hi", "n", "anchor", "large", "part"])
    index = SpanIndex(spark, length=L, gram=16)
    large = index._large(spark.createDataFrame(parts, S.PART))[0].select("c", "a", "b").collect()
    small = S.shared_windows(parts, L)
    assert sorted(map(tuple, large)) == sorted(zip(small["c"], small["a"], small["b"])) == [(4, 0, L), (77, 0, L)]


def test_a_batch_writes_no_history(spark):
    texts = corpus(11)
    index = SpanIndex(spark, length=L, gram=16, buckets=4, fan_in=9)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for i in range(3):
        index.add(df.where(f"doc_id % 3 = {i}"))
    per = {r["batch"]: r["n"] for r in index._read("places").groupBy("batch").count().withColumnRenamed("count", "n").collect()}
    fresh = {i: sum(len(S.contexts(S.codes_of(t), L, 16)[0]) for d, t in texts.items() if d % 3 == i and len(t) >= L) for i in range(3)}
    assert per == fresh
    assert {tuple(r) for r in index.coverage().select("doc_id", "start_pos", "end_pos").collect()} == brute(texts)
    index.compact()
    assert index._read("classes").count() >= index._read("places").select("m", "c").distinct().count()
