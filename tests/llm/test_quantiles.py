import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilwright.llm import quantiles as Q


def holds(s, data, e):
    data = np.sort(data)
    assert s["n"] == len(data)
    below, upto = np.searchsorted(data, s["v"], "left"), np.searchsorted(data, s["v"], "right")
    assert (s["below_lo"] <= below).all() and (below <= s["below_hi"]).all() and (s["upto_lo"] <= upto).all() and (upto <= s["upto_hi"]).all()
    for p in (0.001, *Q.PERCENTILES, 1.0):
        v, lo, hi = Q.query(s, p)
        r = max(1, int(np.ceil(p * len(data))))
        first, last = np.searchsorted(data, v, "left") + 1, np.searchsorted(data, v, "right")
        assert lo <= first and last <= hi
        assert max(0, first - r, r - last) <= e * len(data) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-30, 30), min_size=1, max_size=300), min_size=1, max_size=6), st.sampled_from([0.005, 0.02, 0.1]))
def test_merged_bounds_hold(parts, e):
    leaves = [Q.compress(Q.leaf(np.array(p, float)), Q.permitted(e, 0)) for p in parts]
    one = Q.compress(Q.merge(leaves[:3]), Q.permitted(e, 1))
    whole = Q.compress(Q.merge([one, *leaves[3:]]), Q.permitted(e, 2))
    data = np.concatenate([np.array(p, float) for p in parts])
    holds(whole, data, e)


def test_summary_stays_small():
    s = Q.compress(Q.leaf(np.random.default_rng(1).lognormal(size=200_000)), 0.0025)
    assert len(s["v"]) < 450 and Q.rank_error(s) <= 0.0025 * 200_000 + 1


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(2)
    rows = [("a", int(d), float(v), 0) for d, v in zip(r.integers(0, 9, 4000), r.lognormal(size=4000))] + [(None, 1, 0.5, 0)] * 30 + [("b", 2, 1.0, 0), ("b", 2, None, 0), ("b", 3, float("nan"), 0)]
    return rows, spark.createDataFrame(rows, "g string, day int, x double, n int").repartition(7)


def test_partitions_and_days_agree(spark, frame):
    rows, df = frame
    e = 0.01
    whole = {(r["g"], r["p"]): r for r in Q.percentiles(Q.summarise(df, ["g"], "x", e, fan_in=2, buffer=300), ["g"]).collect()}
    days = Q.summarise(df, ["g", "day"], "x", e, fan_in=4)
    combined = {(r["g"], r["p"]): r for r in Q.percentiles(Q.combine(days, ["g"], e, fan_in=4), ["g"]).collect()}
    a = np.sort([v for g, _, v, _ in rows if g == "a"])
    for got in (whole, combined):
        assert {k[0] for k in got} == {"a", "b", None}
        for p in Q.PERCENTILES:
            r, v = int(np.ceil(p * len(a))), got["a", p]["value"]
            assert abs(np.searchsorted(a, v, "right") - r) <= e * len(a) + 1
            assert got["a", p]["n"] == 4000 and got["a", p]["max_rank_error"] <= e + 1 / 4000
            assert got["b", p]["value"] == 1.0 and got[None, p]["value"] == 0.5 and got["b", p]["n"] == 1


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert Q.percentiles(Q.summarise(df, ["g"], "x"), ["g"]).count() == 0
