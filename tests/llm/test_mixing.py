import random
from collections import Counter, defaultdict

import pytest

from veilwright.llm.mixing import mix, schedule


@pytest.mark.parametrize("weights", [[0.3, 0.2, 0.15, 0.2, 0.1, 0.05], [1.0], [0.5, 0.5], [0.7, 0.2, 0.1], [1 / 3, 1 / 3, 1 / 3]])
def test_every_prefix_is_within_one_block(weights):
    count = Counter()
    for t, (s, j) in enumerate(schedule(weights, 500), 1):
        assert j == count[s]
        count[s] += 1
        for k, w in enumerate(weights):
            assert abs(count[k] - w * t) < 1 + 1e-6
    assert sum(count.values()) == 500


SIZES = "doc_id long, source string, n_tokens long, slot string"
TARGETS = "source string, target_share double, max_repeats int, note string"


def data(spark):
    r = random.Random(1)
    rows = [(i, "big", r.randint(1, 40), "") for i in range(3000)] + [(10000 + i, "small", r.randint(1, 40), "") for i in range(100)] + [(20000 + i, None, 5, "") for i in range(5)] + [(30000, "other", 9, ""), (30001, "small", 0, ""), (30002, "small", None, "")]
    return rows, spark.createDataFrame(rows, SIZES)


def test_shares(spark):
    rows, df = data(spark)
    targets = spark.createDataFrame([("big", 0.75, 1, ""), ("small", 0.25, 3, ""), ("small", 0.25, 3, "dup")], TARGETS)
    sel, report = mix(df, targets, max_blocks=50, bucket_rows=40)
    sel = sel.collect()
    uses = Counter((s["source"], s["doc_id"]) for s in sel)
    assert max(v for (s, _), v in uses.items() if s == "small") == 3 and max(v for (s, _), v in uses.items() if s == "big") == 1
    rep = {r["source"]: r for r in report.collect()}
    assert abs(rep["big"]["actual_share"] - 0.75) < 0.01 and not rep["big"]["fell_short"]
    have = sum(n or 0 for _, s, n, _ in rows if s == "small")
    assert rep["small"]["selected_tokens"] == 3 * have
    place = defaultdict(list)
    for s in sel:
        place[s["source"]].append((s["source_position"], s["n_tokens"], s["slot"]))
    for p in place.values():
        p.sort()
        assert p[0][0] == 0 and all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(p, p[1:]))


def test_falls_short(spark):
    _, df = data(spark)
    targets = spark.createDataFrame([("big", 3.0, 1, ""), ("small", 1.0, 1, ""), ("absent", 1.0, 2, "")], TARGETS)
    rep = {r["source"]: r for r in mix(df, targets, total_tokens=20_000)[1].collect()}
    assert rep["small"]["fell_short"] and rep["absent"]["fell_short"] and not rep["big"]["fell_short"] and rep["absent"]["selected_tokens"] == 0


def test_empty_and_bad(spark):
    none = spark.createDataFrame([], SIZES)
    targets = spark.createDataFrame([("big", 1.0, None, "")], TARGETS)
    sel, rep = mix(none, targets)
    assert sel.count() == 0 and rep.first()["actual_share"] == 0.0
    with pytest.raises(ValueError):
        mix(none, spark.createDataFrame([("a", 1.0, 1, ""), ("a", 0.5, 1, "")], TARGETS))
