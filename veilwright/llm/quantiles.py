"""Percentiles of very large numeric columns from deterministic rank-interval summaries.

A summary keeps some values of a group and for each of them bounds on how many items are smaller
(``below_lo .. below_hi``) and how many are not larger (``upto_lo .. upto_hi``). Summaries of separate partitions
or days are merged by adding bounds, and compressed by the permitted uncertainty: neighbouring kept values ``i, j``
satisfy ``below_hi[j] + 1 - upto_lo[i] <= 2 e n + 1``, so any rank is met within ``e n``. The permitted ``e`` rises
with the level of the merge tree (1/2, 3/4, 7/8 ... of ``epsilon``) and never reaches ``epsilon``; the error that
really accumulated is read off the final summary and reported.

A partition keeps at most ``buffer`` values of all groups together before it summarises them, and about ``fan_in``
summaries of a group meet in one task: the depth of the tree follows the largest number of summaries that a group has.

Defined results: null, NaN and infinite values are not measured and do not count; a null group is a group; ties are
exact; an empty table gives no rows; a group of one value has that value everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.runtime import cut

PERCENTILES = (0.01, 0.1, 0.5, 0.9, 0.95, 0.99, 0.999)
_ARRAYS = ("v", "below_lo", "below_hi", "upto_lo", "upto_hi")
SUMMARY = "n long, v array<double>, below_lo array<long>, below_hi array<long>, upto_lo array<long>, upto_hi array<long>"


def permitted(epsilon: float, level: int) -> float:
    return epsilon * (1 - 0.5 ** (level + 1))


def leaf(values: np.ndarray) -> dict:
    """Exact summary of some values."""
    v, c = np.unique(values, return_counts=True)
    upto = np.cumsum(c).astype(np.int64)
    below = upto - c
    return {"n": int(len(values)), "v": v.astype(float), "below_lo": below, "below_hi": below, "upto_lo": upto, "upto_hi": upto}


def compress(s: dict, e: float) -> dict:
    """Drop values as long as every rank is still met within ``e * n``."""
    size, room = len(s["v"]), 2 * e * s["n"] + 1
    if size <= 2:
        return s
    keep, i = [0], 0
    high = np.maximum.accumulate(s["below_hi"])
    while i < size - 1:
        j = int(np.searchsorted(high, s["upto_lo"][i] + room - 1, side="right")) - 1
        i = min(size - 1, max(i + 1, j))
        keep.append(i)
    return {"n": s["n"], **{a: s[a][keep] for a in _ARRAYS}}


def _bounds(s: dict, v: np.ndarray) -> tuple[np.ndarray, ...]:
    size = len(s["v"])
    at = np.searchsorted(s["v"], v)
    here = (at < size) & (s["v"][np.minimum(at, size - 1)] == v)
    lower = np.where(at > 0, s["upto_lo"][np.maximum(at - 1, 0)], 0)
    upper = np.where(at < size, s["below_hi"][np.minimum(at, size - 1)], s["n"])
    own = np.minimum(at, size - 1)
    pick = lambda name, other: np.where(here, s[name][own], other)
    return pick("below_lo", lower), pick("below_hi", upper), pick("upto_lo", lower), pick("upto_hi", upper)


def merge(parts: list[dict]) -> dict:
    """Summary of the union of disjoint parts; bounds add up."""
    parts = [p for p in parts if p["n"]]
    v = np.unique(np.concatenate([p["v"] for p in parts])) if parts else np.array([])
    sums = [np.zeros(len(v), dtype=np.int64) for _ in range(4)]
    for p in parts:
        for total, x in zip(sums, _bounds(p, v)):
            total += x
    return {"n": sum(p["n"] for p in parts), "v": v, **dict(zip(_ARRAYS[1:], sums))}


def rank_error(s: dict) -> float:
    """Largest distance in ranks between a wanted rank and the nearest kept value."""
    gaps = s["below_hi"][1:] + 1 - s["upto_lo"][:-1]
    ends = (int(s["below_hi"][0]), s["n"] - int(s["upto_lo"][-1]))
    return max(float(max(gaps, default=0)) / 2, *map(float, ends), 0.0)


def query(s: dict, p: float) -> tuple[float, int, int]:
    """Value at ``p`` with the interval of ranks it may have."""
    r = min(s["n"], max(1, int(np.ceil(p * s["n"]))))
    miss = np.maximum(0, np.maximum(s["below_hi"] + 1 - r, r - s["upto_lo"]))
    i = int(np.argmin(miss))
    return float(s["v"][i]), int(s["below_lo"][i]) + 1, int(s["upto_hi"][i])


def _row(s: dict) -> tuple:
    return (s["n"], *(s[a].tolist() for a in _ARRAYS))


def _of(r) -> dict:
    return {"n": int(r["n"]), "v": np.asarray(r["v"], dtype=float), **{a: np.asarray(r[a], dtype=np.int64) for a in _ARRAYS[1:]}}


def summarise(df: DataFrame, groups: list[str], value: str, epsilon: float = 0.0005, fan_in: int = 64, buffer: int = 1_000_000) -> DataFrame:
    """One summary per group: ``groups``, ``level`` and the columns of :data:`SUMMARY`."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    head = ", ".join(f"`{g}` {kinds[g]}" for g in groups)
    data = df.select(*groups, F.col(value).cast("double").alias("_v"))
    data = data.where("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    cols = [*groups, "n", *_ARRAYS]

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        size = 0

        def flushed() -> pd.DataFrame:
            rows = [(*key, *_row(compress(leaf(np.concatenate(v)), permitted(epsilon, 0)))) for key, v in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=cols)

        for pdf in batches:
            for key, g in pdf.groupby(groups, dropna=False, sort=False):
                held.setdefault(tuple(None if pd.isna(k) else k for k in key), []).append(g["_v"].to_numpy())
            size += len(pdf)
            if size >= buffer:
                yield flushed()
                size = 0
        if held:
            yield flushed()

    out = cut(data.mapInPandas(leaves, f"{head}, {SUMMARY}"), "leaf-summaries").withColumn("level", F.lit(0))
    return combine(out, groups, epsilon, fan_in)


def _merged(df: DataFrame, keys: list[str], schema: str, e: float) -> DataFrame:
    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = compress(merge([_of(r) for r in pdf.to_dict("records")]), e)
        return pd.DataFrame([(*(None if pd.isna(k) else k for k in key), *_row(s))], columns=[*keys, "n", *_ARRAYS])

    return df.groupBy(*keys).applyInPandas(join, schema)


def combine(summaries: DataFrame, groups: list[str], epsilon: float = 0.0005, fan_in: int = 64) -> DataFrame:
    """Merge finished summaries (of partitions or days, say) into one per ``groups``, about ``fan_in`` at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in summaries.schema}
    head = ", ".join(f"`{g}` {kinds[g]}" for g in groups)
    most = summaries.groupBy(*groups).agg(F.max("level").alias("l"), F.count("*").alias("n")).agg(F.max("l").alias("l"), F.max("n").alias("n")).first()
    level, buckets = most["l"] or 0, max(1, -(-(most["n"] or 0) * 2 // fan_in)) if (most["n"] or 0) > fan_in else 1
    spread = F.xxhash64(*[c for c in summaries.columns if c != "level"])  # summaries that are equal may meet
    out = summaries.withColumn("_part", F.pmod(spread, F.lit(buckets)))
    while True:
        level += 1
        out = _merged(out.select(*groups, "_part", "n", *_ARRAYS), [*groups, "_part"], f"{head}, _part long, {SUMMARY}", permitted(epsilon, level))
        if buckets == 1:
            return out.drop("_part").withColumn("level", F.lit(level))
        out = out.withColumn("_part", F.floor(F.col("_part") / fan_in).cast("long"))
        buckets = -(-buckets // fan_in)


def percentiles(summaries: DataFrame, groups: list[str], ps: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """One row per group and percentile with the bounds on its rank and the error that accumulated."""
    kinds = {f.name: f.dataType.simpleString() for f in summaries.schema}
    head = ", ".join(f"`{g}` {kinds[g]}" for g in groups)
    cols = [*groups, "p", "n", "value", "rank_lo", "rank_hi", "max_rank_error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                s = _of(r)
                key = tuple(None if pd.isna(r[g]) else r[g] for g in groups)
                rows += [(*key, p, s["n"], *query(s, p), rank_error(s) / s["n"]) for p in ps]
            if rows:
                yield pd.DataFrame(rows, columns=cols)

    return summaries.select(*groups, "n", *_ARRAYS).mapInPandas(run, f"{head}, p double, n long, value double, rank_lo long, rank_hi long, max_rank_error double")
