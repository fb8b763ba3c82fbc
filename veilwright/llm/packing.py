"""Filling fixed-capacity containers with items by exact-complement hashing.

Only the histogram of item lengths (at most ``capacity`` entries) reaches the driver. :func:`plan` turns it into
container patterns: for the longest lengths first it looks up which single length, pair or triple of lengths fills
the gap exactly and consumes as many such combinations as the counts allow; what is left is placed best fit,
longest first. Each pattern is applied to whole counts at once, so the plan's size depends on the capacity, not on
the number of items. Items get a rank among those of their length (hot lengths are spread over ``salts`` groups
whose offsets are summed) and are looked up in the plan.

Defined results: an item over the capacity is cut into full containers and a remainder, the only case of a split;
null and empty texts take no space and stand in container 0; repeated rows are items of their own; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwright.runtime import cut

ITEM = "doc_id long, piece_no int, token_start long, n_tokens long, container_id long, container_offset long"


def _exact(count: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Lengths whose sum is ``gap``: one, two or three of them, the longest first; None if there are none."""
    if gap <= 0 or gap >= len(count):
        return None
    if count[gap]:
        return (gap,)
    have = np.flatnonzero(count[: gap + 1])
    have = have[have > 0]
    other = gap - have
    ok = (have >= other) & (other > 0) & (count[other] > (have == other))
    if ok.any():
        a = int(have[ok][-1])
        return (a, gap - a)
    for a in have[::-1]:
        a = int(a)
        if 3 * a < gap:
            break
        rest = gap - a
        b = have[(have <= a) & (have < rest)]
        c = rest - b
        need_b = 1 + (b == a)
        need_c = 1 + (c == b) + (c == a)
        ok = (b >= c) & (c > 0) & (count[b] >= need_b) & (count[c] >= need_c)
        if ok.any():
            x = int(b[ok][-1])
            return (a, x, rest - x)
    return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths in a container, number of such containers)`` that hold every item once."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if 0 < length <= capacity:
            count[length] += n
    patterns: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while count[length]:
            count[length] -= 1
            rest = () if length == capacity else _exact(count, capacity - length)
            count[length] += 1
            if rest is None:
                break
            used: dict[int, int] = defaultdict(int)
            for x in (length, *rest):
                used[x] += 1
            times = min(int(count[x]) // k for x, k in used.items())
            for x, k in used.items():
                count[x] -= k * times
            patterns.append(((length, *rest), times))
    return patterns + _best_fit(count, capacity)


def _best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    gaps: dict[int, list[list]] = defaultdict(list)
    free = np.zeros(capacity + 1, dtype=np.int64)

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        gaps[gap].append([pattern, times])
        free[gap] += times

    for length in np.flatnonzero(count)[::-1]:
        length, n = int(length), int(count[length])
        while n:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                each = capacity // length
                if n // each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            gap = int(fits[0]) + length
            group = gaps[gap][-1]
            times = min(n, group[1])
            group[1] -= times
            if not group[1]:
                gaps[gap].pop()
            free[gap] -= times
            put((*group[0], length), times)
            n -= times
    return [(p, t) for groups in gaps.values() for p, t in groups]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Per length the ranges of ranks: ``(first slot of length, rank_from, container_from, offset)`` sorted by length and rank."""
    rows, container = [], 0
    taken: dict[int, int] = defaultdict(int)
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], container, offset))
            taken[length] += times
            offset += length
        container += times
    rows.sort()
    made = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return made[:, 0], made[:, 1], made[:, 2], made[:, 3]


def pack(sizes: DataFrame, capacity: int = 2048, salts: int = 64) -> DataFrame:
    """Assign every row of ``sizes(doc_id, n_tokens)`` to containers of ``capacity`` tokens."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.coalesce("n_tokens", F.lit(0)).cast("long")
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / capacity)).cast("int"))
    items = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), F.posexplode(pieces).alias("piece_no", "p"))
    start = F.col("p").cast("long") * capacity
    items = items.select("doc_id", "piece_no", start.alias("token_start"), F.least(F.lit(capacity), F.col("n") - start).cast("long").alias("n_tokens"))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))
    per = items.groupBy("n_tokens", "salt").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    per = cut(per.withColumn("before", F.coalesce(before, F.lit(0))), "pack-counts")  # at most (capacity + 1) * salts rows
    patterns = plan({r["n_tokens"]: r["c"] for r in per.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}, capacity)
    length, rank_from, container, offset = _slots(patterns)
    rank = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = items.join(F.broadcast(per.drop("c")), ["n_tokens", "salt"]).withColumn("rank", rank + F.col("before"))

    span = max(1, sum(t for _, t in patterns) * (capacity + 1))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = length * span + rank_from
        for pdf in batches:
            size = pdf["n_tokens"].to_numpy()
            at = np.searchsorted(key, size * span + pdf["rank"].to_numpy(), side="right") - 1
            real = size > 0
            at = np.where(real, at, 0)
            out = pdf[["doc_id", "piece_no", "token_start", "n_tokens"]].copy()
            if len(key):
                out["container_id"] = np.where(real, container[at] + pdf["rank"].to_numpy() - rank_from[at], 0)
                out["container_offset"] = np.where(real, offset[at], 0)
            else:
                out["container_id"] = 0
                out["container_offset"] = 0
            yield out

    return ranked.select("doc_id", "piece_no", "token_start", "n_tokens", "rank").mapInPandas(place, ITEM)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: items, containers, tokens, unused tokens and the fraction of space that is filled."""
    per = packed.where("n_tokens > 0").groupBy("container_id").agg(F.count("*").alias("i"), F.sum("n_tokens").alias("t"))
    out = per.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("items"), F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"))
    room = F.col("containers") * capacity
    return out.withColumn("unused", room - F.col("tokens")).withColumn("filled", F.when(room > 0, F.col("tokens") / room).otherwise(0.0))
