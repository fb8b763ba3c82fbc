"""Mixing sources to target weights by Pfair scheduling.

The output is a sequence of slots of one block each. Block ``j`` of a source with weight ``w`` is released at slot
``floor(j / w)`` and due at slot ``ceil((j + 1) / w)``; earliest deadline first takes one released block per slot.
As the weights sum to one, every source stays within one block of its share at every point of the sequence. The
schedule has at most ``max_blocks`` entries whatever the size of the data, as the block grows with the total.

Records stand in hashed order; their position in tokens is a prefix sum over hash buckets, so that a source with a
third of all rows is spread over as many tasks as it has buckets. A source that is too small is gone through again,
at most ``max_repeats`` times.

Defined results: sources without a target (null too) get no share; weights are scaled to sum to one; null or empty
texts are never selected; two different targets for one source, or more than ``max_sources``, are an error; an
empty selection has the report's rows with zero shares; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwright.runtime import empty

SELECTION = "slot long, source string, doc_id long, repeat_no int, n_tokens long, source_position long"
REPORT = "source string, target_share double, max_repeats int, available_tokens long, wanted_tokens long, selected_tokens long, uses long, records long, actual_share double, fell_short boolean"


def schedule(weights: list[float], slots: int) -> list[tuple[int, int]]:
    """``(source, block)`` of each slot: earliest deadline first over the released blocks."""
    ready: list[tuple[int, float, int, int]] = []
    waiting = [(0, s, 0) for s, w in enumerate(weights) if w > 0]
    heapq.heapify(waiting)
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((j + 1) / weights[s] - 1e-9), -weights[s], s, j))
        if not ready:
            continue
        _, _, s, j = heapq.heappop(ready)
        out.append((s, j))
        heapq.heappush(waiting, (math.floor((j + 1) / weights[s] + 1e-9), s, j + 1))
    return out


def _targets(targets: DataFrame, max_sources: int) -> list:
    rows = targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0").distinct().orderBy("source").limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if len({r["source"] for r in rows}) < len(rows):
        raise ValueError("a source has two different targets")
    return rows


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, max_blocks: int = 20_000, bucket_rows: int = 50_000, max_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Selection and report for ``sizes(doc_id, source, n_tokens)``.

    Without ``total_tokens`` the total is the largest one at which every source reaches its share within its
    repeats; with it, sources may fall short.
    """
    spark = sizes.sparkSession
    goals = _targets(targets, max_sources)
    whole = sum(r["target_share"] for r in goals)
    items = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0")
    items = items.join(F.broadcast(spark.createDataFrame([(r["source"],) for r in goals], "source string")), "source")
    stats = {r["source"]: r for r in items.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("n_tokens").alias("m")).collect()}
    have = [stats[r["source"]]["t"] if r["source"] in stats else 0 for r in goals]
    weight = [r["target_share"] / whole for r in goals]
    repeats = [max(1, r["max_repeats"] if r["max_repeats"] is not None else 1) for r in goals]
    if total_tokens is None:
        total_tokens = min((int(h * k / w) for h, k, w in zip(have, repeats, weight) if h), default=0)
    wanted = [round(w * total_tokens) for w in weight]
    quota = [min(q, h * k) for q, h, k in zip(wanted, have, repeats)]

    if not stats or not total_tokens:
        selection = empty(spark, SELECTION)
    else:
        block = max(math.ceil(total_tokens / max_blocks), max(r["m"] for r in stats.values()))
        slots = math.ceil(total_tokens / block)
        blocks = schedule(weight, slots + len(goals))
        slot_rows = [(goals[s]["source"], j, i) for i, (s, j) in enumerate(blocks)]
        plan = spark.createDataFrame(slot_rows, "source string, block long, slot long")  # at most max_blocks + sources rows
        limits = spark.createDataFrame([(g["source"], h, q) for g, h, q in zip(goals, have, quota)], "source string, have long, quota long")
        buckets = max(16, math.ceil(max(r["n"] for r in stats.values()) / bucket_rows))
        items = items.withColumn("h", F.xxhash64("doc_id", F.lit("mix"))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
        per = items.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("bt"))
        ahead = F.sum("bt").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        per = per.select("source", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
        inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
        placed = items.withColumn("inside", F.coalesce(inside, F.lit(0))).join(per, ["source", "bucket"]).join(F.broadcast(limits), "source")
        rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("quota") / F.col("have")).cast("int") - 1))
        placed = placed.select("source", "doc_id", "n_tokens", "quota", (F.col("ahead") + F.col("inside")).alias("at"), "have", F.explode(rounds).alias("repeat_no"))
        placed = placed.withColumn("source_position", F.col("at") + F.col("repeat_no") * F.col("have")).where("source_position < quota")
        placed = placed.withColumn("block", F.floor(F.col("source_position") / block))
        selection = placed.join(F.broadcast(plan), ["source", "block"], "left").select(F.coalesce("slot", F.lit(slots + len(goals))).alias("slot"), "source", "doc_id", "repeat_no", "n_tokens", F.col("source_position").cast("long").alias("source_position"))

    goal_rows = [(g["source"], g["target_share"], k, h, q) for g, k, h, q in zip(goals, repeats, have, wanted)]
    base = spark.createDataFrame(goal_rows, "source string, target_share double, max_repeats int, available_tokens long, wanted_tokens long")
    got = selection.groupBy("source").agg(F.sum("n_tokens").alias("selected_tokens"), F.count("*").alias("uses"), F.sum((F.col("repeat_no") == 0).cast("long")).alias("records"))
    report = base.join(got, "source", "left").fillna(0, ["selected_tokens", "uses", "records"])
    all_tokens = F.sum("selected_tokens").over(Window.partitionBy())  # one row per target
    report = report.withColumn("actual_share", F.when(all_tokens > 0, F.col("selected_tokens") / all_tokens).otherwise(0.0)).withColumn("fell_short", F.col("selected_tokens") < F.col("wanted_tokens"))
    return selection, report
