"""Queries of problems 2 to 10 and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import lookalike, mixing, names, ocr, packing, pii, quantiles, shared_spans, splitting, tokens
from veilwright.runtime import cut, spread, table


# -- 2: personal data

#: Key of the surrogates of the registered queries. Applications pass their own secret.
DEMO_SECRET = "demonstration"


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "mask_calls").select(F.lit("mask_calls").alias("src_table"), F.col("call_id").cast("string").alias("record_id"), F.col("original_text").alias("text"))
    gold = table(spark, sf_dir, "gold_docs").select(F.lit("gold_docs").alias("src_table"), F.col("doc_id").alias("record_id"), "text")
    return calls.unionByName(gold).where("text is not null")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = spread(_personal(spark, sf_dir), "src_table", "record_id").dropDuplicates(["src_table", "record_id"])
    replaced = pii.replace_table(once, ["src_table", "record_id"], "text", DEMO_SECRET, pii.fit_names(once, "text"))
    return replaced.select("src_table", "record_id", "pii_type", "start_pos", "end_pos")


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = spread(_personal(spark, sf_dir), "src_table", "record_id").dropDuplicates(["src_table", "record_id"])
    return pii.mask_table(once, ["src_table", "record_id"], "text", DEMO_SECRET, pii.fit_names(once, "text"))


# -- 3: variant spellings of names


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entities(table(spark, sf_dir, "spans"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs(cut(p3_entities(spark, sf_dir), "entities"))


# -- 4: percentiles


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured values of both tables, each record once: ``src_table, grp, day, value``."""
    corr = table(spark, sf_dir, "corrections").select(F.lit("corrections").alias("src_table"), "correction_id", F.lower(F.trim("detector_source")).alias("grp"), F.to_date("occurred_at").alias("day"), F.col("confidence").alias("value"))
    corr = corr.dropDuplicates(["correction_id"]).drop("correction_id")
    mode = table(spark, sf_dir, "mode_results").select(F.lit("mode_results").alias("src_table"), "run_id", F.lower(F.trim("mode")).alias("grp"), F.to_date("run_at").alias("day"), F.when(F.col("processing_time_ms") >= 0, F.col("processing_time_ms")).alias("value"))
    mode = mode.dropDuplicates(["run_id", "grp"]).drop("run_id")
    return corr.unionByName(mode)


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["src_table", "grp"]
    return quantiles.percentiles(quantiles.summarise(_measured(spark, sf_dir), groups, "value"), groups)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(quantiles.summarise(_measured(spark, sf_dir), ["src_table", "grp", "day"], "value"), "daily-summaries")


def p4_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(_daily(spark, sf_dir), ["src_table", "grp", "day"])


def p4_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["src_table", "grp"]
    return quantiles.percentiles(quantiles.combine(_daily(spark, sf_dir), groups), groups)


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.combine(_daily(spark, sf_dir), ["src_table", "grp"]).select("src_table", "grp", "n")


def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact rank of each reported value, direct and by days, is within the stated bounds and error."""
    data = _measured(spark, sf_dir).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    data = cut(data.groupBy("src_table", "grp", "value").agg(F.count("*").alias("k")), "measured-counts")
    ways = p4_percentiles(spark, sf_dir).withColumn("way", F.lit("whole")).unionByName(p4_combined(spark, sf_dir).withColumn("way", F.lit("days")))
    v, d = ways.alias("v"), data.alias("d")
    met = v.join(d, (F.col("v.src_table") == F.col("d.src_table")) & F.col("v.grp").eqNullSafe(F.col("d.grp")))
    below, upto = F.sum(F.when(F.col("d.value") < F.col("v.value"), F.col("k")).otherwise(0)), F.sum(F.when(F.col("d.value") <= F.col("v.value"), F.col("k")).otherwise(0))
    exact = met.groupBy("v.src_table", "v.grp", "way", "p", "n", "rank_lo", "rank_hi", "max_rank_error").agg(below.alias("below"), upto.alias("upto"), F.sum("k").alias("items"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("items")))
    miss = F.greatest(F.lit(0), F.col("below") + 1 - rank, rank - F.col("upto"))
    bounded = (F.col("rank_lo") <= F.col("below") + 1) & (F.col("rank_hi") >= F.col("upto"))
    within = (miss <= 0.0005 * F.col("items") + 0.5) & (miss <= F.col("max_rank_error") * F.col("items"))
    return exact.select("src_table", "grp", "way", "p", "items", (bounded & within & (F.col("n") == F.col("items"))).alias("holds"))


_P4_COUNTS = """
SELECT 'corrections' AS src_table, lower(trim(detector_source)) AS grp, count(DISTINCT correction_id) AS n
FROM corrections WHERE confidence IS NOT NULL AND isfinite(confidence) GROUP BY 1, 2
UNION ALL
SELECT 'mode_results', lower(trim(mode)), count(DISTINCT run_id)
FROM mode_results WHERE processing_time_ms >= 0 AND isfinite(processing_time_ms) GROUP BY 1, 2"""


_P4_BOUNDS = f"""WITH c AS ({_P4_COUNTS})
SELECT src_table, grp, way, p, n AS items, true AS holds
FROM c, (VALUES ('whole'), ('days')) w(way), (VALUES (0.01::DOUBLE), (0.1), (0.5), (0.9), (0.95), (0.99), (0.999)) q(p)"""


# -- 5: texts that look the same


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' texts with their consistent form under one model learned from all of them."""
    spans = table(spark, sf_dir, "spans").select(F.lit("spans").alias("src_table"), F.col("span_id").alias("id"), "job_id", "label", "text")
    calls = table(spark, sf_dir, "mask_calls").select(F.lit("mask_calls").alias("src_table"), F.col("call_id").alias("id"), F.lit(None).cast("string").alias("job_id"), F.lit(None).cast("string").alias("label"), "text")
    rows = spans.unionByName(calls).where("text is not null")
    model = lookalike.learn(rows)
    return rows.withColumn("canonical", lookalike.canonical_udf(model)("text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(_canonical(spark, sf_dir).select("src_table", "id", "job_id", "label", F.md5("text").alias("text"), F.md5("canonical").alias("canonical")), "canonical-digests")
    spans = lookalike.same_look(rows.where("src_table = 'spans'"), "id", ["job_id", "label"])
    calls = lookalike.same_look(rows.where("src_table = 'mask_calls'"), "id", [])
    return spans.select(F.lit("spans").alias("src_table"), "id_a", "id_b").unionByName(calls.select(F.lit("mask_calls").alias("src_table"), "id_a", "id_b"))


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).select("src_table", "id", "canonical").distinct()


# -- 6: oversized texts


def _long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "mask_calls").select(F.lit("mask_calls").alias("src_table"), F.col("call_id").alias("record_id"), "text")
    files = table(spark, sf_dir, "document_results").select(F.lit("document_results").alias("src_table"), F.col("file_id").alias("record_id"), F.col("full_text").alias("text"))
    return calls.unionByName(files).where("length(text) > 2000")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_table(_long_texts(spark, sf_dir), ["src_table", "record_id"], "text")
    return pieces.where("piece_no > 0").select("src_table", "record_id").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = _long_texts(spark, sf_dir).dropDuplicates(["src_table", "record_id"])
    return splitting.split_table(once, ["src_table", "record_id"], "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each long text put together again from its pieces, with the checks that SQL can make on the original."""
    pieces = p6_pieces(spark, sf_dir)
    rest = F.struct("piece_no", F.expr("substring(piece, overlap + 1)").alias("t"))
    per = pieces.groupBy("src_table", "record_id").agg(F.array_sort(F.collect_list(rest)).alias("p"), F.max(F.length("piece")).alias("longest"), F.count("*").alias("k"), F.max("piece_no").alias("last"))
    return per.select("src_table", "record_id", F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("text_md5"), (F.col("longest") <= 2000).alias("fits"), (F.col("k") == F.col("last") + 1).alias("numbered"))


_P6_ROUND_TRIP = """
SELECT DISTINCT 'mask_calls' AS src_table, call_id AS record_id, md5(text) AS text_md5, true AS fits, true AS numbered FROM mask_calls WHERE length(text) > 2000
UNION ALL
SELECT DISTINCT 'document_results', file_id, md5(full_text), true, true FROM document_results WHERE length(full_text) > 2000"""

_P6_FOUND = """
SELECT DISTINCT 'mask_calls' AS src_table, call_id AS record_id FROM mask_calls WHERE length(text) > 2000
UNION ALL
SELECT DISTINCT 'document_results', file_id FROM document_results WHERE length(full_text) > 2000"""


# -- 7: scanned pages


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.Repair(table(spark, sf_dir, "document_results")).found()


def p7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.Repair(table(spark, sf_dir, "document_results")).pages()


# -- 8: containers


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "token-counts")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_containers(spark, sf_dir))


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record: its tokens stand in containers once, in order and without gaps, split only if it is over the capacity."""
    sizes = _sizes(spark, sf_dir)
    per = packing.pack(sizes).groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"), F.sum(F.col("piece_no").cast("long") * 2048 - F.col("token_start")).alias("shift"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("upto"))
    out = sizes.groupBy("doc_id").agg(F.max("n_tokens").alias("t")).join(per, "doc_id", "left")
    whole = (F.col("placed") == F.col("t")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("t") / 2048))) & (F.col("shift") == 0)
    return out.select("doc_id", F.coalesce(whole & (F.col("upto") <= 2048), F.lit(False)).alias("holds"))


def p8_overfull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers that hold more than their capacity, and containers in which two items overlap."""
    per = p8_containers(spark, sf_dir).where("n_tokens > 0").groupBy("container_id")
    per = per.agg(F.sum("n_tokens").alias("t"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("upto"), F.countDistinct("container_offset").alias("starts"), F.count("*").alias("k"))
    return per.agg(F.count_if(F.col("t") > 2048).alias("overfull"), F.count_if((F.col("upto") != F.col("t")) | (F.col("starts") != F.col("k"))).alias("overlapping"))


# -- 9: mixing


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p9_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report for a total as large as all listed sources together, which small sources cannot follow."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    listed = sizes.join(targets.select("source").distinct(), "source", "left_semi").agg(F.sum("n_tokens")).first()[0]
    return mixing.mix(sizes, targets, total_tokens=listed)[1]


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: no record is used too often, and the share of tokens is within one percent of the whole of its target."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    selection, report = mixing.mix(sizes, targets)
    uses = selection.groupBy("source", "doc_id").agg(F.count("*").alias("k"), F.countDistinct("repeat_no").alias("r")).groupBy("source").agg(F.max("k").alias("most"), F.min((F.col("k") == F.col("r")).cast("int")).alias("apart"))
    whole = targets.agg(F.sum("target_share").alias("whole"))  # one row
    out = report.join(uses, "source", "left").crossJoin(F.broadcast(whole))
    rare = (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & (F.coalesce("apart", F.lit(1)) == 1)
    return out.select("source", rare.alias("within_repeats"), (F.abs(F.col("actual_share") - F.col("target_share") / F.col("whole")) <= 0.01).alias("near_target"))


_P9_LIMITS = "SELECT source, true AS within_repeats, true AS near_target FROM mix_targets WHERE source IS NOT NULL AND target_share > 0"


# -- 10: shared spans


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "documents"))


def p10_shared_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shared_spans.shared_fraction(docs, shared_spans.shared_spans(docs))


QUERIES = {
    "p2_found": p2_found,
    "p2_masked": p2_masked,
    "p3_found": p3_found,
    "p3_entities": p3_entities,
    "p4_percentiles": p4_percentiles,
    "p4_daily": p4_daily,
    "p4_combined": p4_combined,
    "p4_counts": p4_counts,
    "p4_bounds": p4_bounds,
    "p5_found": p5_found,
    "p5_canonical": p5_canonical,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_round_trip": p6_round_trip,
    "p7_found": p7_found,
    "p7_pages": p7_pages,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_placed": p8_placed,
    "p8_overfull": p8_overfull,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p9_shortfall": p9_shortfall,
    "p9_limits": p9_limits,
    "p10_found": p10_found,
    "p10_shared_fraction": p10_shared_fraction,
}
SQL: dict[str, str] = {
    "p4_counts": _P4_COUNTS,
    "p4_bounds": _P4_BOUNDS,
    "p6_found": _P6_FOUND,
    "p6_round_trip": _P6_ROUND_TRIP,
    "p8_placed": "SELECT DISTINCT doc_id, true AS holds FROM documents",
    "p8_overfull": "SELECT CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS overlapping",
    "p9_limits": _P9_LIMITS,
}
