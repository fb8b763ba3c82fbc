"""Job, audit and correction rows, and the analytics over corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.functions import spans as S
from veilwright.operators.masking import ENGINE_VERSION

SOURCES = ("regex", "ner", "manual", "gazetteer")
EVENTS = ("false_positive", "false_negative", "relabel")


def source_counts(spans: Column) -> list[Column]:
    """Spans per detector."""
    def of(name: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["source"] == name)).alias(f"{name}_spans")

    return [of(n) for n in SOURCES]


def spans_summary(spans: Column, mapping: Column) -> Column:
    """Label, source, confidence and placeholder of each span, without its text. The placeholder is empty unless the
    span's text is the surface that the mapping keeps."""
    back = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(mapping), lambda e: F.struct(e["value"], e["key"]))))
    row = lambda s, b: F.struct(s["label"].alias("label"), s["source"].alias("source"), s["confidence"].alias("confidence"), F.coalesce(F.try_element_at(b, s["text"]), F.lit("")).alias("placeholder"))
    return S.let(back, lambda b: F.transform(spans, lambda s: row(s, b)))


def mask_rows(masked: DataFrame, job_id: str, now: Column, ttl_seconds: int = 86_400, mode: str | None = None, file_type: Column | None = None, methods: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Job rows and their audit rows for masked documents. ``char_count`` counts the masked text.

    ``methods`` is the array of extraction methods of a file: the row has its distinct values sorted, with commas.
    """
    spans = F.col("spans")
    no = F.lit(None).cast("string")
    how = [F.lit(mode).cast("string").alias("mode"), (no if file_type is None else file_type).alias("file_type"), (no if methods is None else F.array_join(F.array_sort(F.array_distinct(methods)), ",")).alias("extraction_methods")]
    jobs = masked.select(F.col(job_id).alias("job_id"), now.alias("created_at"), *how, F.size(spans).alias("span_count"), *source_counts(spans), F.length("masked_text").alias("char_count"), (now + F.make_interval(secs=F.lit(ttl_seconds))).alias("mapping_expires_at"), spans_summary(spans, F.col("mapping")).alias("spans_summary"), F.lit(ENGINE_VERSION).alias("engine_version"))
    return jobs, jobs.select("job_id", F.col("created_at").alias("occurred_at"), F.lit("mask").alias("event_type"), F.lit("success").alias("outcome"), F.to_json(F.struct("span_count", "char_count", "mode", "file_type", "extraction_methods")).alias("details"))


def unmask_rows(requests: DataFrame, now: Column) -> DataFrame:
    return requests.select("job_id", now.alias("occurred_at"), F.lit("unmask").alias("event_type"), F.lit("success").alias("outcome"), F.to_json(F.struct(F.size("mapping").alias("placeholder_count"))).alias("details"))


def error_rows(failures: DataFrame, now: Column) -> DataFrame:
    """Audit rows of failures; the message is cut to 500 characters."""
    return failures.select("job_id", now.alias("occurred_at"), F.lit("error").alias("event_type"), F.lit("failure").alias("outcome"), F.substring("error_message", 1, 500).alias("details"))


def correction_rows(raw: DataFrame) -> DataFrame:
    """Corrections with the text replaced by its SHA-256."""
    return raw.withColumn("text_hash", F.sha2(F.col("text"), 256)).drop("text")


def correction_sinks(raw: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What one correction writes: the hashed row, the raw row and the audit row, to be appended together."""
    audit = raw.select("job_id", now.alias("occurred_at"), F.lit("correction").alias("event_type"), F.lit("success").alias("outcome"), F.to_json(F.struct("entity_label", "detector_source")).alias("details"))
    return {"corrections": correction_rows(raw), "examples": raw, "audit_log": audit}


def false_positive_confidences(corrections: DataFrame) -> DataFrame:
    """``entity_label, source, confidence`` of false positives with a known confidence; no detector is ``any``."""
    rows = corrections.where("event_type = 'false_positive' and confidence is not null and not isnan(confidence)")
    return rows.select("entity_label", F.coalesce("detector_source", F.lit("any")).alias("source"), "confidence")


def once(corrections: DataFrame) -> DataFrame:
    return corrections.dropDuplicates(["correction_id"])


def counts(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("event_type", "entity_label", "detector_source").agg(F.count("*").alias("n"))


def pivot(corrections: DataFrame, by: str) -> DataFrame:
    """One column per kind of correction, zeros where there is none; null keys are left out."""
    per = [F.count_if(F.col("event_type") == e).alias(e) for e in EVENTS]
    return corrections.where(F.col(by).isNotNull()).groupBy(by).agg(*per, F.count("*").alias("total"))


def threshold_hints(corrections: DataFrame) -> DataFrame:
    """Confidence of false positives per label and source, with a threshold just above the 90th percentile.

    Order statistics are read off running counts per distinct confidence; no group is gathered into a row.
    """
    key = ["entity_label", "source"]
    steps = false_positive_confidences(corrections).groupBy(*key, F.col("confidence").alias("c")).agg(F.count("*").alias("k"))
    seen = F.sum("k").over(Window.partitionBy(*key).orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
    sizes = steps.groupBy(*key).agg(F.sum("k").alias("n"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    steps = steps.withColumn("seen", seen).alias("a").join(sizes.alias("b"), same[0] & same[1]).select("a.*", "n")

    def at(q: float) -> Column:
        rank = F.greatest(F.lit(0), F.floor(F.col("n") * q).cast("long") - 1)
        return F.min(F.when(F.col("seen") > rank, F.col("c")))

    out = steps.groupBy(*key).agg(F.max("n").alias("n"), F.min("c").alias("lowest"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("c").alias("highest"))
    return out.withColumn("suggested", F.round(F.col("p90") + 0.01, 4))


def repeated(corrections: DataFrame, least: int = 2, limit: int = 20) -> DataFrame:
    """The texts most often reported as false positives (a top-k report; ties by key)."""
    key = ["text_hash", "entity_label", "detector_source"]
    return corrections.where("event_type = 'false_positive'").groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), *key).limit(limit)


def recent(corrections: DataFrame, limit: int = 20) -> DataFrame:
    """The newest corrections (a top-k report; ties by id)."""
    return corrections.orderBy(F.desc("occurred_at"), "correction_id").limit(limit)


def training_export(examples: DataFrame, event_type: str | None = None, label: str | None = None, version: str | None = None, limit: int = 1000) -> DataFrame:
    """Newest examples behind up to three equality filters."""
    for name, value in (("event_type", event_type), ("entity_label", label), ("engine_version", version)):
        if value is not None:
            examples = examples.where(F.col(name) == value)
    return examples.orderBy(F.desc("occurred_at"), "correction_id").limit(limit)


def by_version(examples: DataFrame) -> DataFrame:
    """Counts per engine version, kind and label, over all examples whatever the export's filters."""
    return examples.groupBy("engine_version", "event_type", "entity_label").agg(F.count("*").alias("n"))


def span_table_counts(spans: DataFrame, key: str) -> DataFrame:
    """The per-job counts from a table with one row per span."""
    return spans.groupBy(key).agg(F.count("*").alias("span_count"), *[F.count_if(F.col("source") == s).alias(f"{s}_spans") for s in SOURCES])

