"""Queries of the audit, correction, scoring, extraction and store operators over their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions import presentation as P
from veilwright.functions import spans as S
from veilwright.functions import wordlists as W
from veilwright.functions.registry import DOMINANT
from veilwright.operators import audit, detect, evaluate, gazetteer, masking, policy, training
from veilwright.runtime import table
from veilwright.sources import extract, store


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.once(table(spark, sf_dir, "corrections"))
    return rows.withColumn("detector_source", F.lower(F.trim("detector_source")))


_CORR = "WITH c AS (SELECT DISTINCT correction_id, occurred_at, event_type, lower(trim(detector_source)) AS detector_source, entity_label, confidence, text_hash FROM corrections)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "spans").dropDuplicates(["span_id"])
    return rows.select("span_id", F.col("job_id").alias("doc_id"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "label", "source", "confidence", "text")


_SPANS = 'WITH s AS (SELECT DISTINCT span_id, job_id AS doc_id, start_pos AS "start", end_pos AS "end", label, source, confidence, text FROM spans)'


def _shifted(df: DataFrame) -> DataFrame:
    """A prediction made of the spans: a third moved by one, every seventh left out."""
    moved = df.where("span_id % 7 != 0").withColumn("d", (F.col("span_id") % 3 == 0).cast("int"))
    return moved.withColumn("start", F.col("start") + F.col("d")).withColumn("end", F.col("end") + F.col("d")).drop("d")


_PRED = '(SELECT span_id, doc_id, "start" + CASE WHEN span_id % 3 = 0 THEN 1 ELSE 0 END AS "start", "end" + CASE WHEN span_id % 3 = 0 THEN 1 ELSE 0 END AS "end", label FROM s WHERE span_id % 7 != 0)'


def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.span_table_counts(_spans(spark, sf_dir), "doc_id")


def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counts(_corrections(spark, sf_dir))


def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pivot(_corrections(spark, sf_dir), "entity_label")


def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pivot(_corrections(spark, sf_dir), "detector_source")


def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.threshold_hints(_corrections(spark, sf_dir))


def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repeated(_corrections(spark, sf_dir))


def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.recent(_corrections(spark, sf_dir)).select("correction_id", "event_type", "entity_label", "detector_source")


def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.training_export(_corrections(spark, sf_dir).withColumn("engine_version", F.lit(masking.ENGINE_VERSION)), event_type="relabel", label="Person").select("correction_id", "detector_source")


def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_version(_corrections(spark, sf_dir).withColumn("engine_version", F.lit(masking.ENGINE_VERSION)))


def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.correction_rows(_spans(spark, sf_dir).where("text is not null")).select("span_id", "text_hash")


def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "document_results").where("error_message is not null").select("job_id", "error_message").distinct()
    return audit.error_rows(failed, F.lit("2026-01-01").cast("timestamp")).select("job_id", "event_type", "details")


def b03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    classes = evaluate.overlap_classes(rows, rows.where("source = 'regex'"), rows.where("source = 'ner'"))
    return classes.groupBy("label", "class").agg(F.count("*").alias("n"))


def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    return evaluate.strict(rows, _shifted(rows))


def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).withColumn("seq", F.col("span_id"))
    return evaluate.relaxed(rows, _shifted(rows))


def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    return evaluate.characters(rows, _shifted(rows))


def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rates(e02(spark, sf_dir)).select("label", "tp", "fp", "fn", "support", F.round("f1", 6).alias("f1"))


def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.micro(e02(spark, sf_dir)).select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def e06_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro(e02(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leak(e04(spark, sf_dir)).select("gold_chars", "shared_chars", F.round("leak", 6).alias("leak"))


def e09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    return evaluate.errors(rows, _shifted(rows))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_results").dropDuplicates(["file_id"])


def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("pages is not null").select("file_id", F.md5(extract.full_text(F.col("pages"))).alias("text_md5"))


def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("pages is not null").select("file_id", F.posexplode(extract.page_breaks(F.col("pages"))).alias("page", "start"))


def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.col("pages")
    return _documents(spark, sf_dir).where("pages is not null").select("file_id", F.array_join(extract.methods(pages), ",").alias("methods"), extract.has_ocr(pages).alias("has_ocr"))


def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir)
    return rows.select("file_id", extract.status(F.octet_length(F.coalesce("full_text", F.lit(""))), F.col("error_message"), F.col("full_text")).alias("status"))


def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).groupBy(extract.file_kind(F.col("filename")).alias("kind")).agg(F.count("*").alias("n"))


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping row per distinct surface of a job: numbered per label by first place, until a day after the job."""
    spans = _spans(spark, sf_dir).where("text is not null").withColumnRenamed("doc_id", "job_id")
    from pyspark.sql import Window

    first = spans.groupBy("job_id", "label", "text").agg(F.min(F.struct("start", "span_id")).alias("at"))
    number = F.row_number().over(Window.partitionBy("job_id", "label").orderBy("at"))
    jobs = table(spark, sf_dir, "jobs").groupBy("job_id").agg(F.max("mapping_expires_at").alias("expires_at"))
    rows = first.select("job_id", F.concat(F.lit("{"), "label", F.lit("_"), number.cast("string"), F.lit("}")).alias("placeholder"), F.col("text").alias("original"))
    return rows.join(jobs, "job_id", "left")


_MAPPING = f"""{_SPANS}, f AS (SELECT doc_id AS job_id, label, text, min(("start", span_id)) AS spot FROM s WHERE text IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT job_id, max(mapping_expires_at) AS expires_at FROM jobs GROUP BY 1),
m AS (SELECT f.job_id, '{{' || label || '_' || row_number() OVER (PARTITION BY f.job_id, label ORDER BY spot) || '}}' AS placeholder, text AS original, expires_at FROM f LEFT JOIN j ON f.job_id = j.job_id)"""
_NOW = "2026-01-01 00:00:00"


def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapping(spark, sf_dir).select("job_id", "placeholder", "original")


def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp")
    return store.as_maps(store.alive(_mapping(spark, sf_dir), now)).select("job_id", F.size("mapping").alias("n"))


def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp")
    return store.remaining(table(spark, sf_dir, "jobs").select("job_id").distinct(), _mapping(spark, sf_dir), now)


def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restore a text per job that names its first placeholders; jobs without a living mapping are missing."""
    ask = table(spark, sf_dir, "jobs").select("job_id").distinct().withColumn("masked_text", F.lit("a {Person_1} b {Company_1} c {Person_1000000}"))
    return store.restore(ask, _mapping(spark, sf_dir), F.lit(_NOW).cast("timestamp")).select("job_id", "text", "status")


# -- overlap resolution over the spans of each job


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per job with its spans by detector, each list in order of span_id."""
    rows = _spans(spark, sf_dir)
    span = S.span(F.struct("start", "end", "text"), F.col("label"), "x", F.col("confidence")).withField("source", F.col("source"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("span_id", span.alias("s")))), lambda x: x["s"])
    out = rows.groupBy("doc_id").agg(listed.cast(S.SPANS).alias("all"))
    of = lambda n: F.filter("all", lambda s: s["source"] == n).alias(n)
    return out.select("doc_id", *map(of, audit.SOURCES))


def _resolved(df: DataFrame, spans) -> DataFrame:
    return df.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.start", "s.end", "s.label", "s.source", "s.confidence")


def _merged():
    return detect.merge(F.col("regex"), F.col("ner"), F.col("gazetteer"))


def m01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(_pools(spark, sf_dir), detect.without_overlaps(F.col("regex")))


def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(_pools(spark, sf_dir), _merged())


def m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(_pools(spark, sf_dir), detect.merge_manual(_merged(), F.col("manual")))


def m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(_pools(spark, sf_dir), detect.single(F.col("ner")))


def m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).where("text is not null and label is not null")
    return rows.select("span_id", S.canonical_id(F.col("label"), F.col("text")).alias("canonical_id"))


def m03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).groupBy("label").agg(F.max(F.col("label").isin(DOMINANT)).alias("dominant"))


def n21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).where("text is not null").select("text").distinct()
    return rows.select("text", S.fold_ascii(F.col("text")).alias("folded"), S.fold_tr(F.col("text")).alias("folded_tr"), gazetteer.is_institution(F.col("text")).alias("institution"))


def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("span_id", P.band(F.col("confidence")).alias("band"))


def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = _pools(spark, sf_dir)
    return _resolved(pools, P.chosen(F.concat("regex", "ner"), ["Person", "Email"], ["regex", "ner"]))


def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pools(spark, sf_dir).select("doc_id", F.array_join(P.distinct_sorted(F.concat("regex", "ner"), "label"), ",").alias("labels"))


def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary rows of each job's spans under a mapping of its Person texts."""
    pools = _pools(spark, sf_dir).withColumn("spans", F.concat("regex", "ner"))
    person = F.array_distinct(F.transform(F.filter("spans", lambda s: (s["label"] == "Person") & s["text"].isNotNull()), lambda s: s["text"]))
    known = F.map_from_entries(F.transform(person, lambda t: F.struct(F.concat(F.lit("{P:"), t, F.lit("}")), t)))
    return pools.select("doc_id", F.explode(audit.spans_summary(F.filter("spans", lambda s: s["text"].isNotNull()), known)).alias("s")).select("doc_id", "s.label", "s.source", "s.confidence", "s.placeholder")


def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rows of uploads: methods sorted, counts by detector, expiry a day later."""
    files = _documents(spark, sf_dir).groupBy("job_id").agg(F.flatten(F.collect_list(F.transform("pages", lambda p: p["extract_method"]))).alias("methods"))
    rows = _pools(spark, sf_dir).withColumnRenamed("doc_id", "job_id").join(files, "job_id")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    masked = rows.select("job_id", "methods", F.concat("regex", "ner", "manual", "gazetteer").alias("spans"), F.lit("abc").alias("masked_text"), none.alias("mapping"))
    jobs, log = audit.mask_rows(masked, "job_id", F.lit(_NOW).cast("timestamp"), 86_400, "full", F.lit("pdf"), F.col("methods"))
    return jobs.join(log.select("job_id", "event_type", "outcome"), "job_id").select("job_id", "mode", "file_type", "extraction_methods", "span_count", "regex_spans", "ner_spans", "manual_spans", "gazetteer_spans", "char_count", "mapping_expires_at", "event_type", "outcome")


def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.false_positive_confidences(_corrections(spark, sf_dir)).groupBy("entity_label", "source", "confidence").agg(F.count("*").alias("n"))


def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading a table that is not there gives its columns and no rows, so a report over it is empty instead of failing."""
    broken = store.read_or_empty(spark, f"{sf_dir}/no_such_table.parquet", "correction_id string, event_type string, entity_label string, detector_source string")
    return _corrections(spark, sf_dir).select("event_type").groupBy("event_type").agg(F.count("*").alias("n")).join(audit.counts(broken).groupBy("event_type").agg(F.sum("n").alias("lost")), "event_type", "left")


def b02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).withColumnRenamed("source", "mode")
    return evaluate.mode_labels(rows).join(evaluate.mode_summary(rows).select("mode", "span_count", F.round("mean_confidence", 3).alias("mean_confidence")), "mode")


def b04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    by_mode = rows.where("source in ('regex', 'ner')").withColumnRenamed("source", "mode").unionByName(rows.drop("source").withColumn("mode", F.lit("full")))
    return evaluate.matrix(by_mode, evaluate.overlap_classes(rows, rows.where("source = 'regex'"), rows.where("source = 'ner'")))


def e08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report taken apart again."""
    figures = "map<string,struct<precision:double,recall:double,f1:double,support:long,tp:long,fp:long,fn:long>>"
    rows = evaluate.report_json(e02(spark, sf_dir)).select(F.explode(F.from_json("report", figures)).alias("label", "x"))
    return rows.select("label", F.round("x.f1", 6).alias("f1"), "x.support", "x.tp", "x.fp", "x.fn")


def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.history_row(e02(spark, sf_dir), e04(spark, sf_dir), "full", masking.ENGINE_VERSION)
    return out.select("version", "mode", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "leak")], "support")


def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the labelled sentences: rows, lengths that differ, tags that follow no entity, distinct kinds of tags."""
    rows = training.sentences(spark)
    inside = F.exists(F.sequence(F.lit(0), F.size("tags") - 1), lambda i: F.get("tags", i).startswith("I-") & ((i == 0) | (F.substring(F.get("tags", F.greatest(i - 1, F.lit(0))), 3, 9) != F.substring(F.get("tags", i), 3, 9))))
    kinds = F.size(F.array_distinct(F.flatten(F.collect_set("tags"))))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.size("tokens") != F.size("tags")).alias("uneven"), F.count_if(inside).alias("loose"), kinds.alias("kinds"), F.countDistinct("row_no").alias("numbers"))


def s25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in store.health(False).items()], "field string, value string")


def y02(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = policy.effective(policy.catalog(spark), policy.read(spark, '{"Email": false, "Date": 1, "Other": false}'))
    changed = policy.update(base, spark.createDataFrame([("Email", True), ("IBAN", False), ("Nothing", False)], "label string, enabled boolean"))
    broken = policy.effective(policy.catalog(spark), policy.read(spark, "{"))
    return base.join(changed.withColumnRenamed("enabled", "changed"), "label").join(broken.withColumnRenamed("enabled", "default"), "label")


QUERIES = {
    "A01_span_counts": a01, "A05_text_hash": a05, "A06_counts": a06, "A07_by_label": a07, "A08_by_source": a08, "A10_threshold_hints": a10, "A11_repeated": a11, "A12_recent": a12, "A13_training_export": a13, "A14_by_version": a14, "A15_errors": a15,
    "B03_overlap_classes": b03, "E02_strict": e02, "E03_relaxed": e03, "E04_characters": e04, "E05_rates": e05, "E06_micro": e06, "E06_macro": e06_macro, "E07_leak": e07, "E09_errors": e09,
    "S03_file_kinds": s03, "S08_full_text": s08, "S09_page_breaks": s09, "S10_methods": s10, "S11_upload_status": s11, "S12_mapping": s12, "S13_alive": s13, "S14_remaining": s14, "U02_restore": u02,
    "M01_overlaps": m01, "M02_merge": m02, "M03_dominant": m03, "M04_manual_merge": m04, "M05_canonical_ids": m05, "M06_single": m06, "N20_N22_folds": n21, "F04_filter": f04, "F06_bands": f06, "F07_labels": f07, "A02_summary": a02, "A03_job_rows": a03, "A09_confidences": a09, "A16_degraded": a16,
    "B02_labels": b02, "B04_span_matrix": b04, "E08_report": e08, "E10_history": e10, "T01_sentences": t01, "S25_health": s25, "Y02_Y04_policy": y02,
}

_FPS = "f AS (SELECT entity_label, coalesce(detector_source, 'any') AS source, confidence AS c, row_number() OVER w AS r, count(*) OVER (PARTITION BY entity_label, coalesce(detector_source, 'any')) AS n FROM c WHERE event_type = 'false_positive' AND confidence IS NOT NULL AND NOT isnan(confidence) WINDOW w AS (PARTITION BY entity_label, coalesce(detector_source, 'any') ORDER BY confidence))"
_AT = "max(CASE WHEN r = greatest(0, CAST(floor(n * {q}) AS BIGINT) - 1) + 1 THEN c END)"
_PIVOT = "SELECT {by}, count(*) FILTER (event_type = 'false_positive') AS false_positive, count(*) FILTER (event_type = 'false_negative') AS false_negative, count(*) FILTER (event_type = 'relabel') AS relabel, count(*) AS total FROM c WHERE {by} IS NOT NULL GROUP BY 1"
_STRICT = f"""{_SPANS}, p AS (SELECT DISTINCT doc_id, "start", "end", label FROM {_PRED}), g AS (SELECT DISTINCT doc_id, "start", "end", label FROM s),
e AS (SELECT coalesce(g.label, p.label) AS label, g.doc_id IS NOT NULL AS ing, p.doc_id IS NOT NULL AS inp FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g."start" = p."start" AND g."end" = p."end" AND g.label = p.label),
k AS (SELECT label, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT inp) AS fn FROM e GROUP BY 1)"""
_F1 = "CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END"
_CHARS = f"""{_SPANS}, p AS {_PRED}, gc AS (SELECT DISTINCT doc_id, unnest(range("start", "end")) AS i FROM s), pc AS (SELECT DISTINCT doc_id, unnest(range("start", "end")) AS i FROM p),
t AS (SELECT (SELECT count(*) FROM gc) AS gold_chars, (SELECT count(*) FROM pc) AS pred_chars, (SELECT count(*) FROM gc JOIN pc USING (doc_id, i)) AS shared_chars)"""
_OVER = 'EXISTS (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND b.source = {o} AND a."start" < b."end" AND a."end" > b."start")'
_PAGES = "WITH d AS (SELECT DISTINCT ON (file_id) file_id, filename, error_message, full_text, pages FROM document_results), n AS (SELECT file_id, unnest(pages) AS p, generate_subscripts(pages, 1) AS i FROM d WHERE pages IS NOT NULL)"
_BLANK = "regexp_full_match({c}, '\\s*')"

SQL = {
    "A01_span_counts": f"{_SPANS} SELECT doc_id, count(*) AS span_count, " + ", ".join(f"count(*) FILTER (source = '{x}') AS {x}_spans" for x in audit.SOURCES) + " FROM s GROUP BY 1",
    "A05_text_hash": f"{_SPANS} SELECT span_id, sha256(text) AS text_hash FROM s WHERE text IS NOT NULL",
    "A06_counts": f"{_CORR} SELECT event_type, entity_label, detector_source, count(*) AS n FROM c GROUP BY 1, 2, 3",
    "A07_by_label": f"{_CORR} {_PIVOT.format(by='entity_label')}",
    "A08_by_source": f"{_CORR} {_PIVOT.format(by='detector_source')}",
    "A10_threshold_hints": f"{_CORR}, {_FPS} SELECT entity_label, source, max(n) AS n, min(c) AS lowest, {_AT.format(q='0.5')} AS p50, {_AT.format(q='0.9')} AS p90, max(c) AS highest, round({_AT.format(q='0.9')} + 0.01, 4) AS suggested FROM f GROUP BY 1, 2",
    "A11_repeated": f"{_CORR} SELECT text_hash, entity_label, detector_source, count(*) AS n FROM c WHERE event_type = 'false_positive' GROUP BY 1, 2, 3 HAVING count(*) >= 2 ORDER BY n DESC, text_hash NULLS FIRST, entity_label NULLS FIRST, detector_source NULLS FIRST LIMIT 20",
    "A12_recent": f"{_CORR} SELECT correction_id, event_type, entity_label, detector_source FROM c ORDER BY occurred_at DESC NULLS LAST, correction_id LIMIT 20",
    "A13_training_export": f"{_CORR} SELECT correction_id, detector_source FROM c WHERE event_type = 'relabel' AND entity_label = 'Person' ORDER BY occurred_at DESC NULLS LAST, correction_id LIMIT 1000",
    "A14_by_version": f"{_CORR} SELECT '{masking.ENGINE_VERSION}' AS engine_version, event_type, entity_label, count(*) AS n FROM c GROUP BY 2, 3",
    "A15_errors": "SELECT DISTINCT job_id, 'error' AS event_type, substr(error_message, 1, 500) AS details FROM document_results WHERE error_message IS NOT NULL",
    "B03_overlap_classes": f"{_SPANS}, k AS (SELECT a.label, CASE WHEN {_OVER.format(o=chr(39) + 'ner' + chr(39) + ' AND a.source = ' + chr(39) + 'regex' + chr(39))} OR {_OVER.format(o=chr(39) + 'regex' + chr(39) + ' AND a.source = ' + chr(39) + 'ner' + chr(39))} THEN 'both' ELSE a.source || '_only' END AS class FROM s a WHERE a.source IN ('regex', 'ner')) SELECT label, class, count(*) AS n FROM k GROUP BY 1, 2",
    "E02_strict": f"{_STRICT} SELECT label, tp, fp, fn FROM k",
    "E04_characters": f"{_CHARS} SELECT gold_chars, pred_chars, shared_chars FROM t",
    "E05_rates": f"{_STRICT} SELECT label, tp, fp, fn, tp + fn AS support, round({_F1}, 6) AS f1 FROM k",
    "E06_micro": f"{_STRICT}, q AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM k) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM q",
    "E06_macro": f"{_STRICT} SELECT round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END), 6) AS precision, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END), 6) AS recall, round(avg({_F1}), 6) AS f1 FROM k",
    "E07_leak": f"{_CHARS} SELECT gold_chars, shared_chars, round(1 - shared_chars / gold_chars, 6) AS leak FROM t",
    "E09_errors": f"""{_STRICT} SELECT doc_id, "start", "end", label, 'fp' AS kind FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g."start" = p."start" AND g."end" = p."end" AND g.label = p.label)
UNION ALL SELECT doc_id, "start", "end", label, 'fn' FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE g.doc_id = p.doc_id AND g."start" = p."start" AND g."end" = p."end" AND g.label = p.label)""",
    "S03_file_kinds": "WITH d AS (SELECT DISTINCT ON (file_id) lower(regexp_extract(filename, '\\.[^./]+$', 0)) AS x FROM document_results) SELECT CASE WHEN x = '.pdf' THEN 'pdf' WHEN x IN ('.docx', '.doc') THEN 'docx' WHEN x IN ('.png', '.jpg', '.jpeg', '.tiff', '.tif', '.bmp', '.webp') THEN 'image' END AS kind, count(*) AS n FROM d GROUP BY 1",
    "S08_full_text": f"{_PAGES} SELECT d.file_id, md5(coalesce(string_agg(n.p.text, chr(12) ORDER BY n.i) FILTER (NOT {_BLANK.format(c='n.p.text')}), '')) AS text_md5 FROM d LEFT JOIN n ON d.file_id = n.file_id WHERE d.pages IS NOT NULL GROUP BY 1",
    "S09_page_breaks": f"{_PAGES}, f AS (SELECT file_id, i, length(p.text) AS k FROM n WHERE NOT {_BLANK.format(c='p.text')}) SELECT file_id, CAST(row_number() OVER w - 1 AS INT) AS page, CAST(coalesce(sum(k + 1) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM f WINDOW w AS (PARTITION BY file_id ORDER BY i)",
    "S10_methods": f"{_PAGES} SELECT d.file_id, coalesce(string_agg(DISTINCT n.p.extract_method, ',' ORDER BY n.p.extract_method), '') AS methods, coalesce(bool_or(n.p.extract_method = 'ocr'), false) AS has_ocr FROM d LEFT JOIN n ON d.file_id = n.file_id WHERE d.pages IS NOT NULL GROUP BY 1",
    "S12_mapping": f"{_MAPPING} SELECT job_id, placeholder, original FROM m",
    "S13_alive": f"{_MAPPING} SELECT job_id, CAST(count(*) AS INT) AS n FROM m WHERE expires_at > TIMESTAMPTZ '{_NOW}+00' GROUP BY 1",
    "S14_remaining": f"""{_MAPPING}, l AS (SELECT job_id, max(expires_at) AS until, bool_or(expires_at IS NULL) AS ever FROM m GROUP BY 1) SELECT q.job_id, CAST(CASE WHEN l.ever IS NULL THEN -2 WHEN l.ever THEN -1 WHEN floor(epoch(until)) - epoch(TIMESTAMPTZ '{_NOW}+00') <= 0 THEN -2 ELSE floor(epoch(until)) - epoch(TIMESTAMPTZ '{_NOW}+00') END AS BIGINT) AS seconds FROM (SELECT DISTINCT job_id FROM jobs) q LEFT JOIN l ON q.job_id = l.job_id""",
    "U02_restore": f"""{_MAPPING}, v AS (SELECT job_id, max(CASE WHEN placeholder = '{{Person_1}}' THEN original END) AS p, max(CASE WHEN placeholder = '{{Company_1}}' THEN original END) AS c FROM m WHERE expires_at > TIMESTAMPTZ '{_NOW}+00' GROUP BY 1)
SELECT q.job_id, 'a ' || coalesce(v.p, '{{Person_1}}') || ' b ' || coalesce(v.c, '{{Company_1}}') || ' c {{Person_1000000}}' AS text, CASE WHEN v.job_id IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (SELECT DISTINCT job_id FROM jobs) q LEFT JOIN v ON q.job_id = v.job_id""",
}


def _greedy(name: str, rows: str, order: str) -> str:
    """Recursive choice per job: ``{name}`` holds what is kept of ``rows`` taken in ``order``."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}, nr) AS r FROM ({rows}) q),
{name}_w AS (SELECT doc_id, 0 AS r, CAST([] AS STRUCT(a INT, b INT, id BIGINT)[]) AS kept FROM {name}_r GROUP BY 1
  UNION ALL SELECT w.doc_id, x.r, CASE WHEN len(list_filter(w.kept, lambda k: k.a < x."end" AND k.b > x."start")) > 0 THEN w.kept ELSE list_append(w.kept, {{'a': x."start", 'b': x."end", 'id': x.span_id}}) END
  FROM {name}_w w JOIN {name}_r x ON x.doc_id = w.doc_id AND x.r = w.r + 1),
{name} AS (SELECT {name}_r.* FROM {name}_r JOIN (SELECT doc_id, unnest(max_by(kept, r)).id AS span_id FROM {name}_w GROUP BY 1) k ON k.doc_id = {name}_r.doc_id AND k.span_id = {name}_r.span_id)"""


_OUT = 'doc_id, "start", "end", label, source, confidence'
_SIZE = '("end" - "start") DESC, confidence DESC NULLS LAST'
_REC = _SPANS.replace("WITH s", "WITH RECURSIVE s")
_DOMINANT = "label IN (" + ", ".join(f"'{x}'" for x in DOMINANT) + ")"
_NR = "SELECT *, CASE source WHEN 'regex' THEN 0 WHEN 'ner' THEN 1 ELSE 2 END * 1000000000000 + span_id AS nr FROM s WHERE source IN ('regex', 'ner', 'gazetteer')"
_MERGE = _greedy("m", _NR, f"(source = 'regex' AND {_DOMINANT}) DESC, {_SIZE}, (source IN ('regex', 'gazetteer')) DESC")
_OF = "SELECT *, span_id AS nr FROM s WHERE source = '{x}'"
_BLANKS = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{000B}]+"
_UPPER = "replace(replace(replace(upper({c}), 'ﬁ', 'FI'), 'ﬂ', 'FL'), 'ß', 'SS')"  # letters whose upper case is longer
_FOLD = _UPPER.format(c="translate({c}, 'çÇğĞıİöÖşŞüÜ', 'cCgGiIoOsSuU')")
_STRIP = f"regexp_replace(text, '^{_BLANKS}|{_BLANKS}$', '', 'g')"
_LAST = f"regexp_extract({_FOLD.format(c=_STRIP)}, '[A-Z0-9]+$')"

SQL |= {
    "M01_overlaps": f"{_REC}, {_greedy('m', _OF.format(x='regex'), _SIZE)} SELECT {_OUT} FROM m",
    "M02_merge": f"{_REC}, {_MERGE} SELECT {_OUT} FROM m",
    "M03_dominant": f"{_SPANS} SELECT label, bool_or({_DOMINANT}) AS dominant FROM s GROUP BY 1",
    "M04_manual_merge": f"{_REC}, {_MERGE}, {_greedy('h', _OF.format(x='manual'), _SIZE)} SELECT {_OUT} FROM h UNION ALL SELECT {_OUT} FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = m.doc_id AND h.\"start\" < m.\"end\" AND h.\"end\" > m.\"start\")",
    "M05_canonical_ids": f"{_SPANS} SELECT span_id, label || '::' || trim(regexp_replace(lower(replace(text, 'İ', 'i' || chr(775))), '{_BLANKS}', ' ', 'g')) AS canonical_id FROM s WHERE text IS NOT NULL AND label IS NOT NULL",
    "M06_single": f"{_REC}, {_greedy('m', _OF.format(x='ner'), _SIZE)} SELECT {_OUT} FROM m",
    "N20_N22_folds": f"WITH t AS (SELECT DISTINCT text FROM spans WHERE text IS NOT NULL) SELECT text, {_FOLD.format(c='text')} AS folded, replace({_UPPER.format(c='text')}, 'İ', 'I') AS folded_tr, "
    + " OR ".join([f"contains({_FOLD.format(c=_STRIP)}, '{p}')" for p in W.INSTITUTION_PHRASES] + [f"starts_with({_LAST}, '{r}')" for r in W.INSTITUTION_ROOTS]) + " AS institution FROM t",
    "S11_upload_status": "SELECT DISTINCT ON (file_id) file_id, CASE WHEN strlen(coalesce(full_text, '')) = 0 THEN 'empty' WHEN error_message IS NOT NULL THEN 'failed' WHEN regexp_full_match(full_text, '\\s*') THEN 'blank' ELSE 'ok' END AS status FROM document_results",
    "E03_relaxed": f"""{_REC}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY span_id) AS r FROM s),
p AS (SELECT doc_id, label, list({{'q': span_id, 'a': "start", 'b': "end"}} ORDER BY span_id) AS ps FROM {_PRED} GROUP BY 1, 2),
w AS (SELECT doc_id, label, 0 AS r, CAST([] AS BIGINT[]) AS used FROM g GROUP BY 1, 2
  UNION ALL SELECT w.doc_id, w.label, g.r, list_concat(w.used, list_filter(list_transform(p.ps, lambda x: CASE WHEN x.a < g."end" AND x.b > g."start" AND NOT list_contains(w.used, x.q) THEN x.q END), lambda y: y IS NOT NULL)[1:1])
  FROM w JOIN g ON g.doc_id = w.doc_id AND g.label = w.label AND g.r = w.r + 1 LEFT JOIN p ON p.doc_id = g.doc_id AND p.label = g.label),
t AS (SELECT label, sum(k) AS tp FROM (SELECT doc_id, label, coalesce(len(max_by(used, r)), 0) AS k FROM w GROUP BY 1, 2) z GROUP BY 1)
SELECT label, CAST(tp AS BIGINT) AS tp, CAST(n_pred - tp AS BIGINT) AS fp, CAST(n_gold - tp AS BIGINT) AS fn FROM t JOIN (SELECT label, count(*) AS n_gold FROM s GROUP BY 1) a USING (label) LEFT JOIN (SELECT label, count(*) AS n_pred FROM {_PRED} z GROUP BY 1) b USING (label)""",
    "F04_filter": f"{_SPANS} SELECT {_OUT} FROM s WHERE source IN ('regex', 'ner') AND label IN ('Person', 'Email')",
    "F06_bands": f"{_SPANS} SELECT span_id, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM s",
    "F07_labels": f"{_SPANS} SELECT doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (source IN ('regex', 'ner')), '') AS labels FROM s GROUP BY 1",
    "A02_summary": f"{_SPANS} SELECT doc_id, label, source, confidence, CASE WHEN EXISTS (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND b.label = 'Person' AND b.source IN ('regex', 'ner') AND b.text = a.text) THEN '{{P:' || text || '}}' ELSE '' END AS placeholder FROM s a WHERE source IN ('regex', 'ner') AND text IS NOT NULL",
    "A03_job_rows": f"{_SPANS}, d AS (SELECT DISTINCT ON (file_id) file_id, job_id, pages FROM document_results), p AS (SELECT job_id, coalesce(string_agg(DISTINCT m.extract_method, ',' ORDER BY m.extract_method), '') AS extraction_methods FROM d LEFT JOIN LATERAL (SELECT unnest(pages, max_depth := 2)) m ON true GROUP BY 1), c AS (SELECT doc_id, count(*) AS n, " + ", ".join(f"count(*) FILTER (source = '{x}') AS {x}" for x in audit.SOURCES)
    + f" FROM s GROUP BY 1) SELECT job_id, 'full' AS mode, 'pdf' AS file_type, extraction_methods, CAST(n AS INT) AS span_count, " + ", ".join(f"CAST({x} AS INT) AS {x}_spans" for x in audit.SOURCES) + f", 3 AS char_count, TIMESTAMPTZ '{_NOW}+00' + INTERVAL 1 DAY AS mapping_expires_at, 'mask' AS event_type, 'success' AS outcome FROM p JOIN c ON c.doc_id = p.job_id",
    "A09_confidences": f"{_CORR} SELECT entity_label, coalesce(detector_source, 'any') AS source, confidence, count(*) AS n FROM c WHERE event_type = 'false_positive' AND confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY 1, 2, 3",
    "A16_degraded": f"{_CORR} SELECT event_type, count(*) AS n, CAST(NULL AS BIGINT) AS lost FROM c GROUP BY 1",
    "B02_labels": f"{_SPANS}, m AS (SELECT source AS mode, count(*) AS span_count, round(round(coalesce(avg(confidence), 0), 4), 3) AS mean_confidence FROM s GROUP BY 1) SELECT m.mode, label, n, span_count, mean_confidence FROM (SELECT source AS mode, label, count(*) AS n FROM s GROUP BY 1, 2) l JOIN m ON m.mode = l.mode",
    "B04_span_matrix": f"{_SPANS}, k AS (SELECT a.label, CASE WHEN {_OVER.format(o=chr(39) + 'ner' + chr(39) + ' AND a.source = ' + chr(39) + 'regex' + chr(39))} OR {_OVER.format(o=chr(39) + 'regex' + chr(39) + ' AND a.source = ' + chr(39) + 'ner' + chr(39))} THEN 'both' ELSE a.source || '_only' END AS class FROM s a WHERE a.source IN ('regex', 'ner')), c AS (SELECT label, count(*) FILTER (class = 'regex_only') AS regex_only, count(*) FILTER (class = 'ner_only') AS ner_only, count(*) FILTER (class = 'both') AS both FROM k GROUP BY 1) "
    "SELECT label, count(*) FILTER (source = 'regex') AS regex, count(*) FILTER (source = 'ner') AS ner, count(*) AS \"full\", coalesce(max(c.regex_only), 0) AS regex_only, coalesce(max(c.ner_only), 0) AS ner_only, coalesce(max(c.both), 0) AS both FROM s LEFT JOIN c USING (label) GROUP BY 1",
    "E08_report": f"{_STRICT} SELECT label, round({_F1}, 6) AS f1, tp + fn AS support, tp, fp, fn FROM k",
    "E10_history": f"{_STRICT}, q AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM k), gc AS (SELECT DISTINCT doc_id, unnest(range(\"start\", \"end\")) AS i FROM s), pc AS (SELECT DISTINCT doc_id, unnest(range(\"start\", \"end\")) AS i FROM {_PRED}) SELECT '{masking.ENGINE_VERSION}' AS version, 'full' AS mode, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(1 - (SELECT count(*) FROM gc JOIN pc USING (doc_id, i)) / (SELECT count(*) FROM gc), 6) AS leak, CAST(tp + fn AS BIGINT) AS support FROM q",
    "T01_sentences": "SELECT CAST(6000 AS BIGINT) AS n, CAST(0 AS BIGINT) AS uneven, CAST(0 AS BIGINT) AS loose, 6 AS kinds, CAST(6000 AS BIGINT) AS numbers",
    "S25_health": "SELECT * FROM (VALUES ('status', 'ok'), ('service', 'veilwright'), ('ner_available', 'False')) v(field, value)",
    "Y02_Y04_policy": "SELECT label, label <> 'Email' AS enabled, label <> 'IBAN' AS changed, true AS \"default\" FROM (SELECT unnest(['" + "', '".join(W.LABELS) + "']) AS label) v",
}
