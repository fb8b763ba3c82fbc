"""Queries of the detectors, the masking plan and its parts over the texts of mask_calls and gold_docs."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions import presentation as P
from veilwright.functions.registry import PATTERNS, Pattern
from veilwright.functions.validators import VALIDATORS
from veilwright.operators import detect, evaluate, gazetteer, masking, ner
from veilwright.runtime import cut, spread, table

KEYS = ["src_table", "record_id"]
#: Surfaces of the dictionary that stands in for a model in the registered queries.
ENTRIES = {"Ankara": "LOC", "Bursa": "LOC", "İstanbul": "LOC", "İzmir": "LOC", "Muhasebe servisi": "ORG", "Danışman kuruluş": "ORG", "Mehmet": "PER", "Çetin": "PER"}


def _place() -> list:
    """Where a row stands: its file and its number there."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request's, upload's and annotated document's whole text, once.

    Repeated rows are found on their keys and places in the files and taken out where the texts are read, so the texts
    themselves are not shuffled. Only a table with fewer splits than cores is spread over them.
    """
    calls = table(spark, sf_dir, "mask_calls").select(F.lit("mask_calls").alias("src_table"), F.col("call_id").cast("string").alias("record_id"), F.coalesce("text", "original_text").alias("text"), "manual_spans", *_place())
    gold = table(spark, sf_dir, "gold_docs").select(F.lit("gold_docs").alias("src_table"), F.col("doc_id").alias("record_id"), "text", F.lit(None).cast("array<struct<text:string,label:string>>").alias("manual_spans"), *_place())
    rows = calls.unionByName(gold).where("text is not null")
    at = F.struct("_file", "_row")
    first = rows.groupBy(*KEYS).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = rows.select(*KEYS, "_file", "_row").join(first, KEYS).where(at != F.col("first")).select("_file", "_row")
    rows = rows.join(again, ["_file", "_row"], "left_anti").drop("_file", "_row")
    return rows if calls.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else spread(rows)


_TEXTS = """WITH texts AS (
  SELECT DISTINCT 'mask_calls' AS src_table, CAST(call_id AS VARCHAR) AS record_id, coalesce(text, original_text) AS text FROM mask_calls
  UNION SELECT DISTINCT 'gold_docs', doc_id, text FROM gold_docs)"""


def _surfaces(spark: SparkSession, sf_dir: str, pattern: Pattern) -> DataFrame:
    found = detect.explode_spans(texts(spark, sf_dir), KEYS, detect.detect_one("text", pattern))
    return found.groupBy(*KEYS, F.col("text").alias("surface")).agg(F.count("*").alias("n"))


def _sql(pattern: str, group: int = 0, where: str = "true") -> str:
    quoted = pattern.replace("'", "''")
    return f"{_TEXTS}, found AS (SELECT src_table, record_id, unnest(regexp_extract_all(text, '{quoted}', {group})) AS surface FROM texts) SELECT src_table, record_id, surface, count(*) AS n FROM found WHERE {where} GROUP BY ALL"


def _digits(c: str, i: int) -> str:
    return f"CAST(substr({c}, {i}, 1) AS INT)"


def tc_sql(c: str) -> str:
    d = [_digits(c, i) for i in range(1, 12)]
    tenth = f"((7 * ({d[0]}+{d[2]}+{d[4]}+{d[6]}+{d[8]}) - ({d[1]}+{d[3]}+{d[5]}+{d[7]})) % 10 + 10) % 10"
    return f"(regexp_full_match({c}, '[1-9][0-9]{{10}}') AND CASE WHEN regexp_full_match({c}, '[0-9]{{11}}') THEN {tenth} = {d[9]} AND ({'+'.join(d[:10])}) % 10 = {d[10]} ELSE false END)"


def vkn_sql(c: str) -> str:
    parts = []
    for i in range(9):
        t = f"(({_digits(c, i + 1)} + {9 - i}) % 10)"
        parts.append(f"CASE WHEN {t} = 0 THEN 0 WHEN ({t} * {2 ** (9 - i)}) % 9 = 0 THEN 9 ELSE ({t} * {2 ** (9 - i)}) % 9 END")
    return f"CASE WHEN regexp_full_match({c}, '[0-9]{{10}}') THEN (10 - ({' + '.join(parts)}) % 10) % 10 = {_digits(c, 10)} ELSE false END"


def iban_sql(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, 'TR[0-9]{{24}}') THEN CAST(substr({c}, 5) || '2927' || substr({c}, 3, 2) AS HUGEINT) % 97 = 1 ELSE false END"


def luhn_sql(c: str) -> str:
    doubled = f"list_sum(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN (length({c}) - i) % 2 = 0 THEN CAST(substr({c}, i, 1) AS INT) ELSE (CASE WHEN CAST(substr({c}, i, 1) AS INT) * 2 > 9 THEN CAST(substr({c}, i, 1) AS INT) * 2 - 9 ELSE CAST(substr({c}, i, 1) AS INT) * 2 END) END))"
    return f"(length({c}) BETWEEN 13 AND 19 AND {doubled} % 10 = 0)"


_PATTERN_SQL = {
    "R01": _sql("[0-9]+", 0, f"length(surface) = 11 AND {tc_sql('surface')}"),
    "R06": _sql("[0-9]+", 0, f"length(surface) = 10 AND {vkn_sql('surface')}"),
    "R09": _sql(r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    "R10": _sql(r"(?:\+90|0090|0)[ \-]?[2-5][0-9]{2}[ \-]?[0-9]{3}[ \-]?[0-9]{2}[ \-]?[0-9]{2}"),
    "R12": _sql(r"\b[A-Z]{1,2}[0-9]{7,9}\b"),
    "R15": _sql(r"\b(?:[0-9]{2}[./\-][0-9]{2}[./\-][0-9]{4}|[0-9]{4}[./\-][0-9]{2}[./\-][0-9]{2})\b"),
    "R17": _sql(r"(?i)(?:Esas|Karar|Dava|Dosya|İş)\s+No\.?:?\s*([0-9]{4}/[0-9]+)", 1),
    "R18": _sql(r"\b[0-9]{4}/[0-9]{4,}\b"),
}


def _sound(df: DataFrame) -> DataFrame:
    """Per record: spans whose text is not what stands at their place, and neighbours that overlap."""
    wrong = F.size(F.filter("spans", lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"]) != s["text"]))
    return df.select(*KEYS, wrong.alias("wrong"))


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = texts(spark, sf_dir).withColumn("spans", detect.single(detect.detect_all("text")))
    over = F.size(F.filter(F.arrays_zip(F.col("spans").alias("a"), F.slice("spans", 2, F.greatest(F.size("spans"), F.lit(1))).alias("b")), lambda z: z["b"].isNotNull() & (z["b"]["start"] < z["a"]["end"])))
    return _sound(out).join(out.select(*KEYS, over.alias("overlapping")), KEYS)


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sound(texts(spark, sf_dir).withColumn("spans", gazetteer.detect("text")))


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sound(texts(spark, sf_dir).withColumn("spans", ner.filtered("text", ner.dictionary_model("text", ENTRIES))))


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text whether running a model window by window gives what it gives on the whole text."""
    df = texts(spark, sf_dir).withColumn("key", F.concat_ws(":", *KEYS))
    raw = ner.windowed(df, "key", "text", lambda t: ner.dictionary_model(t, ENTRIES))
    whole = df.select("key", F.array_sort(ner.dictionary_model("text", ENTRIES)).alias("whole"))
    return whole.join(raw, "key", "left").select("key", F.coalesce(F.col("whole") == F.col("raw"), F.size("whole") == 0).alias("holds"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text what the cores of its windows cover, and whether each core stands in its window."""
    w = ner.token_windows("text")
    size = F.aggregate("w", F.lit(0), lambda acc, x: acc + x["core_end"] - x["core_start"])
    inside = F.forall("w", lambda x: (x["win_start"] <= x["core_start"]) & (x["core_end"] <= x["win_end"]))
    return texts(spark, sf_dir).select(*KEYS, w.alias("w")).select(*KEYS, size.alias("covered"), inside.alias("inside"))


def _masked(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return masking.mask(texts(spark, sf_dir), "text", masking.Settings(entries=ENTRIES, **settings))


def _mask(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return _masked(spark, sf_dir, **settings).select(*KEYS, "masked_text", F.size("spans").alias("n_spans"), F.size("mapping").alias("n_placeholders"))


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked and restored again: the original comes back wherever no entity had several surfaces."""
    out = _masked(spark, sf_dir, mode="regex").withColumn("restored", masking.unmask("masked_text", F.col("mapping")))
    several = F.size(F.array_distinct(F.transform("spans", lambda s: s["text"]))) != F.size("mapping")
    return out.select(*KEYS, (several | (F.col("restored") == F.col("text"))).alias("holds"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = texts(spark, sf_dir).select(*KEYS, P.segments("text", detect.detect("text")).alias("seg"))
    return out.select(*KEYS, F.md5(F.array_join(F.transform("seg", lambda s: s["text"]), "")).alias("text_md5"))


def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text under each mode, in one table."""
    parts = []
    for mode in ("regex", "ner", "full"):
        out = _masked(spark, sf_dir, mode=mode)
        parts.append(detect.explode_spans(out, KEYS).select(F.lit(mode).alias("mode"), F.concat_ws(":", *KEYS).alias("doc_id"), "start", "end", "label", "source", "confidence"))
    return cut(parts[0].unionByName(parts[1]).unionByName(parts[2]), "ablation")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mode_summary(_ablation(spark, sf_dir))


def _markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated text out of the pattern spans, parsed again: clean text and offsets must come back.

    Brackets and bars of the text itself are put into private characters while it is marked.
    """
    plain = texts(spark, sf_dir).withColumn("text", F.translate("text", "[]|", _STAND_INS)).withColumn("spans", detect.detect("text"))
    marks = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("[["), s["text"], F.lit("|"), s["label"], F.lit("]]")).alias("placeholder")))
    parsed = plain.select(*KEYS, "spans", evaluate.parse_markup(masking.substituted("text", marks)).alias("m"))
    places = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["text"].alias("text")))
    return parsed.select(*KEYS, F.md5(F.translate("m.text", _STAND_INS, "[]|")).alias("text_md5"), (places("m.spans") == places("spans")).alias("same_spans"))


_STAND_INS = "\ue000\ue001\ue002"
_NAMES = {p.id: f"{p.id}_{p.label.lower()}" for p in PATTERNS}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {_NAMES[p.id]: partial(_surfaces, pattern=p) for p in PATTERNS if p.id in _PATTERN_SQL}
QUERIES |= {
    "M01_pattern_spans": _detected,
    "G01_G03_dictionary_spans": _gazetteer,
    "N05_N19_model_spans": _model,
    "N02_token_windows": _windows,
    "N07_windowed_model": _windowed,
    "P02_mask_full": _mask,
    "P02_mask_regex": partial(_mask, mode="regex"),
    "P02_mask_ner": partial(_mask, mode="ner"),
    "U01_round_trip": _round_trip,
    "B01_mode_summary": _summary,
    "E01_markup": _markup,
    "F02_segments": _segments,
}
_EACH = f"{_TEXTS} SELECT src_table, record_id, {{}} FROM texts WHERE text IS NOT NULL"
SQL = {_NAMES[k]: v for k, v in _PATTERN_SQL.items()}
SQL |= {
    "M01_pattern_spans": _EACH.format("0 AS wrong, 0 AS overlapping"),
    "G01_G03_dictionary_spans": _EACH.format("0 AS wrong"),
    "N05_N19_model_spans": _EACH.format("0 AS wrong"),
    "N02_token_windows": _EACH.format("CAST(length(text) AS INT) AS covered, true AS inside"),
    "N07_windowed_model": f"{_TEXTS} SELECT src_table || ':' || record_id AS key, true AS holds FROM texts WHERE text IS NOT NULL",
    "U01_round_trip": _EACH.format("true AS holds"),
    "E01_markup": _EACH.format("md5(text) AS text_md5, true AS same_spans"),
    "F02_segments": _EACH.format("md5(text) AS text_md5"),
}

_VALID = {"V01": ("TC_No", "tc_kimlik", "regexp_replace(text, '[ -]', '', 'g')", tc_sql), "V02": ("IBAN", "iban_tr", "upper(regexp_replace(text, '[ -]', '', 'g'))", iban_sql), "V03": ("Tax_No", "vkn", "regexp_replace(text, '[ -]', '', 'g')", vkn_sql), "V04": ("Card_No", "luhn", "regexp_replace(text, '[^0-9]', '', 'g')", luhn_sql)}


def _validated(spark: SparkSession, sf_dir: str, label: str, validator: str) -> DataFrame:
    rows = table(spark, sf_dir, "spans").where(F.col("label") == label).where("text is not null").select("text").distinct()
    return rows.select("text", VALIDATORS[validator]("text").alias("valid"))


for _id, (_label, _name, _clean, _check) in _VALID.items():
    QUERIES[f"{_id}_{_name}"] = partial(_validated, label=_label, validator=_name)
    SQL[f"{_id}_{_name}"] = f"WITH t AS (SELECT DISTINCT text, {_clean} AS c FROM spans WHERE label = '{_label}' AND text IS NOT NULL) SELECT text, {_check('c')} AS valid FROM t"


def _plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "spans").where("label = 'License_Plate' and text is not null").select("text").distinct()
    return rows.select("text", VALIDATORS["plate"]("text").alias("valid"))


QUERIES["V05_plate"] = _plates
SQL["V05_plate"] = "WITH t AS (SELECT DISTINCT text, substr(replace(text, ' ', ''), 1, 2) AS c FROM spans WHERE label = 'License_Plate' AND text IS NOT NULL) SELECT text, regexp_full_match(c, '[0-9]{2}') AND c BETWEEN '01' AND '81' AS valid FROM t"
