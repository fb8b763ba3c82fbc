"""Detector comparison and scoring against annotated text. Spans are rows ``doc_id, start, end, label``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwright.functions import spans as S

KEY = ["doc_id", "start", "end", "label"]


def parse_markup(raw: Column | str) -> Column:
    """``struct<text, spans>`` of text in which ``[[surface|Label]]`` marks an entity."""
    raw = S.col(raw)
    mark = r"\[\[([^\[\]|]+)\|([^\[\]|]+)\]\]"
    surface = F.regexp_extract_all(raw, F.lit(mark), F.lit(1))
    label = F.regexp_extract_all(raw, F.lit(mark), F.lit(2))
    gaps = F.split(raw, mark, -1)
    empty = F.array().cast("array<struct<start:int,end:int,label:string,text:string>>")
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("text"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["g"])
        end = start + F.length(x["s"])
        hit = F.struct(start.alias("start"), end.alias("end"), x["l"].alias("label"), x["s"].alias("text"))
        return F.struct(end.alias("pos"), F.concat(acc["text"], x["g"], x["s"]).alias("text"), F.array_append(acc["spans"], hit).alias("spans"))

    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(surface)).alias("g"), surface.alias("s"), label.alias("l"))
    rest = F.element_at(gaps, -1)
    return F.aggregate(zipped, zero, step, lambda acc: F.struct(F.concat(acc["text"], rest).alias("text"), acc["spans"].alias("spans")))


def strict(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Set comparison on document, place and label: ``label, tp, fp, fn``."""
    g = gold.select(*KEY).distinct().withColumn("g", F.lit(1))
    p = pred.select(*KEY).distinct().withColumn("p", F.lit(1))
    both = g.join(p, KEY, "full")
    hit = lambda c: F.count_if(c)
    return both.groupBy("label").agg(hit(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), hit(F.col("g").isNull()).alias("fp"), hit(F.col("p").isNull()).alias("fn"))


def relaxed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Each gold span, in order, takes the first free predicted span of its label that it overlaps: ``label, tp, fp, fn``.

    Spans that do not touch cannot meet, so the order-dependent walk runs inside islands of touching spans of one
    label, never over a whole document.
    """

    def side(df: DataFrame, gold_side: bool) -> DataFrame:
        seq = F.col("seq") if "seq" in df.columns else F.struct("start", "end")
        order = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy(seq, "start", "end"))
        return df.select("doc_id", "label", F.col("start").cast("int"), F.col("end").cast("int"), order.alias("q"), F.lit(gold_side).alias("g"))

    both = side(gold, True).unionByName(side(pred, False))
    w = Window.partitionBy("doc_id", "label").orderBy("start", "end", "g", "q")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("fresh", (before.isNull() | (F.col("start") >= before)).cast("int")).withColumn("island", F.sum("fresh").over(w))
    member = F.struct("q", "start", "end")
    of = lambda g: F.array_sort(F.collect_list(F.when(F.col("g") == g, member)))
    groups = both.groupBy("doc_id", "label", "island").agg(of(True).alias("gs"), of(False).alias("ps"))
    zero = F.array().cast("array<int>")

    def take(used: Column, g: Column) -> Column:
        free = F.transform("ps", lambda p, i: F.when(S.overlaps(p, g) & ~F.array_contains(used, i), i))
        return F.concat(used, F.slice(F.filter(free, lambda i: i.isNotNull()), 1, 1))

    counted = groups.select("label", F.size(F.aggregate("gs", zero, take)).alias("tp"), F.size("gs").alias("n_gold"), F.size("ps").alias("n_pred"))
    tp = F.sum("tp")
    return counted.groupBy("label").agg(tp.alias("tp"), (F.sum("n_pred") - tp).alias("fp"), (F.sum("n_gold") - tp).alias("fn"))


def islands(spans: DataFrame) -> DataFrame:
    """Disjoint intervals that cover the same positions."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select("doc_id", "start", "end").withColumn("fresh", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn("i", F.sum("fresh").over(w))
    return marked.groupBy("doc_id", "i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("i")


def characters(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: positions in gold, in predictions and in both. Works on intervals, not on positions."""
    g, p = islands(gold), islands(pred)
    size = F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))
    a, b = g.alias("a"), p.alias("b")
    shared = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.start") < F.col("b.end")) & (F.col("a.end") > F.col("b.start")))
    width = F.least(F.col("a.end"), F.col("b.end")) - F.greatest(F.col("a.start"), F.col("b.start"))
    return g.agg(size.alias("gold_chars")).crossJoin(p.agg(size.alias("pred_chars"))).crossJoin(shared.agg(F.coalesce(F.sum(width), F.lit(0)).alias("shared_chars")))  # three single rows


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 with zeros where a denominator is zero."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).withColumn("support", tp + fn)


def micro(counts: DataFrame) -> DataFrame:
    return rates(counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def macro(counts: DataFrame) -> DataFrame:
    """Means over the labels seen."""
    return rates(counts).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def leak(chars: DataFrame) -> DataFrame:
    g, p, s = F.col("gold_chars"), F.col("pred_chars"), F.col("shared_chars")
    out = chars.withColumn("char_recall", ratio(s, g, 1.0)).withColumn("char_precision", ratio(s, p, 1.0))
    return out.withColumn("leak", 1 - F.col("char_recall"))


def report(counts: DataFrame) -> DataFrame:
    """Labels by support, the largest first."""
    return rates(counts).orderBy(F.desc("support"), "label")


def report_json(counts: DataFrame) -> DataFrame:
    """One row: a JSON object of the labels in order with their figures. There are as many entries as labels."""
    figures = F.struct("precision", "recall", "f1", "support", "tp", "fp", "fn").alias("figures")
    entries = F.array_sort(F.collect_list(F.struct("label", figures)))
    return rates(counts).agg(F.to_json(F.map_from_entries(entries)).alias("report"))


def errors(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """False positives and false negatives with their kind."""
    g, p = gold.select(*KEY).distinct(), pred.select(*KEY).distinct()
    return p.join(g, KEY, "left_anti").withColumn("kind", F.lit("fp")).unionByName(g.join(p, KEY, "left_anti").withColumn("kind", F.lit("fn")))


def history_row(counts: DataFrame, chars: DataFrame, mode: str, version: str) -> DataFrame:
    return micro(counts).crossJoin(leak(chars).select("leak")).select(F.lit(version).alias("version"), F.lit(mode).alias("mode"), "precision", "recall", "f1", "leak", "support")  # two single rows


# -- comparison of detectors


def mode_summary(spans: DataFrame) -> DataFrame:
    """Spans and mean confidence per mode."""
    return spans.groupBy("mode").agg(F.count("*").alias("span_count"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("mean_confidence"))


def mode_labels(spans: DataFrame) -> DataFrame:
    """Spans per mode and label."""
    return spans.groupBy("mode", "label").agg(F.count("*").alias("n"))


def overlap_classes(full: DataFrame, regex: DataFrame, ner: DataFrame) -> DataFrame:
    """Spans of the full run as ``regex_only``, ``ner_only`` or ``both``; other sources are left out."""

    def touched(own: DataFrame, other: DataFrame) -> DataFrame:
        a, b = own.alias("a"), other.select("doc_id", "start", "end").alias("b")
        cond = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.start") < F.col("b.end")) & (F.col("a.end") > F.col("b.start"))
        return a.join(b, cond, "left_semi").withColumn("class", F.lit("both")).unionByName(a.join(b, cond, "left_anti").withColumn("class", F.concat(F.col("source"), F.lit("_only"))))

    return touched(full.where("source = 'regex'"), ner).unionByName(touched(full.where("source = 'ner'"), regex))


def matrix(by_mode: DataFrame, classes: DataFrame) -> DataFrame:
    """Per label: spans per mode and per overlap class."""
    modes = by_mode.groupBy("label").pivot("mode", ["regex", "ner", "full"]).count()
    kinds = classes.groupBy("label").pivot("class", ["regex_only", "ner_only", "both"]).count()
    return modes.join(kinds, "label", "full").fillna(0)


