"""Transforms behind the screens: pages, segments, context, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.functions import spans as S

PLACEHOLDER = r"\{[A-Za-z_]+_\d+\}"


def paginated(text: Column | str, separator: str = "\f", limit: int = 1200) -> Column:
    """``array<struct<text,start>>``: real pages where the separator stands, else paragraphs packed up to ``limit``."""
    text = S.col(text)
    kind = "array<struct<text:string,start:int>>"
    place = lambda acc, part, width: F.struct((acc["pos"] + F.length(part) + width).alias("pos"), F.array_append(acc["out"], F.struct(part.alias("text"), acc["pos"].alias("start"))).alias("out"))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))
    real = F.aggregate(F.split(text, "\\Q" + separator + "\\E", -1), zero, lambda acc, p: place(acc, p, len(separator)), lambda acc: acc["out"])

    def pack(acc: Column, p: Column) -> Column:
        last = F.element_at(acc["out"], -1)
        full = (F.length(last["text"]) > 0) & (F.length(last["text"]) + F.length(p) + 2 > limit)
        fresh = F.array_append(acc["out"], F.struct(p.alias("text"), acc["pos"].alias("start")))
        glued = F.when(F.length(last["text"]) > 0, F.concat(last["text"], F.lit("\n\n"), p)).otherwise(p)
        longer = F.array_append(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.struct(glued.alias("text"), last["start"].alias("start")))
        return F.struct((acc["pos"] + F.length(p) + 2).alias("pos"), F.when(full, fresh).otherwise(longer).alias("out"))

    first = F.array(F.struct(F.lit("").alias("text"), F.lit(0).alias("start"))).cast(kind)
    packed = F.aggregate(F.split(text, "\n\n+", -1), F.struct(F.lit(0).alias("pos"), first.alias("out")), pack, lambda acc: F.filter(acc["out"], lambda p: p["text"] != ""))
    return F.when(text.isNull() | (text == ""), F.array().cast(kind)).when(text.contains(separator), real).otherwise(packed)


def segments(text: Column | str, spans: Column) -> Column:
    """``array<struct<kind,text>>`` that alternates between plain text and spans."""
    text = S.col(text)
    kind = "array<struct<kind:string,text:string>>"
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))
    part = lambda k, a, b: F.struct(F.lit(k).alias("kind"), F.substring(text, a + 1, b - a).alias("text"))
    some = lambda acc, end: F.when(end > acc["pos"], F.array_append(acc["out"], part("plain", acc["pos"], end))).otherwise(acc["out"])
    step = lambda acc, s: F.struct(s["end"].alias("pos"), F.array_append(some(acc, s["start"]), part("span", s["start"], s["end"])).alias("out"))
    return F.aggregate(S.by_start(spans), zero, step, lambda acc: some(acc, F.length(text)))


def context(text: Column | str, start: Column, end: Column, width: int = 100) -> Column:
    """The text around a span, trimmed, with ellipses where it was cut."""
    text = S.col(text)
    a, b = F.greatest(F.lit(0), start - width), F.least(F.length(text), end + width)
    inner = F.regexp_replace(F.substring(text, a + 1, b - a), S.java(r"^\s+|\s+$"), "")
    return F.concat(F.when(a > 0, "…").otherwise(""), inner, F.when(b < F.length(text), "…").otherwise(""))


def chosen(spans: Column, labels: list[str] | None = None, sources: list[str] | None = None) -> Column:
    keep = lambda s: (F.lit(True) if labels is None else s["label"].isin(labels)) & (F.lit(True) if sources is None else s["source"].isin(sources))
    return S.by_start(F.filter(spans, keep))


def placeholders_in(text: Column | str) -> Column:
    return F.regexp_extract_all(S.col(text), F.lit(PLACEHOLDER), F.lit(0))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.60, "medium").otherwise("low")


def distinct_sorted(spans: Column, field: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s[field])))
