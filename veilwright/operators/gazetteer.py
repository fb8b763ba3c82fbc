"""Dictionary detector: companies by legal form, persons by first name, places by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwright.functions import spans as S
from veilwright.functions import wordlists as W

_CAP, _SMALL, _ANY = "[A-ZÇĞİÖŞÜ]", "[a-zçğışöşü]", "[A-Za-zÇĞİÖŞÜçğışöşü]"
_TOKEN = f"(?:{_CAP}{_SMALL}+|{_CAP}{{2,}})"
_AS = r"A\.?\s?Ş\.?"
_LEGAL = rf"(?:{_AS}|Ltd\.?\s?Şti\.?|San\.?\s?ve\s?Tic\.?(?:\s?{_AS})?|T\.?{_AS}|A\.?\s?O\.?|Holding(?:\s+{_AS})?)"
_COMPANY = rf"\b(?:{_CAP}\.\s*)?{_TOKEN}(?:\s+(?:{_TOKEN}|ve))*\s+{_LEGAL}(?!{_ANY})"
_TITLE = f"{_CAP}{_SMALL}+"


def is_institution(text: Column) -> Column:
    """A public body: one of four phrases, or a last word that starts with a known root."""
    folded = S.fold_ascii(F.regexp_replace(text, S.java(r"^\s+|\s+$"), ""))
    last = F.regexp_extract(folded, "[A-Z0-9]+$", 0)
    phrase = [folded.contains(p) for p in W.INSTITUTION_PHRASES]
    root = [last.startswith(r) for r in W.INSTITUTION_ROOTS]
    out = phrase[0]
    for c in phrase[1:] + root:
        out = out | c
    return out


def companies(text: Column | str) -> Column:
    hits = S.matches(text, S.java(_COMPANY))
    return F.transform(F.filter(hits, lambda h: ~is_institution(h["text"])), lambda h: S.span(h, "Company", "gazetteer", 0.90))


def persons(text: Column | str) -> Column:
    """A known first name and the capitalised word right behind it."""
    text = S.col(text)

    def joined(p: Column) -> Column:
        gap = F.substring(text, p["a"]["end"] + 1, p["b"]["start"] - p["a"]["end"])
        return p["a"]["text"].isin(W.FIRST_NAMES) & gap.rlike("^[ \\t]+$") & ~p["b"]["text"].isin(W.NOT_SURNAMES)

    def whole(p: Column) -> Column:
        hit = F.struct(p["a"]["start"].alias("start"), p["b"]["end"].alias("end"), F.substring(text, p["a"]["start"] + 1, p["b"]["end"] - p["a"]["start"]).alias("text"))
        return S.span(hit, "Person", "gazetteer", 0.80)

    def paired(words: Column) -> Column:
        size = F.size(words)
        pairs = F.arrays_zip(F.slice(words, F.lit(1), size - 1).alias("a"), F.slice(words, F.lit(2), size - 1).alias("b"))
        return F.when(size > 1, F.transform(F.filter(pairs, joined), whole)).otherwise(S.no_spans())

    return S.let(S.matches(text, S.java(_TITLE), many=True), paired)


def places(text: Column | str, ahead: int = 45) -> Column:
    """A known province or district, unless a public body's word begins within the next ``ahead`` characters."""
    text = S.col(text)
    body = S.java(r"\b(?:" + "|".join(W.BODIES_AHEAD) + ")", True)
    hits = S.matches(text, S.java(r"\b" + _TITLE), many=True)
    known = F.filter(hits, lambda h: h["text"].isin(W.PROVINCES + W.DISTRICTS) & ~F.substring(text, h["end"] + 1, ahead).rlike(body))
    return F.transform(known, lambda h: S.span(h, "Location", "gazetteer", 0.85))


def detect(text: Column | str) -> Column:
    return F.concat(companies(text), persons(text), places(text))
