"""Named-entity adapter and the filters behind it. A model yields ``array<struct<start,end,group,score>>``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions import spans as S
from veilwright.functions import wordlists as W
from veilwright.operators.gazetteer import is_institution

RAW = "array<struct<start:int,end:int,group:string,score:double>>"
#: Labels of the model's groups, and the least confidence per label behind the common floor.
GROUPS = {"PER": "Person", "LOC": "Location", "ORG": "Company"}
FLOOR = 0.70
FLOORS = {"Person": 0.65, "Company": 0.78, "Location": 0.70, "Title": 0.72, "Facility": 0.72}
_LETTER = "A-Za-z0-9ğüşıöçĞÜŞİÖÇ"
_LAW_TAIL = r"[\wçğışöşüÇĞİÖŞÜ'’]*"


def token_windows(text: Column | str, size: int = 384, overlap: int = 64) -> Column:
    """Windows over blank-separated tokens, each with the core it owns; the cores tile the text."""
    text = S.col(text)
    step, half = size - overlap, overlap // 2

    def tiled(words: Column) -> Column:
        n = F.size(words)
        firsts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i + overlap < n))
        place = lambda i, side: F.coalesce(F.get(words, i)[side], F.length(text))

        def window(i: Column) -> Column:
            last = i + size >= n
            return F.struct(
                F.when(i == 0, 0).otherwise(place(i, "start")).alias("win_start"),
                F.when(last, F.length(text)).otherwise(place(i + size - 1, "end")).alias("win_end"),
                F.when(i == 0, 0).otherwise(place(i + half, "start")).alias("core_start"),
                F.when(last, F.length(text)).otherwise(place(i + step + half, "start")).alias("core_end"),
            )

        return F.transform(firsts, window)

    return S.let(S.matches(text, S.java(r"\S+"), many=True), tiled)


def char_windows(text: Column | str, size: int = 900, overlap: int = 180) -> Column:
    """Windows over characters for models without token offsets."""
    n = F.length(S.col(text))
    step = size - overlap
    firsts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i + overlap < n))
    return F.transform(
        firsts,
        lambda i: F.struct(
            i.alias("win_start"),
            F.least(n, i + size).alias("win_end"),
            F.when(i == 0, 0).otherwise(i + overlap // 2).alias("core_start"),
            F.when(i + size >= n, n).otherwise(i + step + overlap // 2).alias("core_end"),
        ),
    )


def owned(entities: Column, window: Column) -> Column:
    """Entities, in text offsets, whose middle lies in the window's core."""
    return F.filter(entities, lambda e: F.floor((e["start"] + e["end"]) / 2).between(window["core_start"], window["core_end"] - 1))


def _entities(hits: Column, group: str, score: float) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(group).alias("group"), F.lit(score).alias("score")))


def dictionary_model(text: Column | str, entries: dict[str, str], score: float = 0.95) -> Column:
    """Deterministic stand-in for a model: every occurrence of a known surface, the longest first."""
    groups = []
    for group in sorted(set(entries.values())):
        surfaces = sorted((s for s, g in entries.items() if g == group), key=lambda s: (-len(s), s))
        pattern = "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in surfaces)
        groups.append(_entities(S.matches(text, pattern), group, score))
    return F.concat(*groups) if groups else F.array().cast(RAW)


def model_udf(load: Callable[[], Callable[[list[str]], list[list[tuple]]]]) -> Callable:
    """A real model behind an Arrow UDF. ``load`` runs once per worker; if it fails the detector finds nothing."""

    @F.pandas_udf(RAW)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # a missing model must not stop the other detectors
            model = None
        for texts in batches:
            found = model(texts.fillna("").tolist()) if model else [[] for _ in texts]
            yield pd.Series([[{"start": a, "end": b, "group": g, "score": s} for a, b, g, s in ents] for ents in found])

    return run


def model_source(chosen: str | None, folders: list[str], fallback: str) -> str:
    """Where a model comes from: the one that was chosen, else the first folder that exists, else the public name."""
    return chosen or next((f for f in folders if Path(f).exists()), fallback)


def _word_left(text: Column, at: Column) -> Column:
    """Letters of the word right before ``at``, however long it is."""
    return F.length(F.regexp_extract(F.substring(text, F.lit(1), at), rf"[{_LETTER}_]*\z", 0))


def _word_right(text: Column, at: Column) -> Column:
    return F.length(F.regexp_extract(F.substring(text, at + 1, F.length(text)), f"^[{_LETTER}_]*", 0))


def blocked(surface: Column) -> Column:
    """A generic term, as it is or as a known root with a suffix of at most five letters."""
    up = F.upper(F.regexp_replace(surface, S.java(r"^\s+|\s+$"), ""))
    listed = up.isin(W.BLOCKED) | F.regexp_replace(up, "\\.+$", "").isin(W.BLOCKED)
    rooted = reduce(lambda a, b: a | b, [up.startswith(r) & (F.length(up) - len(r) <= 5) for r in W.BLOCKED_ROOTS])
    return listed | (~up.contains(" ") & rooted)


def _loose(root: str) -> str:
    return "".join("[iıIİ]" if c == "I" else c for c in root)


_TAIL = S.java(rf"(?:[^{_LETTER}_]*(?<![{_LETTER}])(?:{'|'.join(map(_loose, W.GENERIC_TAILS))})[{_LETTER}]{{0,6}})+$", True)


def citation_zones(text: Column | str) -> Column:
    """Ranges of statute citations (fixed pattern): a number, 'sayılı' and a law's word."""
    return S.matches(text, S.java(rf"\b\d{{1,5}}\s+say[ıiİI]l[ıiİI]\s+[^\n.;:]{{0,100}}?{W.LAW_WORDS}{_LAW_TAIL}", True))


def filtered(text: Column | str, raw: Column) -> Column:
    """Spans left after all filters, in the model's order."""
    text = S.col(text)
    label = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    floor = F.create_map(*[F.lit(x) for kv in FLOORS.items() for x in kv])
    cut = lambda a, b: F.substring(text, a + 1, b - a)

    def entity(a: Column, b: Column, e: Column, trimmed: Column | None = None) -> Column:
        return F.struct(a.alias("start"), b.alias("end"), e["label"].alias("label"), e["score"].alias("score"), (F.lit(False) if trimmed is None else trimmed).alias("trimmed"))

    step = F.filter(raw, lambda e: label[e["group"]].isNotNull() & (e["score"] >= FLOOR))
    step = F.transform(step, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), label[e["group"]].alias("label"), e["score"].alias("score")))

    def apostrophe(e: Column) -> Column:
        s = cut(e["start"], e["end"])
        curly, straight = F.instr(s, "’"), F.instr(s, "'")
        at = F.when(curly > 1, curly).otherwise(straight)
        return entity(e["start"], F.when(at > 1, e["start"] + at - 1).otherwise(e["end"]).cast("int"), e)

    def snapped(e: Column) -> Column:
        inside_left = cut(e["start"], e["start"] + 1).rlike(f"[{_LETTER}_]")
        inside_right = cut(e["end"] - 1, e["end"]).rlike(f"[{_LETTER}_]")
        a = F.when(inside_left, e["start"] - _word_left(text, e["start"])).otherwise(e["start"])
        b = F.when(inside_right, e["end"] + _word_right(text, e["end"])).otherwise(e["end"])
        return entity(a.cast("int"), b.cast("int"), e)

    def untailed(e: Column) -> Column:
        s = cut(e["start"], e["end"])
        size = F.when(e["label"].isin("Company", "Facility"), F.length(F.regexp_extract(s, _TAIL, 0))).otherwise(0)
        return entity(e["start"], (e["end"] - size).cast("int"), e, size > 0)

    step = F.transform(F.transform(step, apostrophe), snapped)
    step = F.filter(step, lambda e: F.length(F.trim(cut(e["start"], e["end"]))) > 1)
    step = F.transform(step, untailed)
    in_span = S.java(rf"\b{W.LAW_WORDS}{_LAW_TAIL}", True)
    follows = S.java(rf"^{W.LAW_WORDS}{_LAW_TAIL}\b", True)

    def stays(e: Column, zones: Column) -> Column:
        s = cut(e["start"], e["end"])
        after = F.regexp_replace(F.substring(text, e["end"] + 1, F.lit(40)), S.java(r"^\s+"), "")
        legal = s.rlike(in_span)
        legal = legal | ((e["label"] == "Company") & ~e["trimmed"] & after.rlike(follows))
        legal = legal | F.exists(zones, lambda z: S.overlaps(e, z))
        number = F.regexp_replace(s, "[ \\-/.]", "").rlike("^[0-9]+$")
        short = e["label"].isin("Location", "Company") & (F.length(F.trim(s)) <= 3)
        return (F.length(F.trim(s)) > 1) & ~blocked(s) & ~legal & ~number & ~short & (e["score"] >= F.coalesce(floor[e["label"]], F.lit(FLOOR)))

    step = S.let(citation_zones(text), lambda zones: F.filter(step, lambda e: stays(e, zones)))
    return F.transform(step, lambda e: S.span(F.struct(e["start"].alias("start"), e["end"].alias("end"), cut(e["start"], e["end"]).alias("text")), e["label"], "ner", F.round(e["score"], 4)))


def windowed(df: DataFrame, key: str, text: str, model: Callable[[Column], Column], size: int = 384, overlap: int = 64) -> DataFrame:
    """Run ``model`` per token window and keep the entities each window owns: ``key, raw``."""
    w = df.select(key, text, F.explode(token_windows(text, size, overlap)).alias("w"))
    w = w.withColumn("part", F.substring(F.col(text), F.col("w.win_start") + 1, F.col("w.win_end") - F.col("w.win_start")))
    shift = lambda e: F.struct((e["start"] + F.col("w.win_start")).alias("start"), (e["end"] + F.col("w.win_start")).alias("end"), e["group"].alias("group"), e["score"].alias("score"))
    w = w.withColumn("raw", owned(F.transform(model(F.col("part")), shift), F.col("w")))
    return w.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("raw"))).alias("raw"))
