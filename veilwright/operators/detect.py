"""Pattern detector and overlap resolution, as expressions over one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.functions import spans as S
from veilwright.functions.registry import DOMINANT, PATTERNS, Pattern
from veilwright.functions.validators import VALIDATORS


def _spans_of(hits: Column, p: Pattern) -> Column:
    """Matches whose group is not empty and whose validator holds."""
    ok = (lambda h: (F.length(h["text"]) > 0) & VALIDATORS[p.validator](h["text"])) if p.validator else (lambda h: F.length(h["text"]) > 0)
    return F.transform(F.filter(hits, ok), lambda h: S.span(h, p.label, "regex", p.confidence))


def detect_one(text: Column | str, p: Pattern) -> Column:
    """Spans of one pattern."""
    found = _spans_of(S.matches(text, S.java(p.regex, p.ignore_case), p.group, many=True), p)
    return found if p.guard is None else F.when(S.col(text).rlike(S.java(p.guard, p.ignore_case)), found).otherwise(S.no_spans())


def _all(text: Column | str, patterns: list[Pattern]) -> Column:
    """Pieces of all patterns side by side, so that one expression gives the offsets of all."""

    def guarded(p: Pattern) -> Column:
        found = S.pieces(text, S.java(p.regex, p.ignore_case), p.group)
        return found if p.guard is None else F.when(S.col(text).rlike(S.java(p.guard, p.ignore_case)), found).otherwise(F.array().cast(S._PIECES))

    at = F.transform(F.array(*[guarded(p) for p in patterns]), S.placed)
    return S.let(at, lambda hits: F.concat(*[_spans_of(F.get(hits, F.lit(i)), p) for i, p in enumerate(patterns)]))


_built: dict[tuple, Column] = {}


def detect_all(text: Column | str, patterns: list[Pattern] = PATTERNS) -> Column:
    """Spans of all patterns in registry order, overlaps not resolved.

    Building the expression takes seconds, so it is kept per application and column name.
    """
    key = (SparkSession.active().sparkContext.applicationId, text, tuple(patterns)) if isinstance(text, str) else None
    if key not in _built or key is None:
        built = _all(text, patterns)
        if key is None:
            return built
        _built[key] = built
    return _built[key]


def without_overlaps(spans: Column) -> Column:
    """Longer spans first, then more confident ones, then registry order."""
    return S.greedy(spans, S.length, lambda s: s["confidence"])


def detect(text: Column | str, patterns: list[Pattern] = PATTERNS) -> Column:
    return without_overlaps(detect_all(text, patterns))


def merge(regex: Column, ner: Column, gazetteer: Column | None = None) -> Column:
    """One non-overlapping list out of three detectors, with canonical ids."""
    pool = F.concat(regex, ner, *([] if gazetteer is None else [gazetteer]))
    num = lambda c: c.cast("int")
    kept = S.greedy(
        pool,
        lambda s: num(s["source"] == "manual"),
        lambda s: num((s["source"] == "regex") & s["label"].isin(DOMINANT)),
        S.length,
        lambda s: s["confidence"],
        lambda s: num(s["source"].isin("regex", "gazetteer")),
    )
    return S.with_canonical_ids(kept)


def single(spans: Column) -> Column:
    """One detector alone: overlaps resolved, canonical ids given."""
    return S.with_canonical_ids(without_overlaps(spans))


def merge_manual(auto: Column, manual: Column) -> Column:
    """Manual spans replace every automatic span they touch. Manual spans that overlap each other are resolved."""

    def joined(kept: Column) -> Column:
        free = F.filter(auto, lambda a: ~F.exists(kept, lambda m: S.overlaps(a, m)))
        return S.by_start(F.concat(free, kept))

    return S.let(without_overlaps(manual), joined)


def explode_spans(df: DataFrame, keys: list[str], spans: Column | str = "spans") -> DataFrame:
    """One row per span with its place in the list.

    The outer form keeps the optimizer from copying the whole expression of the spans into a filter below it.
    """
    rows = df.select(*keys, F.posexplode_outer(S.col(spans)).alias("seq", "s")).where("s is not null")
    return rows.select(*keys, "seq", "s.*")
