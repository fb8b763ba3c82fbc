"""Column functions over a text and its arrays of spans. Offsets are 0-based code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "array<struct<start:int,end:int,text:string>>"
SPAN = "struct<start:int,end:int,label:string,source:string,confidence:double,text:string,canonical_id:string>"
SPANS = f"array<{SPAN}>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java(pattern: str, ignore_case: bool = False) -> str:
    """Unicode classes and, if asked, Unicode case folding."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` refers to it, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


BLOCK = 256


def blocks(values: Column) -> Column:
    """An array cut into blocks of :data:`BLOCK` elements."""
    return let(values, lambda v: F.transform(F.filter(F.sequence(F.lit(0), F.size(v), F.lit(BLOCK)), lambda b: b < F.size(v)), lambda b: F.slice(v, b + 1, F.lit(BLOCK))))


def folded(values: Column, kind: str, step) -> Column:
    """Outputs of a running fold: ``step(pos, x)`` gives the next position and the output of ``x``, a ``kind``.

    Outputs are gathered block by block, so the work grows with the array and not with its square.
    """
    state = f"struct<pos:int,out:array<{kind}>>"

    def inner(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["pos"], x)[0].cast("int").alias("pos"), F.array_append(acc["out"], step(acc["pos"], x)[1]).alias("out"))

    def outer(acc: Column, xs: Column) -> Column:
        start = F.struct(F.coalesce(F.get(acc, F.size(acc) - 1)["pos"], F.lit(0)).alias("pos"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.array_append(acc, F.aggregate(xs, start, inner))

    return F.aggregate(blocks(values), F.array().cast(f"array<{state}>"), outer, lambda acc: F.flatten(F.transform(acc, lambda a: a["out"])))


def before(values: Column, largest: bool = False) -> Column:
    """For each value of an integer array the sum of those before it, or the largest of them (zero for the first)."""
    return folded(values, "int", lambda pos, v: (F.greatest(pos, v) if largest else pos + v, pos))


_PIECES = "array<struct<w:string,t:string,gap:string>>"


def pieces(text: Column | str, pattern: str | Column, group: int = 0) -> Column:
    """Each match ``w``, its group ``t`` and the ``gap`` before it. The second regex pass is only made where the first found something."""
    text, pat = col(text), F.lit(pattern) if isinstance(pattern, str) else pattern

    def zipped(whole: Column) -> Column:
        taken = whole if group == 0 else F.regexp_extract_all(text, pat, F.lit(group))
        gaps = F.slice(F.split(text, pat, -1), F.lit(1), F.size(whole))
        return F.when(F.size(whole) > 0, F.arrays_zip(whole.alias("w"), taken.alias("t"), gaps.alias("gap"))).otherwise(F.array().cast(_PIECES))

    return let(F.regexp_extract_all(text, pat, F.lit(0)), zipped)


def _step(pos: Column, z: Column) -> tuple[Column, Column]:
    end = pos + F.length(z["gap"]) + F.length(z["w"])
    return end, F.struct((end - F.length(z["t"])).alias("start"), end.alias("end"), z["t"].alias("text"))


def placed(found: Column) -> Column:
    """Matches with their offsets: running lengths of pieces and matches. Linear in the number of matches."""
    return folded(found, "struct<start:int,end:int,text:string>", _step)


def matches(text: Column | str, pattern: str | Column, group: int = 0, many: bool = False) -> Column:
    """All matches with their offsets. A capture group must end its match (look-aheads may follow).

    ``many`` is for patterns that match all over a text; it costs a larger expression.
    """
    found = pieces(text, pattern, group)
    if many:
        return placed(found)
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(HIT).alias("out"))
    step = lambda acc, z: F.struct(_step(acc["pos"], z)[0].alias("pos"), F.array_append(acc["out"], _step(acc["pos"], z)[1]).alias("out"))
    return F.aggregate(found, zero, step, lambda acc: acc["out"])


def literal(value: Column) -> Column:
    """Regex that matches exactly ``value``."""
    return F.concat(F.lit("\\Q"), F.regexp_replace(value, F.lit("\\\\E"), F.lit("\\\\E\\\\\\\\E\\\\Q")), F.lit("\\E"))


def span(hit: Column, label: Column | str, source: str, confidence: Column | float, canonical_id: Column | None = None) -> Column:
    lab = F.lit(label) if isinstance(label, str) else label
    conf = F.lit(float(confidence)) if isinstance(confidence, (int, float)) else confidence
    cid = F.lit(None).cast("string") if canonical_id is None else canonical_id
    return F.struct(hit["start"].alias("start"), hit["end"].alias("end"), lab.alias("label"), F.lit(source).alias("source"), conf.cast("double").alias("confidence"), hit["text"].alias("text"), cid.alias("canonical_id"))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def by_start(spans: Column) -> Column:
    """Spans in reading order; equal starts keep their order."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), i.alias("b"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def greedy(spans: Column, *priority) -> Column:
    """Non-overlapping spans: by ``priority`` (functions of a span, larger first, null last), ties in input order.

    Spans that do not touch cannot keep each other out, so the choice is made inside islands of touching spans.
    """

    def keyed(s: Column, i: Column) -> Column:
        key = F.struct(*[F.coalesce((-p(s)).cast("double"), F.lit(1e308)).alias(f"k{n}") for n, p in enumerate(priority)], i.alias("i"))
        return F.struct(s["start"].alias("a"), i.alias("b"), key.alias("key"), s.alias("s"))

    def chosen(island: Column) -> Column:
        ranked = F.array_sort(F.transform(island, lambda k: F.struct(k["key"].alias("key"), k["s"].alias("s"))))
        kept = F.aggregate(ranked, no_spans(), lambda acc, k: F.when(F.exists(acc, lambda x: overlaps(x, k["s"])), acc).otherwise(F.array_append(acc, k["s"])))
        return F.when(F.size(island) == 1, F.transform(island, lambda k: k["s"])).otherwise(by_start(kept))

    def split(ordered: Column) -> Column:
        """Islands of spans in order of their starts."""

        def at(ends: Column) -> Column:
            firsts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: F.get(ordered, i)["a"] >= F.get(ends, i))
            return let(firsts, lambda f: F.transform(f, lambda i, n: F.slice(ordered, i + 1, F.coalesce(F.get(f, n + 1), F.size(ordered)) - i)))

        return let(before(F.transform(ordered, lambda k: k["s"]["end"]), largest=True), at)

    ordered = F.array_sort(F.transform(spans, keyed))
    return F.when(F.size(spans) > 0, F.flatten(F.transform(let(ordered, split), chosen))).when(spans.isNotNull(), no_spans())


def length(s: Column) -> Column:
    return s["end"] - s["start"]


def fold_tr(c: Column) -> Column:
    """Upper case with the dotted capital I made plain."""
    return F.replace(F.upper(c), F.lit("İ"), F.lit("I"))


def fold_ascii(c: Column) -> Column:
    """Upper case without Turkish letters."""
    return F.upper(F.translate(c, "çÇğĞıİöÖşŞüÜ", "cCgGiIoOsSuU"))


def canonical_id(label: Column, text: Column) -> Column:
    """Label and lower-case text with single blanks."""
    words = F.filter(F.split(F.lower(text), java(r"\s+"), -1), lambda w: w != "")
    return F.concat(label, F.lit("::"), F.array_join(words, " "))


def with_canonical_ids(spans: Column) -> Column:
    return F.transform(spans, lambda s: s.withField("canonical_id", F.coalesce(s["canonical_id"], canonical_id(s["label"], s["text"]))))
