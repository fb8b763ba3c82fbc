"""The masking plan: detectors, exclusions, coreference, merge, policy, placeholders, mapping, restoration.

Everything is an expression over one row, so the same plan runs on a batch and on a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.functions import spans as S
from veilwright.functions.registry import PATTERNS
from veilwright.operators import detect, gazetteer, ner

ENGINE_VERSION = "0.6.1"
_Q = "[\"'«»“”‘’]"
_TERM = "[^\"'«»“”‘’\\n]"
_SMALL_CAP = "[A-ZÇĞİÖŞÜ][a-zçğışöşü]{1,30}"
#: Clauses by which contracts define a short name; group 1 is the name.
_ALIAS = [
    (rf"bundan\s+böyle\s+{_Q}({_TERM}{{1,60}})(?={_Q}\s+olarak\s+anıl)"),
    (rf"kısaca\s+{_Q}({_TERM}{{1,60}})(?={_Q})"),
    (rf"{_Q}({_TERM}{{1,60}})(?={_Q}\s+olarak\s+anıl)"),
    (rf"hereinafter(?:\s+referred\s+to\s+as)?\s+{_Q}({_TERM}{{1,60}})(?={_Q})"),
    (rf"bundan\s+böyle\s+({_SMALL_CAP})(?=\s+olarak\s+anıl)"),
    (rf"\(\s*{_Q}({_TERM}{{1,40}})(?={_Q}\s*\))"),
]
_BODY_LABELS = ("Company", "Location", "Facility")
_ENTITY_LABELS = ("Person", "Company", "Facility")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, S.java(r"^\s+|\s+$"), "")


def aliases(text: Column | str) -> Column:
    """Upper-case short names that the document defines."""
    found = F.flatten(F.array(*[F.regexp_extract_all(S.col(text), F.lit(S.java(p, True)), F.lit(1)) for p in _ALIAS]))
    return F.array_distinct(F.filter(F.transform(found, lambda a: F.upper(_strip(a))), lambda a: a != ""))


def term_excluded(surface: Column, names: Column) -> Column:
    return ner.blocked(surface) | F.array_contains(names, F.upper(_strip(surface)))


def not_excluded(spans: Column, names: Column) -> Column:
    """Automatic spans without blocked terms, the document's short names and public bodies."""
    body = lambda s: s["label"].isin(*_BODY_LABELS) & gazetteer.is_institution(s["text"])
    return S.let(names, lambda known: F.filter(spans, lambda s: ~(term_excluded(s["text"], known) | body(s))))


def occurrences(text: Column | str, surface: Column) -> Column:
    """Every non-overlapping occurrence of a literal, case-sensitive."""
    return S.matches(text, S.literal(surface))


def manual(text: Column | str, wanted: Column, first_word_key: bool = False) -> Column:
    """Spans of the user's terms ``array<struct<text,label>>``; blank terms give nothing.

    ``first_word_key`` groups terms that share their first word, as the documented behaviour does.
    """

    def each(w: Column) -> Column:
        words = F.filter(F.split(F.lower(w["text"]), S.java(r"\s+"), -1), lambda x: x != "")
        key = F.concat(w["label"], F.lit("::"), F.get(words, F.lit(0)) if first_word_key else F.array_join(words, " "))
        return F.when(_strip(w["text"]) != "", F.transform(occurrences(text, w["text"]), lambda h: S.span(h, w["label"], "manual", 1.0, key))).otherwise(S.no_spans())

    return F.coalesce(F.flatten(F.transform(wanted, each)), S.no_spans())


def expand(text: Column | str, spans: Column, names: Column) -> Column:
    """Model spans and every further verbatim occurrence of a confident person, company or facility."""

    def anchors(own: Column, known: Column) -> Column:
        good = F.filter(own, lambda s: s["label"].isin(*_ENTITY_LABELS) & (s["confidence"] >= 0.82) & (F.length(_strip(s["text"])) >= 4) & ~term_excluded(s["text"], known))
        return F.transform(good, lambda s, i: F.struct((-s["confidence"]).alias("c"), i.alias("i"), s["label"].alias("label"), _strip(s["text"]).alias("text")))

    def best(anchor: Column) -> Column:
        return F.filter(anchor, lambda a: ~F.exists(anchor, lambda b: (F.lower(b["text"]) == F.lower(a["text"])) & (F.struct(b["c"], b["i"]) < F.struct(a["c"], a["i"]))))

    def grown(own: Column) -> Column:
        chosen = S.let(S.let(names, lambda known: anchors(own, known)), best)
        more = F.flatten(F.transform(chosen, lambda a: F.transform(occurrences(text, a["text"]), lambda h: S.span(h, a["label"], "ner", F.round(-a["c"] * 0.95, 4)))))
        return F.concat(own, F.filter(more, lambda m: ~F.exists(own, lambda s: (s["start"] == m["start"]) & (s["end"] == m["end"]))))

    return S.let(spans, grown)


# -- grouping of names (off by default)


def entity_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit("[A-ZÇĞİÖŞÜa-zçğışöşü0-9]+"), F.lit(0)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller token set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def _related(a: Column, b: Column, threshold: float) -> Column:
    both_single = (F.size(a) == 1) & (F.size(b) == 1)
    return F.when(both_single, F.get(a, F.lit(0)) == F.get(b, F.lit(0))).otherwise(overlap_coefficient(a, b) >= threshold)


_COMPONENTS = "array<struct<label:string,members:array<array<string>>,best:struct<n:int,id:string>>>"


def fuzzy_groups(spans: Column, threshold: float = 0.5) -> Column:
    """Spans of one label whose token sets overlap, directly or through others, get the id of the longest text among them.

    Names are added one by one to the components found so far; a name joins all those that it overlaps into one, so
    chains of any length are one group. Names without a token stay alone.
    """

    def eligible(s: Column) -> Column:
        return s["label"].isin(*_ENTITY_LABELS) & (s["source"] != "manual")

    def name(s: Column) -> Column:
        best = F.struct(F.length(s["canonical_id"]).alias("n"), s["canonical_id"].alias("id"))
        return F.struct(s["label"].alias("label"), entity_tokens(s["text"]).alias("tokens"), best.alias("best"))

    def step(acc: Column, e: Column) -> Column:
        touches = lambda c: (c["label"] == e["label"]) & F.exists(c["members"], lambda t: _related(t, e["tokens"], threshold))

        def joined(hit: Column) -> Column:
            members = F.array_append(F.flatten(F.transform(hit, lambda c: c["members"])), e["tokens"])
            best = F.array_max(F.array_append(F.transform(hit, lambda c: c["best"]), e["best"]))
            return F.struct(e["label"].alias("label"), members.alias("members"), best.alias("best"))

        return F.array_append(F.filter(acc, lambda c: ~touches(c)), S.let(F.filter(acc, touches), joined))

    def grouped(own: Column) -> Column:
        names = F.array_distinct(F.filter(F.transform(F.filter(own, eligible), name), lambda e: F.size(e["tokens"]) > 0))
        components = F.aggregate(names, F.array().cast(_COMPONENTS), step)

        def group_id(s: Column, known: Column) -> Column:
            mine = lambda t: F.filter(known, lambda c: (c["label"] == s["label"]) & F.array_contains(c["members"], t))
            return F.coalesce(F.get(S.let(entity_tokens(s["text"]), mine), F.lit(0))["best"]["id"], s["canonical_id"])

        return S.let(components, lambda known: F.transform(own, lambda s: F.when(eligible(s), s.withField("canonical_id", group_id(s, known))).otherwise(s)))

    return S.let(S.with_canonical_ids(spans), grouped)


def definers(text: Column | str, spans: Column, reach: int = 250) -> Column:
    """For each short-name clause the automatic entity that ends last before it, at most ``reach`` characters away."""
    clauses = S.matches(text, S.java(rf"\(bundan\s+böyle\s+{_Q}({_TERM}{{1,80}})(?={_Q}\s+olarak\s+anıl)", True), 1)
    starts = S.matches(text, S.java(rf"\(bundan\s+böyle\s+(?={_Q}{_TERM}{{1,80}}{_Q}\s+olarak\s+anıl)", True))

    def definer(c: Column, at: Column) -> Column:
        near = F.filter(spans, lambda s: s["label"].isin(*_ENTITY_LABELS) & (s["source"] != "manual") & (s["end"] <= at) & (at - s["end"] <= reach))
        last = F.array_max(F.transform(near, lambda s: F.struct(s["end"].alias("end"), (-s["start"]).alias("k"), s["text"].alias("text"), s["label"].alias("label"))))
        return F.struct(_strip(c["text"]).alias("alias"), at.alias("clause_start"), last["text"].alias("definer"), last["label"].alias("label"), (-last["k"]).alias("start"), last["end"].alias("end"))

    return F.transform(F.arrays_zip(clauses.alias("c"), starts.alias("s")), lambda z: definer(z["c"], z["s"]["start"]))


def alias_links(text: Column | str, spans: Column, threshold: float = 0.5) -> Column:
    """Spans without an id that a clause's short names name get the id of the longest text among them and their definer.

    A clause may define several names, separated by strokes, commas or words for and/or; blocked terms name nothing.
    """

    def step(acc: Column, d: Column) -> Column:
        parts = F.transform(F.split(d["alias"], S.java(r"[/,]|\s+(?:ve|veya|ya da)\s+"), -1), _strip)
        parts = F.filter(parts, lambda a: (F.length(a) > 1) & ~ner.blocked(a) & (F.size(entity_tokens(a)) > 0))
        is_definer = lambda s: (s["start"] == d["start"]) & (s["end"] == d["end"])

        def linked(tokens: Column) -> Column:
            named = lambda s: ~is_definer(s) & (s["source"] != "manual") & (s["label"] == d["label"]) & F.exists(tokens, lambda t: overlap_coefficient(entity_tokens(s["text"]), t) >= threshold)
            longest = F.array_max(F.transform(F.filter(acc, lambda s: is_definer(s) | named(s)), lambda s: F.struct(F.length(s["text"]).alias("n"), (-s["start"]).alias("k"), s["text"].alias("t"))))["t"]
            cid = F.concat(d["label"], F.lit("::"), F.lower(longest))
            given = F.transform(acc, lambda s: F.when(s["canonical_id"].isNull() & (is_definer(s) | named(s)), s.withField("canonical_id", cid)).otherwise(s))
            return F.when(F.exists(acc, named), given).otherwise(acc)

        return F.when(d["definer"].isNull(), acc).otherwise(S.let(F.transform(parts, entity_tokens), linked))

    return S.let(spans, lambda own: F.aggregate(definers(text, own), own, step))


def without_automatic_ids(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.when(s["source"] == "manual", s).otherwise(s.withField("canonical_id", F.lit(None).cast("string"))))


# -- placeholders


def apply_policy(spans: Column, disabled: list[str]) -> Column:
    """Spans that are masked: manual ones and those whose label is not disabled."""
    return F.filter(spans, lambda s: (s["source"] == "manual") | ~s["label"].isin(disabled)) if disabled else spans


def _heads(ordered: Column, same: str) -> Column:
    """Elements of a sorted array that differ in field ``same`` from the one before."""
    return S.let(ordered, lambda o: F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)[same] != x[same])))


def numbered(spans: Column) -> Column:
    """``array<struct<start,end,text,placeholder>>`` in reading order, numbered per label by first occurrence.

    Ids meet by sorting, not by looking each one up, so a document with very many spans stays feasible.
    """
    ordered = F.transform(S.by_start(spans), lambda s: s.withField("canonical_id", F.coalesce(s["canonical_id"], F.concat(s["label"], F.lit("::"), s["text"]))))

    def by_id(own: Column) -> Column:
        """``id, i`` and the number ``d`` of the id among the sorted ids."""
        entries = F.array_sort(F.transform(own, lambda s, i: F.struct(s["canonical_id"].alias("id"), i.alias("i"))))
        fresh = lambda e: F.transform(e, lambda x, i: F.when((i > 0) & (F.get(e, i - 1)["id"] == x["id"]), 0).otherwise(1))
        with_d = lambda e: S.let(fresh(e), lambda f: F.transform(F.arrays_zip(e.alias("e"), f.alias("f"), S.before(f).alias("b")), lambda z: F.struct(z["e"]["id"].alias("id"), z["e"]["i"].alias("i"), (z["b"] + z["f"] - 1).alias("d"))))
        return S.let(entries, with_d)

    def names(own: Column, entries: Column) -> Column:
        """Placeholder of each id, in the order of ``d``."""
        firsts = F.array_sort(F.transform(_heads(entries, "d"), lambda h: F.struct(F.get(own, h["i"])["label"].alias("label"), h["i"].alias("i"), h["d"].alias("d"))))

        def counted(f: Column) -> Column:
            opens = F.transform(f, lambda x, n: F.when((n > 0) & (F.get(f, n - 1)["label"] == x["label"]), 0).otherwise(n))
            placed = S.let(opens, lambda o: F.arrays_zip(f.alias("x"), o.alias("o"), S.before(o, largest=True).alias("b")))
            name = lambda z, n: F.concat(F.lit("{"), z["x"]["label"], F.lit("_"), (n - F.greatest(z["o"].cast("long"), z["b"]) + 1).cast("string"), F.lit("}"))
            return F.array_sort(F.transform(placed, lambda z, n: F.struct(z["x"]["d"].alias("d"), name(z, n).alias("name"))))

        return S.let(firsts, counted)

    def marked(own: Column) -> Column:
        def given(entries: Column) -> Column:
            back = lambda ns: F.array_sort(F.transform(entries, lambda e: F.struct(e["i"].alias("i"), F.get(ns, e["d"].cast("int"))["name"].alias("name"))))
            return S.let(names(own, entries), back)

        mark = lambda z: F.struct(z["s"]["start"].alias("start"), z["s"]["end"].alias("end"), z["s"]["text"].alias("text"), z["p"]["name"].alias("placeholder"))
        return F.transform(F.arrays_zip(own.alias("s"), S.let(by_id(own), given).alias("p")), mark)

    return S.let(ordered, marked)


def substituted(text: Column | str, marks: Column, block: int = 256) -> Column:
    """The text with each mark's place taken by its placeholder. Pieces are cut out of blocks of the text and joined once."""
    text = S.col(text)

    def piece(part: Column, first: Column):
        return lambda m: F.concat(F.substring(part, m["gap"] - first + 1, m["start"] - m["gap"]), m["placeholder"])

    def of_block(ms: Column) -> Column:
        first, last = F.get(ms, F.lit(0))["gap"], F.element_at(ms, -1)["end"]
        return S.let(F.substring(text, first + 1, last - first), lambda part: F.array_join(F.transform(ms, piece(part, first)), ""))

    def with_gaps(ms: Column) -> Column:
        gap = lambda i: F.when(i > 0, F.get(ms, i - 1)["end"]).otherwise(0)
        return F.transform(ms, lambda m, i: F.struct(gap(i).alias("gap"), m["start"].alias("start"), m["end"].alias("end"), m["placeholder"].alias("placeholder")))

    def joined(ms: Column) -> Column:
        blocks = F.transform(F.filter(F.sequence(F.lit(0), F.size(ms), F.lit(block)), lambda b: b < F.size(ms)), lambda b: S.let(F.slice(ms, b + 1, F.lit(block)), of_block))
        tail = F.substring(text, F.element_at(ms, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(blocks, ""), tail)

    return S.let(marks, lambda own: F.when(F.size(own) == 0, text).otherwise(S.let(with_gaps(own), joined)))


def mapping(marks: Column) -> Column:
    """Placeholder to its longest surface; the first of equally long ones."""
    ranked = F.array_sort(F.transform(marks, lambda m: F.struct(m["placeholder"].alias("p"), (-F.length(m["text"])).alias("n"), m["start"].alias("k"), m["text"].alias("t"))))
    return F.map_from_entries(F.transform(_heads(ranked, "p"), lambda h: F.struct(h["p"], h["t"])))


def unmask(masked: Column | str, known: Column) -> Column:
    """Known placeholders replaced in one pass; unknown ones and everything else stay."""
    masked = S.col(masked)
    token = r"\{[^{}\n]+_\d+\}"
    pairs = F.arrays_zip(F.split(masked, token, -1).alias("gap"), F.regexp_extract_all(masked, F.lit(token), F.lit(0)).alias("token"))
    name = lambda p: F.coalesce(p["token"], F.lit(""))
    parts = S.let(known, lambda k: F.transform(pairs, lambda p: F.concat(p["gap"], F.coalesce(F.try_element_at(k, name(p)), name(p)))))
    return F.when(known.isNull() | (F.size(known) == 0), masked).otherwise(F.array_join(parts, ""))


@dataclass
class Settings:
    """What a run does: ``mode`` is ``full``, ``regex`` or ``ner``."""

    mode: str = "full"
    entries: dict[str, str] = field(default_factory=dict)
    disabled: list[str] = field(default_factory=list)
    manual: str | None = None
    fuzzy: bool = False
    alias_links: bool = False
    first_word_key: bool = False


def mask(df: DataFrame, text: str = "text", settings: Settings | None = None, raw: str | None = None) -> DataFrame:
    """``df`` with ``spans``, ``masked_text`` and ``mapping``. ``raw`` names a column of model output, if there is one.

    A null text gives nulls. All detectors are computed in one pass over the table; no row leaves its partition.
    """
    s = settings or Settings()
    if s.mode not in ("full", "regex", "ner"):
        raise ValueError(f"unknown mode {s.mode}")
    t = F.col(text)
    names = F.col("_names")
    found = {"_names": aliases(t)}
    if s.mode != "ner":
        found["_regex"] = detect.detect(text, PATTERNS)
    if s.mode != "regex":
        found["_model"] = ner.filtered(t, F.col(raw) if raw else ner.dictionary_model(t, s.entries))
    if s.mode == "full":
        found["_gaz"] = gazetteer.detect(t)
    out = df.withColumns(found)  # a few steps: each keeps the expressions that are analysed together small
    if s.mode != "regex":
        out = out.withColumn("_model", not_excluded(F.col("_model"), names))
        out = out.withColumn("_model", F.when(F.size("_model") > 0, expand(t, F.col("_model"), names)).otherwise(F.col("_model")))
    if s.mode == "full":
        out = out.withColumn("_auto", detect.merge(F.col("_regex"), F.col("_model"), not_excluded(F.col("_gaz"), names)))
    else:
        out = out.withColumn("_auto", detect.single(F.col("_regex") if s.mode == "regex" else F.col("_model")))
    if s.manual:
        out = out.withColumn("_auto", detect.merge_manual(F.col("_auto"), manual(t, F.col(s.manual), s.first_word_key)))
    if s.alias_links:
        out = out.withColumn("_auto", S.with_canonical_ids(alias_links(t, without_automatic_ids(F.col("_auto")))))
    out = out.withColumn("spans", fuzzy_groups(F.col("_auto")) if s.fuzzy else F.col("_auto"))
    out = out.withColumn("_marks", numbered(apply_policy(F.col("spans"), s.disabled)))
    out = out.withColumns({"masked_text": F.when(t.isNotNull(), substituted(t, F.col("_marks"))), "mapping": mapping(F.col("_marks"))})
    return out.drop("_names", "_regex", "_model", "_gaz", "_auto", "_marks")
