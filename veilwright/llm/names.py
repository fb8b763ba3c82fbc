"""Variant spellings of persons and companies, linked by suffix blocking.

1. Texts are brought to one form (see :mod:`veilwright.llm.lookalike`) and parsed: titles, nicknames in quotes,
   initials, order and legal forms are recognised. What remains is a *core* (surname or company word) and a *part*
   (given names or trade).
2. Within one core, parts are resolved: equal parts, initials and nicknames with one possible owner, a second given
   name used alone, one typing error. Parts that contradict each other stay apart, so relatives with one surname and
   companies with one first word in different trades are different entities. A group here holds distinct parts of
   one core, not rows, so a hot name costs no more than a rare one.
3. Across cores, token suffixes are indexed, of the core read forwards and backwards. Two cores of ``l`` or ``l + 1``
   letters that are one typing error apart share a suffix of ``(l - 2) // 2`` letters in one of the directions, so each
   core stands under the suffixes of that length only, if it is at least ``min_suffix``. A suffix with more than
   ``common`` cores is not discarded but refined with the rest of the core, one letter of it left out in turn; cores
   too short for a suffix stand under their own such forms. So no pair is lost and no key is crowded. Pairs of cores that
   share a key are compared by the ratio of their longest common subsequence, which may miss one letter.
4. Clusters of two such cores are linked if their parts agree: equal parts always, an initial or a missing trade only
   if the rarer cluster has no other link. Of cores with at most ``short`` letters one must name one entity only, as a
   surname that many given names go with is no error. Linked clusters form one entity.

Defined results: null and blank texts have no entity; equal texts are one spelling; a text without letters is an
entity of its own; other labels are ignored; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm import lookalike, pii
from veilwright.runtime import cut, release, spread

#: Titles and forms of address before a name.
TITLES = set("dr prof doc av sn sayin bay bayan uzm op yrd ogr gor muh mim mr mrs ms miss herr frau ing".split())
#: Words that say what a company trades in, and their usual abbreviations.
TRADES = "teknoloji turizm tekstil otomotiv yazilim insaat madencilik enerji lojistik saglik gida danismanlik kimya tarim egitim medya reklam mobilya makine elektronik elektrik plastik metal cam kagit ilac nakliyat denizcilik havacilik sigorta finans guvenlik temizlik emlak bilisim ambalaj matbaa mermer orman su"
ABBREVIATIONS = "tek:teknoloji tekn:teknoloji tur:turizm teks:tekstil tks:tekstil oto:otomotiv yaz:yazilim yzl:yazilim ins:insaat mad:madencilik enj:enerji ener:enerji loj:lojistik sag:saglik gd:gida dans:danismanlik dan:danismanlik kim:kimya tar:tarim mob:mobilya mak:makine elek:elektronik"
#: Words of a company's name that do not tell companies apart.
FORMS = "sanayi san ve ticaret tic dis pazarlama paz grubu grup hizmetleri hizmet hiz holding sirketi sirket sti anonim limited ltd as a s isletmeleri ithalat ihracat ith ihr"

_TRADE = {t: t for t in TRADES.split()} | dict(x.split(":") for x in ABBREVIATIONS.split())
_FORM = set(FORMS.split())
_LONG_FORMS = {w for w in _FORM if len(w) > 4}
_GIVEN = set(pii._GENDER)
PARSED = "label string, text string, core string, part string, part2 string, legal string, nick string, form string"


def one_error(a: str, b: str) -> bool:
    """Equal, or one letter dropped, added, changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of the lengths, by bit-parallel rows."""
    if not a or not b:
        return float(a == b)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        where[c] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where[c]
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def one_left_out(word: str) -> set[str]:
    """The word and every form of it without one letter: words one error apart have one in common."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class _Index:
    """Known words in order, found by one error or by a common subsequence without comparing all."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.forms: dict[str, list[int]] = defaultdict(list)
        self.pairs: dict[str, list[int]] = defaultdict(list)
        self.heads: dict[str, list[int]] = defaultdict(list)

    def add(self, word: str) -> None:
        n = len(self.words)
        self.words.append(word)
        for f in one_left_out(word):
            self.forms[f].append(n)
        for i in range(len(word) - 1):
            self.pairs[word[i : i + 2]].append(n)
        self.heads[word[:2]].append(n)

    def error(self, word: str) -> str | None:
        """The first word that is one error away."""
        met = {n for f in one_left_out(word) for n in self.forms.get(f, ())}
        return next((self.words[n] for n in sorted(met) if one_error(word, self.words[n])), None)

    def alike(self, word: str, ratio: float = 0.8) -> str | None:
        """The first word with that LCS ratio; such words of four letters or more share two neighbouring letters."""
        met = {n for i in range(len(word) - 1) for n in self.pairs.get(word[i : i + 2], ())}
        return next((self.words[n] for n in sorted(met) if lcs_ratio(word, self.words[n]) >= ratio), None)

    def head(self, word: str) -> str | None:
        """The only word with the longest common beginning, of two letters or more."""
        common = [(_prefix(word, self.words[n]), self.words[n]) for n in self.heads.get(word[:2], ())]
        best = max((k for k, _ in common), default=0)
        fits = [w for k, w in common if k == best]
        return fits[0] if best >= 2 and len(fits) == 1 else None


def _near(word: str, known: set[str] | dict) -> str | None:
    """The known word that ``word`` is, or is one error from (the first in order)."""
    if word in known:
        return word
    if len(word) < 4:
        return None
    return min((k for k in known if len(k) > 3 and one_error(word, k)), default=None)


_near_cache: dict[tuple[str, str], str | None] = {}


def near_given(word: str) -> str | None:
    if ("g", word) not in _near_cache:
        if len(_near_cache) > 500_000:
            _near_cache.clear()
        _near_cache["g", word] = _near(word, _GIVEN)
    return _near_cache["g", word]


_WORD = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"[\"“”„«(']([^\"“”»)']{2,})[\"“”»)']")


def parse_person(text: str) -> tuple[str, str, str, str | None]:
    """``(surname, first given, second given, nickname)`` in plain letters; given names may be initials."""
    nick = None
    if m := _QUOTED.search(text):
        nick = pii.fold(" ".join(_WORD.findall(m.group(1)))) or None
        text = text[: m.start()] + " " + text[m.end() :]
    text = re.sub(r"(?<=\w)[’'](?=\w)", "", text)
    left, comma, right = text.partition(",")
    words = [w for w in (pii.fold(x) for x in _WORD.findall(left)) if w not in TITLES]
    if comma:
        tail = [w for w in (pii.fold(x) for x in _WORD.findall(right)) if w not in TITLES]
        if words and tail:
            return " ".join(words), tail[0], " ".join(tail[1:]), nick
        words += tail
    if len(words) < 2:
        return "".join(words), "", "", nick
    first, last = words[0], words[-1]
    if len(last) == 1 or near_given(last) and not near_given(first) and len(first) > 1:
        reverse = True
    elif len(first) == 1 or near_given(first):
        reverse = False
    else:
        reverse = len(first) > len(last) + 2
    if reverse:
        return first, words[1], " ".join(words[2:]), nick
    return last, first, " ".join(words[1:-1]), nick


def parse_company(text: str) -> tuple[str, str, str]:
    """``(core, trade, legal form)`` in plain letters; the legal form is ``a``, ``l`` or empty."""
    flat = pii.fold(text)
    legal = "a" if re.search(r"\banonim|\ba\.? ?s\b", flat) else "l" if re.search(r"\blimi?te?d|\bltd", flat) else ""
    core, trade = [], []
    for w in _WORD.findall(flat):
        if w in _FORM:
            continue
        if w in _TRADE:
            trade.append(_TRADE[w])
        elif form := _near(w, _LONG_FORMS):
            if not legal and form in ("anonim", "limited"):
                legal = form[0]
        elif _near(w, _TRADE):
            trade.append(w)  # misspelt: settled among the trades of its core
        else:
            core.append(w)
    if not core:
        return " ".join(trade), "", legal
    if len(core) > 1:
        longest = max(core, key=len)
        trade += [c for c in core if c != longest]
        core = [longest]
    return core[0], " ".join(sorted(set(trade))), legal


def parse(names: DataFrame, model: lookalike.Model) -> DataFrame:
    """Parsed distinct spellings of ``names(label, text)``."""
    score = model.score

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = lookalike.Model({})
        m.score = score
        for pdf in batches:
            rows = []
            for label, text in zip(pdf["label"], pdf["text"]):
                flat = m.canonical(text)
                if label == "Person":
                    core, part, part2, nick = parse_person(flat)
                    legal = ""
                else:
                    core, part, legal = parse_company(flat)
                    part2, nick = "", None
                rows.append((label, text, core or text, part, part2, legal, nick, pii.fold(flat)))
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return names.select("label", "text").mapInPandas(run, PARSED)


# -- within one core


def resolve(label: str, nodes: list[dict]) -> list[str]:
    """Entity key of each node ``{part, part2, legal, formal, n}`` of one core."""
    return _companies(nodes) if label == "Company" else _people(nodes)


def _companies(nodes: list[dict]) -> list[str]:
    known = {w for n in nodes for w in n["part"].split() if w in _TRADE}

    def settled(part: str) -> str:
        words = [w if w in known else _near(w, known) or (_TRADE[near] if (near := _near(w, _TRADE)) else w) for w in part.split()]
        return " ".join(sorted(set(words)))

    nodes = [n | {"part": settled(n["part"])} for n in nodes]
    trades = sorted({n["part"] for n in nodes if n["part"]})
    legals = defaultdict(set)
    for n in nodes:
        if n["part"] and n["legal"]:
            legals[n["part"]].add(n["legal"])
    out = []
    for n in nodes:
        if n["part"]:
            fits = [t for t in trades if set(n["part"].split()) <= set(t.split())]
            out.append(max(fits, key=lambda t: (t == n["part"], len(t))) if len(fits) == 1 else n["part"])
            continue
        fits = [t for t in trades if not n["legal"] or not legals[t] or n["legal"] in legals[t]]
        out.append(fits[0] if len(fits) == 1 else "")
    return out


def _people(nodes: list[dict]) -> list[str]:
    weight: dict[str, int] = defaultdict(int)
    seconds: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for n in nodes:
        if len(n["part"]) > 1:
            weight[n["part"]] += n["n"]
            if n["part2"]:
                seconds[n["part"]][n["part2"]] += n["n"]
    names = sorted(weight, key=lambda g: (g not in _GIVEN, -weight[g], g))
    owner: dict[str, str] = {}
    roots = _Index()
    formal = {n["part"]: n["formal"] for n in nodes if n["formal"] is not None and len(n["formal"])}
    for g in names:  # known given names first, the frequent ones before the rare
        target = g
        if g not in _GIVEN:
            own = [t for t in formal.get(g, ()) if t in owner]
            err = roots.error(g) if len(g) > 2 else None
            err = err or (roots.alike(g) if len(g) > 3 else None)
            if own:
                target = owner[own[0]]
            elif err:
                target = err
            elif (head := roots.head(g)) and len(g) <= len(head) + 2:
                target = head
        owner[g] = target
        if target == g:
            roots.add(g)
    after: dict[str, set[tuple[str, str]]] = defaultdict(set)
    for f in names:
        for sec in seconds[f]:
            for form in one_left_out(sec) if len(sec) > 2 else (sec,):
                after[form].add((f, sec))
    for g in names:  # a second given name used alone
        if owner[g] == g and not seconds[g]:
            met = {x for form in one_left_out(g) for x in after.get(form, ())}
            fits = {owner[f] for f, sec in met if f != g and owner[f] != g and (g == sec or len(sec) > 2 and one_error(g, sec))}
            if len(fits) == 1:
                owner[g] = fits.pop()
    mains = sorted({_root(owner, g) for g in names})
    split = {m: _split_seconds(m, [(s, k) for g in names if _root(owner, g) == m for s, k in seconds[g].items()]) for m in mains}
    under: dict[str, list[str]] = defaultdict(list)
    for m in mains:
        under[m[:1]].append(m)
    out = []
    for n in nodes:
        p, q = n["part"], n["part2"]
        if len(p) > 1:
            main = _root(owner, p)
            out.append(f"{main} {split[main].get(q, '')}".strip() if q else main if not _several(split[main]) else f"{main} ?")
            continue
        fits = under[p] if p else []
        if q and len(fits) > 1:
            fits = [m for m in fits if any(s[:1] == q[:1] for s in split[m])] or fits
        out.append(fits[0] if len(fits) == 1 and not _several(split[fits[0]]) else f"{p}." if p else "")
    return [k if not k.endswith(" ") else k[:-1] for k in out]


def _root(owner: dict[str, str], g: str) -> str:
    for _ in range(len(owner) + 1):
        if owner[g] == g:
            return g
        g = owner[g]
    return g


def _prefix(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _split_seconds(main: str, seconds: list[tuple[str, int]]) -> dict[str, str]:
    """Second given names of one first name: contradicting ones name different people, all others share ''."""
    full = sorted({s for s, _ in seconds if len(s) > 1}, key=lambda s: (s not in _GIVEN, s))
    kinds: list[str] = []
    at: dict[str, str] = {}
    for s in full:
        same = [k for k in kinds if one_error(s, k) or lcs_ratio(s, k) >= 0.8]
        at[s] = same[0] if same else s
        if not same:
            kinds.append(s)
    one = len(kinds) <= 1
    result = {}
    for s, _ in seconds:
        if len(s) > 1:
            result[s] = "" if one else at[s]
        else:
            fits = [k for k in kinds if k[:1] == s]
            result[s] = "" if one else fits[0] if len(fits) == 1 else "?"
    return result


def _several(split: dict[str, str]) -> bool:
    return len({v for v in split.values()} - {"?"}) > 1


NODE = "label string, core string, part string, part2 string, legal string, entity string, forms long"


def _resolve_cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole cores out of a partition sorted by core."""

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (label, core), g in pdf.groupby(["label", "core"], sort=False):
            nodes = g.to_dict("records")
            for n, key in zip(nodes, resolve(label, nodes)):
                rows.append((label, core, n["part"], n["part2"], n["legal"], key, n["n"]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])

    kept: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        kept.append(pdf)
        size += len(pdf)
        if size < 5000:
            continue
        whole = pd.concat(kept, ignore_index=True)
        tail = (whole["core"] == whole["core"].iloc[-1]) & (whole["label"] == whole["label"].iloc[-1])
        if (~tail).any():
            yield done(whole[~tail])
        kept, size = [whole[tail]], int(tail.sum())
    if size:
        yield done(pd.concat(kept, ignore_index=True))


# -- across cores


def suffix_keys(cores: DataFrame, min_suffix: int = 5, common: int = 50) -> DataFrame:
    """Blocking keys ``(key, label, core)`` of distinct cores."""
    half = lambda n: F.floor((n - 2) / 2).cast("int")
    size = F.length("core")
    sizes = F.array_distinct(F.array(half(size), half(size - 1)))
    rows = cores.where(size >= 4).select("label", "core", F.explode(sizes).alias("k"))
    both = F.array(F.struct(F.lit("f").alias("d"), F.col("core").alias("w")), F.struct(F.lit("b").alias("d"), F.reverse("core").alias("w")))
    long = rows.where(F.col("k") >= min_suffix).select("label", "core", "k", F.explode(both).alias("x"))
    long = long.select("label", "core", F.col("x.d").alias("d"), F.expr("right(x.w, k)").alias("s"), F.expr("left(x.w, length(x.w) - k)").alias("rest"))
    crowded = long.groupBy("label", "d", "s").agg(F.count("*").alias("cores"))
    long = long.join(crowded, ["label", "d", "s"])
    short = rows.where(F.col("k") < min_suffix).select("label", "core", F.lit("").alias("d"), F.lit("").alias("s"), F.col("core").alias("rest"), F.lit(True).alias("refine")).distinct()
    rows = long.select("label", "core", "d", "s", "rest", (F.col("cores") > common).alias("refine")).unionByName(short)
    left_out = F.transform(F.sequence(F.lit(1), F.length("rest")), lambda i: F.concat(F.substring(F.col("rest"), F.lit(1), i - 1), F.substring(F.col("rest"), i + 1, F.length("rest"))))
    forms = F.when(F.col("refine"), F.array_distinct(F.array_append(left_out, F.col("rest")))).otherwise(F.array(F.lit("*")))
    rows = rows.select("label", "core", "d", "s", F.explode(forms).alias("form"))
    return rows.select(F.concat_ws("|", "d", "s", "form").alias("key"), "label", "core")


def core_pairs(cores: DataFrame, **options) -> DataFrame:
    """Pairs ``(label, x_core, y_core)`` of different cores whose longest common subsequence misses at most one letter."""
    keys = suffix_keys(cores, **options)
    a, b = keys.alias("a"), keys.alias("b")
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.core") < F.col("b.core"))
    near = F.abs(F.length("a.core") - F.length("b.core")) <= 1
    pairs = a.join(b, same & near).select(F.col("a.label").alias("label"), F.col("a.core").alias("x_core"), F.col("b.core").alias("y_core"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [lcs_ratio(x, y) >= 1 - 1 / min(len(x), len(y)) - 1e-9 for x, y in zip(pdf["x_core"], pdf["y_core"])]
            yield pdf[ok]

    return spread(pairs.distinct(), "x_core").mapInPandas(compare, "label string, x_core string, y_core string")


def link(clusters: DataFrame, short: int = 6, **options) -> DataFrame:
    """Links between clusters of different cores: all with equal parts, others if the rarer cluster has no other."""
    cores = clusters.groupBy("label", "core").agg(F.count("*").alias("named"))
    pairs = cut(core_pairs(cores.select("label", "core"), **options), "core-pairs")
    person = F.col("label") == "Person"
    word = F.when(person, F.regexp_replace(F.element_at(F.split("entity", " "), 1), r"\.+$", "")).otherwise(F.col("entity"))
    info = clusters.join(cores, ["label", "core"]).withColumn("word", word)
    info = info.withColumn("vague", F.when(person, F.length("word") == 1).otherwise(F.col("word") == ""))
    info = info.withColumn("start", F.when(person, F.substring("word", 1, 1)).otherwise("")).where(~person | ~F.col("vague") | (F.col("word") != ""))
    side = lambda df, s: df.select("label", *[F.col(c).alias(f"{s}_{c}") for c in ("cluster", "core", "entity", "forms", "weight", "named", "word", "start")])
    x, y = side(info, "x"), side(info, "y")
    equal = pairs.join(x, ["label", "x_core"]).join(y, ["label", "y_core"]).where("x_word = y_word")
    turned = pairs.unionByName(pairs.select("label", F.col("y_core").alias("x_core"), F.col("x_core").alias("y_core")))
    vague = turned.join(side(info.where("vague"), "x"), ["label", "x_core"]).join(side(info.where("not vague and (label != 'Person' or word != '')"), "y"), ["label", "y_core"]).where("x_start = y_start")
    met = equal.unionByName(vague)
    order = lambda s: F.struct(*[F.col(f"{s}_{c}") for c in ("forms", "weight", "cluster")])
    up = order("x") < order("y")
    pick = lambda c: F.when(up, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}"))
    found = met.select(pick("cluster").alias("weak"), F.when(up, F.col("y_cluster")).otherwise(F.col("x_cluster")).alias("strong"), (F.col("x_entity") == F.col("y_entity")).alias("exact"), F.greatest(F.length("x_core"), F.length("y_core")).alias("letters"), F.least("x_named", "y_named").alias("named"))
    found = cut(found.where((F.col("letters") > short) | (F.col("named") == 1)).select("weak", "strong", "exact"), "name-links-found")
    rivals = found.groupBy("weak").agg(F.count("*").alias("rivals"))
    return found.join(rivals, "weak").where("exact or rivals = 1").select("weak", "strong")


def components(links: DataFrame) -> DataFrame:
    """``(cluster, root)`` of every linked cluster: the smallest name in its component, handed on and shortened until
    nothing moves."""
    both = links.select(F.col("weak").alias("cluster"), F.col("strong").alias("other"))
    edges = cut(both.union(both.select("other", "cluster")).distinct(), "name-links")
    at = edges.groupBy("cluster").agg(F.min("other").alias("root")).withColumn("root", F.least("cluster", "root"))
    for i in count():
        near = edges.join(at.withColumnRenamed("cluster", "other"), "other").groupBy("cluster").agg(F.min("root").alias("near"))
        step = at.join(near, "cluster").select("cluster", "root", F.least("root", "near").alias("low"))
        far = at.select(F.col("cluster").alias("low"), F.col("root").alias("far"))
        step = step.join(far, "low", "left").select("cluster", F.least("low", F.coalesce("far", "low")).alias("new"), "root")
        step = cut(step.select("cluster", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("moved")), f"name-roots-{i}")
        if i:
            release(last)
        at, last = step.drop("moved"), step
        if not step.where("moved").limit(1).count():
            return at


def entities(spans: DataFrame, min_suffix: int = 5, common: int = 50, short: int = 6) -> DataFrame:
    """``(label, text, entity_id)`` for every distinct spelling of a person or company."""
    names = spans.where("label in ('Person', 'Company') and text is not null and trim(text) != ''").select("label", "text").groupBy("label", "text").agg(F.count("*").alias("rows"))
    names = cut(spread(names, "text"), "spellings")
    parsed = cut(parse(names, lookalike.learn(names)), "parsed-names")
    nodes = parsed.groupBy("label", "core", "part", "part2", "legal").agg(F.countDistinct("form").alias("n"))
    nicks = parsed.where("nick is not null").groupBy(F.col("nick").alias("part")).agg(F.array_sort(F.collect_set("part")).alias("formal"))
    nodes = nodes.join(nicks, "part", "left")
    resolved = spread(nodes, "label", "core").sortWithinPartitions("label", "core").mapInPandas(_resolve_cores, NODE)
    cluster = F.concat_ws("", "label", "core", "entity")
    resolved = cut(resolved.withColumn("cluster", cluster), "resolved-names")
    clusters = resolved.groupBy("cluster", "label", "core", "entity").agg(F.count("*").alias("forms"), F.sum("forms").alias("weight"))
    root = components(link(cut(clusters, "name-clusters"), short, min_suffix=min_suffix, common=common))
    final = resolved.join(root, "cluster", "left").select("label", "core", "part", "part2", "legal", F.md5(F.coalesce("root", "cluster")).alias("entity_id"))
    return parsed.join(final, ["label", "core", "part", "part2", "legal"]).select("label", "text", "entity_id")


def pairs(found: DataFrame) -> DataFrame:
    """All pairs of distinct spellings of an entity, the smaller text first."""
    a, b = found.alias("a"), found.alias("b")
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.entity_id") == F.col("b.entity_id")) & (F.col("a.text") < F.col("b.text"))
    return a.join(b, same).select(F.col("a.label").alias("label"), F.col("a.text").alias("text_a"), F.col("b.text").alias("text_b"))
