"""Personal data inside free text: detection, typed placeholders and keyed surrogates.

Detection runs over the whole text once per kind, strongest first, and a later kind never overlaps an earlier one:
e-mail addresses, account numbers (found only to be left alone), street addresses, identity numbers (with check
digits where they have them), phone numbers, persons. Persons are recognised by the shape of a name around a known
given name or an initial, by a cue such as a title or a form field next to a name's shape, and by a
:class:`NameModel`: a logistic regression over the letters, the shape, the place and the neighbours of capitalised
words, which knows no list. It is fitted on at most ``sample`` runs of capitalised words of the texts, those with the
smallest hashes, labelled by the rules before it; it looks at what the rules leave.

Replacement keeps all other characters. A placeholder carries the type and a number that is the same for the same
entity within a document; an initial or a lone name that several people of the document share is an entity of its own.
A surrogate is drawn by a keyed hash of the entity: a person gets given names of the same
gender and a surname in the same script, letter case and order; numbers keep their format and valid check digits.
Surrogates that collide within a document, with each other or with its text, are drawn again with the next counter;
from the third draw on surnames are made of syllables, more of them the further it goes, so any number of entities stay
different in linear time, and mentions of one entity stay together. Distinctness holds within a document; across
documents the same entity gets the same first draw.

Defined results: null gives no spans and stays null; empty and very long texts are processed whole; offsets are
0-based code points, the end exclusive; a record that comes twice counts once; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "pii_type string, start_pos int, end_pos int"

#: Common given names, by gender.
FEMALE = "Anna Aylin Ayşe Bahar Buse Ceren Çağla Clara Defne Derya Ebru Elif Emily Emine Emma Esra Fatma Gizem Grace Gülşen Hanna Hatice Ida Ilgaz Işıl İlknur Julia Lena Lisa Maria Mary Melek Melis Meryem Mia Nehir Nora Nurcan Özge Pelin Petra Ruth Sarah Selin Sevgi Sibel Sofia Sophie Şule Tülay Ülkü Yasemin Zehra Zeynep"
MALE = "Ahmet Ali Arda Barış Burak Can Cem Çetin Daniel David Deniz Edgar Emre Erkan Fatih Felix Ferhat Furkan Hakan Halil Hans Hasan Henry Hüseyin İbrahim İsmail Jack James John Kaan Kadir Karl Kemal Kerem Leon Levent Lukas Mark Martin Mehmet Mert Michael Murat Mustafa Oğuz Oliver Onur Orhan Osman Ömer Paul Peter Ramazan Rıza Robert Selim Serkan Simon Stefan Süleyman Şaban Thomas Tolga Toprak Uğur Umut Ümit Volkan Yusuf"
SURNAMES = "Akarsoy Alkan Belligil Canoğlu Dalgıç Erdemli Göksel Hansoy İnceman Kayabay Korman Lerntaş Merttepe Narlı Odabay Pekgil Rençber Sarıgil Tanman Uzunsoy Varol Yelkan Zorbay Brandt Keller Marlow Thorne Whitby Ashdown"
#: Parts of made surnames.
SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo"
TOWNS = "Akpınar Bozova Çamlıbel Dereköy Esentepe Gölyaka Kızılca Sazlı"

_LOWER, _UPPER = "a-zçğıöşüäßâîû", "A-ZÇĞİÖŞÜÄÂÎÛ"


def lower_tr(s: str) -> str:
    return s.replace("İ", "i").replace("I", "ı").lower()


def upper_tr(s: str) -> str:
    return s.replace("i", "İ").replace("ı", "I").upper()


_FOLD = str.maketrans("çğıöşüÇĞİÖŞÜâîûäß", "cgiosuCGIOSUaiuas")


def fold(s: str) -> str:
    """Plain lower-case letters: the key under which spellings of a name meet."""
    return lower_tr(s).translate(_FOLD)


_GENDER = {fold(n): g for g, names in (("f", FEMALE), ("m", MALE)) for n in names.split()}
_T = f"[{_UPPER}][{_LOWER}]{{2,}}(?:-[{_UPPER}][{_LOWER}]{{2,}})?"
_U = f"[{_UPPER}]{{3,}}"
_L = f"[{_LOWER}]{{4,}}"
_I = f"[{_UPPER}]\\."


def _forms(names: str) -> tuple[str, str, str]:
    title = {n for n in names.split()} | {n.translate(_FOLD) for n in names.split()}
    upper = {upper_tr(n) for n in title} | {n.upper() for n in title}
    low = {lower_tr(n) for n in title} | {n.lower() for n in title if "̇" not in n.lower()}
    return tuple("(?:" + "|".join(sorted(x, key=lambda n: (-len(n), n))) + ")" for x in (title, upper, low))


_GT, _GU, _GL = _forms(f"{FEMALE} {MALE}")

_B, _E = r"(?<![\w@.+\-])", r"(?![\w@])"
_CUE = r"(?:[Tt]anık|[Kk]efil|[Bb]aşvuru sahibi|[Mm]üşteri:?|[Ss]ayın|Ad[ıi]? [Ss]oyad[ıi]? ?:|[Nn]ame:|\"(?:ad|name)\": ?\"|Dr\.|Av\.|Prof\.|Görüşmeye|kaydı|Saygılarımla,|[Rr]egards,|Grüßen|Frau|Herrn?|Mr\.?|Mrs\.?|Ms\.?|Miss|Dear|numarası \S+ olan|rufen Sie|[Cc]all|vo[nm]|by|anlattı;)"
_NAMES = [
    # surname first
    re.compile(f"{_B}(?P<name>(?:{_T}|{_U}), (?:(?:{_GT}|{_GU})(?: (?:{_GT}|{_GU}|{_I}))?{_E}|{_I}(?: ?{_I})?))"),
    re.compile(f"{_B}(?P<name>{_L}, {_GL}){_E}"),
    # given names or initials, then the surname
    re.compile(f"{_B}(?P<name>(?:{_GT}|{_GU})(?: (?:{_GT}|{_GU}|{_I}))? (?:{_T}|{_U}))(?![\\w@])"),
    re.compile(f"{_B}(?P<name>{_GL}(?: {_GL})? (?P<low>{_L}))(?![\\w@])"),
    re.compile(f"{_B}(?P<name>{_I} ?(?:{_I} ?)?(?:{_T}|{_U}))(?![\\w@])"),
    # after a cue: any name's shape
    re.compile(f"(?<!\\w){_CUE}\\s+(?P<name>(?:{_T}|{_U}) (?:(?:{_T}|{_U}|{_I}) )?(?:{_T}|{_U}))(?![\\w@])"),
    re.compile(f"(?<!\\w){_CUE}\\s*(?P<name>(?:{_T}|{_U}) (?:{_GT}|{_GU})(?: (?:{_GT}|{_GU}))?){_E}"),
    # a lone name with a form of address
    re.compile(f"(?<!\\w)(?:[Ss]ayın|SAYIN|Frau|Herrn?|Mr\\.?|Mrs\\.?|Ms\\.?|Miss|Bay|Bayan) (?P<name>{_T}|{_U}){_E}"),
    re.compile(f"{_B}(?P<name>(?:{_T}|{_U})(?: (?:{_T}|{_U}))?) (?:Bey|Hanım|Hanim|BEY|HANIM)(?!\\w)"),
]
_NO_NAME = set(
    "mah mahalle mahallesi cad cadde caddesi sok sokak sokağı sk bulvar bulvarı bulv köy köyü yolu meydanı apt kat daire no mahkemeleri mahkemesi belediyesi üniversitesi"
    " bey hanım sayın kimlik tc ltd şti holding bankası kefil tanık müşteri başvuru street avenue road lane email phone name telefon gsm adres esas fatura sipariş iban vergi kargo madde sürüm toplam"
    " evi the both payment no please der die das frau herr dr av".split()
)
_STREET = re.compile(r"^[,.]? ?(?:mah\b|mahalle|cad\b|cadde|sok\b|sokak|sokağ|sk\b|bulv|köyü|yolu\b|meydan|street|avenue|road|lane)", re.I)
_FIRM = re.compile(r"^(?: [\w.&]+){0,4}? (?:A\.? ?Ş|AŞ|Ltd|LTD|Şti|Holding|Anonim|Limited|GmbH|Inc)\b")
_AFTER_LOW = re.compile(r"^(?:['’\"\n]|;[+(\d]| \(|\s*$| /| ad[ıi]na| raporu| ile vekili| ifadesinde| ise | evrakı| lives| unter| on | vorgelegt|\s*\n)")
_BEFORE_LOW = re.compile(rf"(?:{_CUE}|olan|[;\"])\s*$")

_EMAIL = re.compile(r"(?<![\w.+\-])[\w.+\-]+(?:@| @ |\s?[(\[]\s?at\s?[)\]]\s?)[\w\-]+(?:(?:\.|\s?[(\[]\s?(?:nokta|dot|punkt)\s?[)\]]\s?)[\w\-]+)+")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){3,7}(?:[ -]?[A-Z0-9]{1,3})?(?!\w)")
_MAH = r"(?:[Mm]ahallesi|[Mm]ahalle|[Mm]ah\.?|MAHALLESİ|MAHALLE|MAH\.?)"
_ROAD = r"(?:[Cc]addesi|[Cc]adde|[Cc]ad\.?|CADDESİ|CAD\.?|[Ss]okağı|[Ss]okak|[Ss]ok\.?|SOKAK|SOK\.?|[Ss]k\.?|SK\.?|[Bb]ulvarı|[Bb]ulv\.?|BULVARI|BULV\.?|[Yy]olu|YOLU)"
_W = rf"[{_UPPER}][\w]+"
_ADDRESS = [
    re.compile(
        rf"(?<!\w)(?:{_W} (?:[Kk]öyü|KÖYÜ),? |{_W} {_MAH},? )?{_W} {_ROAD},? ?(?:[Nn][Oo]\.? ?:? ?)?\d+(?: ?/ ?\w+)?"
        rf"(?: ?,? ?(?:Kat|KAT|kat|K) ?[:.]? ?\d+)?(?: ?,? ?(?:Daire|DAİRE|daire|D) ?[:.]? ?\d+)?"
        rf"(?:,? \d{{5}} {_W}(?:/{_W})?|,? {_W}/{_W}|(?<=\w), {_W}(?!\w|\.\w| {_ROAD}| {_MAH}| [Kk]öyü)|(?<=D:\d) [{_UPPER}]{{3,}}(?!\w)|(?<=D:\d\d) [{_UPPER}]{{3,}}(?!\w)|(?<=D:\d\d\d) [{_UPPER}]{{3,}}(?!\w))?"
    ),
    re.compile(r"(?<![\w.])\d+[A-Za-z]? (?:[A-Z][a-z]+ ){1,3}(?:Street|St\.|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Way|Court|Place|Square|Close|Terrace)(?:, (?:Apt|Flat|Unit|Suite|No)\.? \w+)?(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)?(?: [A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})?(?![\w]))?"),
    re.compile(r"(?<!\w)[A-ZÄÖÜ][a-zäöüß]+(?:[ -][A-ZÄÖÜ][a-zäöüß]+)?(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer|ring|damm|Straße|Weg|Platz|Allee) \d+ ?[a-z]?(?!\w)(?:, \d{5} [A-ZÄÖÜ][a-zäöüß]+(?:[ -][A-ZÄÖÜ][a-zäöüß]+)?)?"),
]
_TC = re.compile(r"(?<![\w./\-])(?:\d{11}|\d{3} \d{3} \d{3} \d{2}|\d{5}-\d{6}|\d{3}-\d{3}-\d{3}-\d{2}|\d{3}\.\d{3}\.\d{3}\.\d{2})(?![\w/\-]|[.,]\d)")
_ID_OTHER = re.compile(r"(?<![\w\-/])(?:[A-Z]{1,2}\d{7,8}|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}|\d{3}-\d{2}-\d{4})(?![\w\-/])")
#: Nine bare digits are a person's number only behind a word that says so.
_ID_CUED = re.compile(r"(?:\bSSN|[Ss]ocial [Ss]ecurity|[Pp]assport|[Pp]asaport|\b[Rr]eisepass|\b[Pp]ass)(?: ?(?:[Nn]umber|[Nn]umarası|[Nn]ummer|[Nn]o|[Nn]r|[Nn]um)\.?)? ?[:#]? ?(?:is )?(?P<id>\d{9})(?![\w/\-]|[.,]\d)")
_NOT_ID = re.compile(r"(?:takip|kargo|sipariş|fatura|vergi|hesap|iban|dosya|parcel|invoice|tracking|rechnung|steuer)[^\n]{0,16}$", re.I)
_PHONE = [
    re.compile(r"(?<![\w+/.,\-(])(?:(?:\+|00)90[ .\-]?|0[ .\-]?)?\(?0?[2-5]\d{2}\)?[ .\-]?\d{3}[ .\-]?\d{2}[ .\-]?\d{2}(?![\w/\-]|[.,]\d)"),
    re.compile(r"(?<![\w+])(?:\+|00)[1-9]\d{0,2}(?:[ .\-]?\(?\d{1,7}\)?){1,5}(?![\w/\-]|[.,]\d)"),
    re.compile(r"(?<![\w+/.,\-])\(\d{3}\) \d{3}[ \-]\d{4}(?![\w/\-])"),
    re.compile(r"(?<![\w+/.,\-])(?:\(0\d{2,4}\)|0\d{2,4}) \d{3,4} \d{3,4}(?![\w/\-]| ?\d)"),
]
_NOT_PHONE = re.compile(r"(?:vergi|takip|sipariş|fatura|hesap|iban|tax|invoice)[^\n]{0,12}$", re.I)


class Found(NamedTuple):
    kind: str
    start: int
    end: int


def tc_valid(digits: str) -> bool:
    d = [int(c) for c in digits]
    return len(d) == 11 and d[0] != 0 and d[9] == (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 and d[10] == sum(d[:10]) % 10


class _Taken:
    """Intervals that do not overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def detect(text: str, model: NameModel | None = None) -> list[Found]:
    """Every occurrence, in order of place."""
    return sorted(_found(text, model)[0], key=lambda f: f.start)


def _found(text: str, model: NameModel | None = None) -> tuple[list[Found], _Taken]:
    taken = _Taken()
    out: list[Found] = []
    free = taken.free

    def add(kind: str, a: int, b: int) -> None:
        taken.add(a, b)
        if kind:
            out.append(Found(kind, a, b))

    for m in _EMAIL.finditer(text):
        if re.search(r"[^\W\d_]{2,}$", m.group()):
            add("EMAIL", m.start(), m.end())
    for m in _IBAN.finditer(text):
        if free(*m.span()):
            add("", *m.span())
    for p in _ADDRESS:
        for m in p.finditer(text):
            if free(*m.span()):
                add("ADDRESS", m.start(), m.end())
    for m in _TC.finditer(text):
        if tc_valid(re.sub(r"\D", "", m.group())) and free(*m.span()) and not _NOT_ID.search(text, max(0, m.start() - 30), m.start()):
            add("ID_NUMBER", *m.span())
    for m in _ID_OTHER.finditer(text):
        if free(*m.span()) and not _NOT_ID.search(text, max(0, m.start() - 30), m.start()):
            add("ID_NUMBER", *m.span())
    for m in _ID_CUED.finditer(text):
        if free(*m.span("id")):
            add("ID_NUMBER", *m.span("id"))
    for p in _PHONE:
        for m in p.finditer(text):
            digits = re.sub(r"\D", "", m.group())
            bare = m.group().isdigit() and not m.group().startswith("0")
            if 7 <= len(digits) <= 15 and not bare and free(*m.span()) and not _NOT_PHONE.search(text, max(0, m.start() - 24), m.start()):
                add("PHONE", *m.span())
    for p in _NAMES:
        at = 0
        while m := p.search(text, at):
            a, b = m.span("name")
            at = max(m.start() + 1, b if _is_name(text, m) and free(a, b) else m.start() + 1)
            if at == b:
                add("PERSON", a, b)
    if model is not None and len(model.weights):
        runs = [(a, b) for a, b in name_runs(text, model.common) if free(a, b) and not _ruled_out(text, a, b)]
        for (a, b), p in zip(runs, model.probabilities([features(text, a, b) for a, b in runs])):
            if p >= model.threshold and free(a, b):
                add("PERSON", a, b)
    return out, taken


# -- names by letters, place and neighbours

_CAPITAL = r"[^\W\d_a-z]['’]?[^\W\d_]+(?:-[^\W\d_]{2,})?"
#: Two or three capitalised words in one line, or a surname, a comma and given names.
_RUN = re.compile(rf"(?<![\w@.+\-'’]){_CAPITAL}(?:(?: (?:[^\W\d_a-z]\.|{_CAPITAL})){{1,2}}|, {_CAPITAL}(?: {_CAPITAL})?)(?![\w@])")
_SIZE = 1 << 15


def name_runs(text: str, common: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Runs of capitalised words without words at their ends that are common in small letters."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        words = m.group().split()
        while words and lower_tr(words[0].rstrip(".,")) in common:
            a += len(words[0]) + 1
            words = words[1:]
        while words and lower_tr(words[-1].rstrip(".,")) in common:
            b -= len(words[-1]) + 1
            words = words[:-1]
        if len(words) > 2 and not words[0].endswith(",") and (a == 0 or re.search(r"(?:^|[.!?\n] ?)$", text[max(0, a - 2) : a])) and "," not in m.group():
            a += len(words[0]) + 1  # the first word of a sentence has a capital anyway
            words = words[1:]
        if len(words) > 1 and all(w[0].isupper() for w in words) and text[b - 1] != ",":
            yield a, b


def _ruled_out(text: str, a: int, b: int) -> bool:
    """Runs that no name is: words of addresses and firms in or behind them."""
    if any(lower_tr(w.rstrip(".,")) in _NO_NAME for w in text[a:b].split()):
        return True
    after = text[b : b + 60]
    return bool(_STREET.match(after.lstrip(" ")) or _FIRM.match(after) or re.match(r" ?[:=|]", after))


def features(text: str, a: int, b: int) -> np.ndarray:
    """Hashed features of the run ``text[a:b]``: letters of its words, shapes, neighbours, place."""
    words = text[a:b].split()
    before = re.findall(r"\w+|[^\w\s]|\n", text[max(0, a - 40) : a])[-2:]
    after = re.findall(r"['’]\w*|\w+|[^\w\s]|\n", text[b : b + 40])[:2]
    start = not before or before[-1] in "\n.!?"
    out = [f"n{len(words)}", f"comma{words[0].endswith(chr(44))}", f"start{start}", f"line{not before or before[-1] == chr(10)}"]
    for i, w in enumerate(words):
        side = "first" if i == 0 else "last" if i == len(words) - 1 else "mid"
        out += [f"{side}len{min(len(w), 12) // 3}", f"{side}{'initial' if w.endswith('.') else 'upper' if w.isupper() else 'title' if w[1:].islower() else 'mixed'}"]
    out += [f"b{i}{fold(w)}" for i, w in enumerate(before[::-1])] + [f"a{i}{fold(w)}" for i, w in enumerate(after)]
    out.append(f"around{fold(before[-1]) if before else '^'}|{fold(after[0]) if after else '$'}")
    return np.unique(np.array([zlib.crc32(x.encode()) % _SIZE for x in out], dtype=np.int32))


class NameModel:
    """Logistic regression over hashed features; without weights it finds nothing. ``common`` are words in small letters."""

    def __init__(self, weights: np.ndarray | None = None, threshold: float = 0.6, common: frozenset[str] = frozenset()):
        self.weights = np.zeros(0) if weights is None else weights
        self.threshold, self.common = threshold, common

    def probabilities(self, rows: list[np.ndarray]) -> list[float]:
        return [float(1 / (1 + np.exp(-np.clip(self.weights[r].sum() + self.weights[-1], -30, 30)))) for r in rows]

    @classmethod
    def train(cls, rows: list[np.ndarray], labels: list[bool], threshold: float = 0.6, common: frozenset[str] = frozenset(), rounds: int = 8, rate: float = 0.3, decay: float = 1e-3, unknown: float = 0.25) -> NameModel:
        """Stochastic gradient steps with a rate per weight, in the order of ``rows``.

        A run that no rule names may be a name all the same, so it counts only ``unknown``.
        """
        if not any(labels) or all(labels):
            return cls(None, threshold, common)
        w = np.zeros(_SIZE + 1)
        squares = np.full(_SIZE + 1, 1e-6)
        rows = [np.append(r, _SIZE) for r in rows]
        for _ in range(rounds):
            for r, y in zip(rows, labels):
                p = 1 / (1 + np.exp(-np.clip(w[r].sum(), -30, 30)))
                g = (p - y) * (1.0 if y else unknown) + decay * w[r]
                squares[r] += g * g
                w[r] -= rate * g / np.sqrt(squares[r])
        return cls(w, threshold, common)


def labelled_runs(text: str, common: frozenset[str] = frozenset()) -> list[tuple[np.ndarray, bool]]:
    """Runs of capitalised words that the rules call a name, or that touch nothing they found."""
    found, taken = _found(text)
    people = {(f.start, f.end) for f in found if f.kind == "PERSON"}
    out = []
    for a, b in name_runs(text, common):
        name = (a, b) in people
        if name or taken.free(a, b) and not _ruled_out(text, a, b):
            out.append((features(text, a, b), name))
    return out


_ANY = re.compile(r"[^\W\d_]{2,}")


def small_words(text: str) -> Counter:
    """Words of a text: 1 for those it has in small letters only, -1 for those with a capital."""
    seen: dict[str, int] = {}
    for w in set(_ANY.findall(text)):
        if w.islower():
            seen.setdefault(w, 1)
        else:
            seen[lower_tr(w)] = -1
    return Counter(seen)


def common_words(df: DataFrame, text: str, most: int = 5000) -> frozenset[str]:
    """Words that more texts have in small letters than with a capital, at most ``most`` of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for t in pdf["t"]:
                seen.update(small_words(t))
            if seen:
                yield pd.DataFrame(list(seen.items()), columns=["w", "n"])

    rows = df.select(F.col(text).alias("t")).where("t is not null and t != ''").mapInPandas(run, "w string, n long")
    top = rows.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(most)
    return frozenset(r["w"] for r in top.collect())


def fit_names(df: DataFrame, text: str, sample: int = 20_000, threshold: float = 0.6) -> NameModel:
    """A model fitted on at most ``sample`` runs of the texts, those whose features have the smallest hashes."""
    common = common_words(df, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f.tolist(), y) for t in pdf["t"] for f, y in labelled_runs(t, common)]
            if rows:
                yield pd.DataFrame(rows, columns=["f", "y"])

    rows = df.select(F.col(text).alias("t")).where("t is not null and t != ''").mapInPandas(run, "f array<int>, y boolean").distinct()
    kept = rows.orderBy(F.xxhash64("f", "y"), "f", "y").limit(sample).collect()
    return NameModel.train([np.array(r["f"], dtype=np.int32) for r in kept], [r["y"] for r in kept], threshold, common)


def _is_name(text: str, m: re.Match) -> bool:
    a, b = m.span("name")
    words = [w for w in re.split(r"[ ,.]+", m.group("name")) if w]
    if any(lower_tr(w) in _NO_NAME for w in words):
        return False
    after = text[b : b + 60]
    if _STREET.match(after.lstrip(" ")) or _FIRM.match(after):
        return False
    if "," in m.group("name"):
        before = re.search(r"(\S+) $", text[max(0, a - 40) : a])
        if before and (fold(before.group(1)) in _GENDER or re.fullmatch(_I, before.group(1))):
            return False
    if m.group("name").islower():
        return bool(_BEFORE_LOW.search(text, max(0, a - 40), a) or _AFTER_LOW.match(after))
    return True


# -- replacement


class _Entities:
    """Mentions of one document under the entity they name."""

    def __init__(self, text: str, found: list[Found]):
        self.keys: list[str] = []
        by_surname: dict[str, set[str]] = {}
        by_given: dict[str, set[str]] = {}
        for f in found:
            if f.kind == "PERSON":
                given, sur = _name_parts(text[f.start : f.end])
                if sur and given and len(given[0]) > 1:
                    whole = fold(f"{given[0]} {sur}")
                    by_surname.setdefault(fold(sur), set()).add(whole)
                    by_given.setdefault(fold(given[0]), set()).add(whole)
        for f in found:
            t = text[f.start : f.end]
            if f.kind == "PERSON":
                given, sur = _name_parts(t)
                if sur and given and len(given[0]) > 1:
                    key = fold(f"{given[0]} {sur}")
                else:  # an initial with a surname, or a lone name: the only person it may be, else one of its own
                    own = fold(" ".join([*given[:1], sur]).strip())
                    fits = by_surname.get(fold(sur), set()) if sur else by_given.get(own, set())
                    fits = {w for w in fits if w.startswith(fold(given[0]))} if sur and given else fits
                    key = next(iter(fits)) if len(fits) == 1 else own if sur and not given or not sur else f"{own} ?"
            elif f.kind == "EMAIL":
                key = re.sub(r"\s?[(\[]\s?(?:nokta|dot|punkt)\s?[)\]]\s?", ".", re.sub(r"\s?[(\[]\s?at\s?[)\]]\s?| @ ", "@", t)).lower()
            elif f.kind == "PHONE":
                key = re.sub(r"\D", "", t)[-10:]
            else:
                key = re.sub(r"[\W_]", "", fold(t))
            self.keys.append(f"{f.kind}:{key}")


def _name_parts(name: str) -> tuple[list[str], str]:
    """Given names or initials, and the surname ('' for a lone given name)."""
    if "," in name:
        sur, _, given = name.partition(",")
        return given.replace(".", " ").split(), sur.strip()
    words = name.replace(".", " ").split()
    if len(words) == 1:
        return ([words[0]], "") if fold(words[0]) in _GENDER else ([], words[0])
    if len(words[0]) > 1 and fold(words[0]) not in _GENDER and fold(words[-1]) in _GENDER:
        return words[1:], words[0]
    return words[:-1], words[-1]


def marks(text: str, found: list[Found]) -> list[str]:
    """``[TYPE_n]`` for each occurrence, with one number per entity."""
    number: dict[str, int] = {}
    per: dict[str, int] = {}
    out = []
    for f, key in zip(found, _Entities(text, found).keys):
        if key not in number:
            number[key] = per[f.kind] = per.get(f.kind, 0) + 1
        out.append(f"[{f.kind}_{number[key]}]")
    return out


def _put(text: str, found: list[Found], new: list[str]) -> str:
    out, at = [], 0
    for f, t in zip(found, new):
        out += [text[at : f.start], t]
        at = f.end
    return "".join([*out, text[at:]])


def placeholders(text: str, found: list[Found] | None = None) -> str:
    """Text with each occurrence replaced by ``[TYPE_n]``."""
    found = detect(text) if found is None else found
    return _put(text, found, marks(text, found))


def _draw(key: bytes, entity: str, n: int) -> Iterator[int]:
    """Endless bytes that depend on the secret, the entity and the counter."""
    block = 0
    while True:
        yield from hmac.new(key, f"{entity}\0{n}\0{block}".encode(), hashlib.sha256).digest()
        block += 1


def _cased(like: str, word: str) -> str:
    if like.isupper() and len(like) > 1:
        return upper_tr(word)
    return lower_tr(word) if like.islower() else word


def _surrogate(kind: str, text: str, key: bytes, entity: str, n: int) -> str:
    rnd = _draw(key, entity, n)
    more = n // 4  # forms may be used up: local parts and house numbers get longer
    pick = lambda seq: seq[(next(rnd) << 8 | next(rnd)) % len(seq)]
    if kind == "PERSON":
        given, sur = _name_parts(text)
        words = re.split(r"([^\W\d_]+)", text)
        new_sur = pick(SURNAMES.split()) if n < 2 else "".join(pick(SYLLABLES.split()) for _ in range(3 + more)).capitalize()
        new_given = {}
        for g in [x for x in entity.partition(":")[2].split()[:-1] if x != "?"] or [fold(x) for x in given]:
            new_given[g] = pick((FEMALE if _GENDER.get(g) == "f" else MALE).split())
            if not sur and n > 1:
                new_given[g] += "".join(pick(SYLLABLES.split()) for _ in range(2 + more))
        spare = iter([*new_given.values(), *(pick(MALE.split()) for _ in range(3))])
        out = []
        for w in words:
            if not w or not w[0].isalpha():
                out.append(w)
            elif sur and w in sur:
                out.append(_cased(w, new_sur))
            else:
                name = new_given.get(fold(w)) or next(spare)
                out.append(name[0] if len(w) == 1 else _cased(w, name))
        plain = "".join(out)
        return plain if re.search("[çğıöşüÇĞİÖŞÜ]", text) or not text.isascii() else plain.translate(_FOLD)
    if kind == "ID_NUMBER" and sum(c.isdigit() for c in text) == 11 and not any(c.isalpha() for c in text):
        d = [1 + next(rnd) % 9, *(next(rnd) % 10 for _ in range(8))]
        d.append((7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10)
        d.append(sum(d) % 10)
        digits = iter(d)
        return "".join(str(next(digits)) if c.isdigit() else c for c in text)
    if kind == "EMAIL":
        at = re.search(r"@| @ |\s?[(\[]\s?at\s?[)\]]\s?", text)
        local = "".join(chr(97 + next(rnd) % 26) if c.isalpha() else str(next(rnd) % 10) if c.isdigit() else c for c in text[: at.start()])
        local += "".join(chr(97 + next(rnd) % 26) for _ in range(more))
        return (local.upper() if text[: at.start()].isupper() else local) + text[at.start() : at.end()] + re.sub(r"[^\W\d_]{2,}", "example", text[at.end() :], count=1)
    if kind == "ADDRESS":
        keep = re.compile(rf"^(?:{_MAH}|{_ROAD}|[Kk]öyü|KÖYÜ|[Nn][Oo]|Kat|KAT|Daire|DAİRE|D|K|Apt|Flat|Street|St|Avenue|Ave|Road|Lane|Drive|Way|Court|Place)\.?$")
        out = []
        for w in re.split(r"(\w+)", text):
            if w.isdigit():
                out.append("".join(str(1 + next(rnd) % 9) for _ in range(len(w) + more)))
            elif len(w) > 2 and w[0].isalpha() and not keep.match(w):
                end = re.search(r"(?:straße|strasse|weg|platz|allee|gasse|ufer|ring|damm)$", w)
                out.append(_cased(w, pick(TOWNS.split()) + (end.group() if end else "")))
            else:
                out.append(w)
        return "".join(out)
    first = True
    out = []
    for c in text:
        if c.isdigit() and (kind != "PHONE" or not (first and c == "0")):
            out.append(str(next(rnd) % 10) if kind != "PHONE" or len(re.sub(r"\D", "", text)) - sum(x.isdigit() for x in out) <= 7 else c)
            first = False
        elif c.isalpha():
            out.append(chr(65 + next(rnd) % 26))
        else:
            out.append(c)
    return "".join(out)


_WORD = re.compile(r"\w+(?:-\w+)*")


def drawn(text: str, secret: bytes, found: list[Found]) -> list[str]:
    """A keyed surrogate of its type and format for each occurrence."""
    keys = _Entities(text, found).keys
    forms: dict[str, dict[tuple[str, str], None]] = {}
    for f, k in zip(found, keys):
        forms.setdefault(k, {})[f.kind, text[f.start : f.end]] = None
    made_of: dict[tuple[str, str, str], str] = {}
    owned: set[str] = set()
    whole = fold(text)
    words = set(_WORD.findall(whole))
    for k, seen in forms.items():
        for n in itertools.count():
            made = {x: _surrogate(*x, secret, k, n) for x in seen}
            plain = {(kind, fold(m)) for (kind, _), m in made.items()}
            if not any(m in owned or (words & {w for w in _WORD.findall(m) if len(w) > 1} if kind == "PERSON" else m in whole) for kind, m in plain):
                made_of |= {(k, *x): m for x, m in made.items()}
                owned |= {m for _, m in plain}
                break
    return [made_of[k, f.kind, text[f.start : f.end]] for f, k in zip(found, keys)]


def surrogates(text: str, secret: bytes, found: list[Found] | None = None) -> str:
    """Text with each occurrence replaced by a keyed surrogate of its type and format."""
    found = detect(text) if found is None else found
    return _put(text, found, drawn(text, secret, found))


# -- tables


def replace_table(df: DataFrame, keys: list[str], text: str, secret: str, model: NameModel | None = None) -> DataFrame:
    """One row per occurrence with ``keys``, its place, its placeholder and its surrogate."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*keys, "pii_type", "start_pos", "end_pos", "placeholder", "surrogate"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *key, t in zip(*(pdf[k] for k in keys), pdf["_text"]):
                found = detect(t, model)
                rows += [(*key, *f, mark, new) for f, mark, new in zip(found, marks(t, found), drawn(t, secret.encode(), found))]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return df.select(*keys, F.col(text).alias("_text")).where("_text is not null").mapInPandas(run, f"{head}, {SPAN}, placeholder string, surrogate string")


def mask_table(df: DataFrame, keys: list[str], text: str, secret: str, model: NameModel | None = None) -> DataFrame:
    """``keys`` with the text in placeholders and in surrogates and the number of occurrences."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            masked, fresh, n = [], [], []
            for t in pdf["_text"]:
                found = [] if t is None else detect(t, model)
                masked.append(None if t is None else placeholders(t, found))
                fresh.append(None if t is None else surrogates(t, secret.encode(), found))
                n.append(len(found))
            yield pdf[keys].assign(masked=masked, surrogate=fresh, occurrences=n)

    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return df.select(*keys, F.col(text).alias("_text")).mapInPandas(run, f"{head}, masked string, surrogate string, occurrences int")
