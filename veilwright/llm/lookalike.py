"""One consistent form for texts that look the same.

Compatibility forms are resolved, ignorable characters deleted and blanks made plain first. Each run of letters is
then a lattice: every position offers the letters of all scripts that look like the one that stands there. A Viterbi
search picks the path with the best score under character bigrams of one script, learned from all texts; leaving
the script inside a run costs more than any bigram. The lattice depends on what a run looks like, not on which of
the look-alikes was typed, so runs that look the same always get the same form.

Defined results: null stays null; empty texts, digits, marks, letter case, dotless i and accents stay as they are;
line ends become line feeds; the number of blanks is kept; texts of any length are processed whole; extra columns
are kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin letters and the letters of other scripts drawn alike, pair by pair.
LATIN_CYRILLIC = "vѵ aа eе oо pр cс yу xх iі jј sѕ hһ dԁ qԛ wԝ AА BВ EЕ KК MМ HН OО PР CС TТ XХ YУ YҮ IІ JЈ SЅ"
LATIN_GREEK = "kκ oο vν pρ aα iι AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ"
LATIN_CHEROKEE = "AᎪ BᏴ CᏟ DᎠ EᎬ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ RᏒ SᏚ TᎢ VᏙ WᎳ ZᏃ"
LATIN_OTHER = "aɑ gɡ oօ uս hհ nո qզ OՕ SՏ"

_FORMS = {"<wide>", "<narrow>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
_IGNORED = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
SWITCH = -40.0
FLOOR = -16.0


def _plain_table() -> dict[int, str | None]:
    """Characters that are replaced one by one: compatibility forms, ignorable ones and blanks."""
    out: dict[int, str | None] = {}
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if ch in "\n\r":
            continue
        if ch in "\x0b\x85  ":
            out[cp] = "\n"
        elif kind == "Zs" or ch == "\t":
            out[cp] = " "
        elif kind == "Cf" or cp in _IGNORED or (kind == "Cc" and ch != "\x0c"):
            out[cp] = None
        else:
            tag = unicodedata.decomposition(ch).partition(" ")[0]
            if tag in _FORMS and not (flat := unicodedata.normalize("NFKC", ch)).startswith(" "):
                out[cp] = flat
    return out


_tables: dict[str, object] = {}


def _plain() -> dict[int, str | None]:
    if "plain" not in _tables:
        _tables["plain"] = _plain_table()
    return _tables["plain"]


def _lattice_table() -> dict[str, tuple[str, ...]]:
    """Letter -> all letters drawn alike, the same tuple for each of them."""
    groups: dict[str, set[str]] = {}
    for pair in f"{LATIN_CYRILLIC} {LATIN_GREEK} {LATIN_CHEROKEE} {LATIN_OTHER}".split():
        groups.setdefault(pair[0], {pair[0]}).add(pair[1])
    return {c: tuple(sorted(g)) for g in groups.values() for c in g}


ALIKE = _lattice_table()


def script(ch: str) -> str:
    cp = ord(ch)
    if cp < 0x0250 or 0x1E00 <= cp < 0x1F00 or 0x0250 <= cp < 0x02B0:
        return "L"
    if 0x0370 <= cp < 0x0400 or 0x1F00 <= cp < 0x2000:
        return "G"
    if 0x0400 <= cp < 0x0530:
        return "C"
    return "O"


def visible(text: str) -> str:
    """Decomposed text without compatibility forms, ignorable characters and odd blanks."""
    text = unicodedata.normalize("NFD", text.replace("\r\n", "\n").replace("\r", "\n").translate(_plain()))
    return text.replace("i̇", "i").replace("ı̇", "i").replace("j̇", "j") if "̇" in text else text


_RUN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


def skeleton(run: str) -> str:
    return "".join(ALIKE[c][0] if c in ALIKE else c for c in run)


class Model:
    """Bigram log scores per script; missing bigrams score ``FLOOR``."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        total: Counter = Counter()
        for (a, _), n in counts.items():
            total[a] += n
        whole = sum(n for (a, _), n in counts.items() if a[0] == "^") or 1
        self.score = {}
        for (a, b), n in counts.items():
            self.score[a, b] = math.log(n / whole) if a[0] == "^" else math.log(n / total[a])
        self.cache: dict[str, str] = {}

    def best(self, run: str) -> str:
        """The path through the lattice of ``run`` with the best score; ties go to the smaller letters."""
        typed = run
        if typed in self.cache:
            return self.cache[typed]
        run = skeleton(run)
        paths = None
        for ch in run:
            if unicodedata.combining(ch):
                paths = {k: (s, p + ch) for k, (s, p) in paths.items()}
                continue
            step = {}
            for c in ALIKE.get(ch, (ch,)):
                sc = script(c)
                if paths is None:
                    step[c] = (self.score.get(("^" + sc, c), FLOOR), c)
                    continue
                found = []
                for last, (s, p) in paths.items():
                    move = self.score.get((last, c), FLOOR) if script(last) == sc else SWITCH
                    found.append((-(s + move), p + c))
                cost, p = min(found)
                step[c] = (-cost, p)
            paths = step
        out = min((-s, p) for s, p in paths.values())[1]
        if len(self.cache) > 500_000:
            self.cache.clear()
        self.cache[typed] = out
        return out

    def canonical(self, text: str) -> str:
        return unicodedata.normalize("NFC", _RUN.sub(lambda m: self.best(m.group()), visible(text)))


def bigrams(run: str) -> list[tuple[str, str]]:
    """Bigrams of a run that is written in one script, with its start."""
    base = [c for c in run if not unicodedata.combining(c)]
    scripts = {script(c) for c in base}
    if len(scripts) != 1:
        return []
    return [("^" + scripts.pop(), base[0]), *zip(base, base[1:])]


def learn(texts: DataFrame, text: str = "text") -> Model:
    """Bigram counts over every run of every text. The table is bounded by the square of the alphabet."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: Counter = Counter()
        seen: Counter = Counter()

        def flush() -> None:
            for run, n in runs.items():
                for pair in bigrams(run):
                    seen[pair] += n
            runs.clear()

        for pdf in batches:
            for t in pdf["t"]:
                runs.update(_RUN.findall(visible(t)))
            if len(runs) > 200_000:
                flush()
        flush()
        if seen:
            yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["a", "b", "n"])

    rows = texts.select(F.col(text).alias("t")).where("t is not null and t != ''").mapInPandas(count, "a string, b string, n long")
    sums = rows.groupBy("a", "b").agg(F.sum("n").alias("n"))
    letters = lambda c: (len(c[-1]) == 1) and script(c[-1]) != "O"
    return Model({(r["a"], r["b"]): r["n"] for r in sums.collect() if letters(r["a"]) and letters(r["b"])})


def canonical_udf(model: Model) -> Callable:
    """Column function that gives the consistent form of a text."""
    score = model.score
    key = hash(frozenset(score.items()))

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if _tables.get("key") != key:  # a worker keeps the model and the runs it has seen from task to task
            _tables["key"], _tables["model"] = key, Model({})
            _tables["model"].score = score
        m = _tables["model"]
        for s in batches:
            yield s.map(lambda t: None if t is None else m.canonical(t))

    return run


def same_look(df: DataFrame, id_col: str, within: list[str], canonical: str = "canonical", text: str = "text") -> DataFrame:
    """Pairs of ids in one group of ``within`` whose texts differ and share a canonical form.

    Only digests are shuffled. Distinct texts of a look are paired first and ids join them afterwards, so that copies of
    one text never meet each other.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in within], F.lit(""))).alias("grp"), F.md5(F.col(canonical)).alias("look"), F.md5(F.col(text)).alias("exact"))
    rows = rows.where("look is not null")
    texts = rows.select("grp", "look", "exact").distinct()
    pairs = texts.alias("a").join(texts.alias("b"), (F.col("a.grp") == F.col("b.grp")) & (F.col("a.look") == F.col("b.look")) & (F.col("a.exact") < F.col("b.exact")))
    pairs = pairs.select("a.grp", F.col("a.exact").alias("x"), F.col("b.exact").alias("y"))
    ids = rows.select("id", "grp", "exact").distinct()
    first = pairs.join(ids.select("grp", F.col("exact").alias("x"), F.col("id").alias("p")), ["grp", "x"])
    both = first.join(ids.select("grp", F.col("exact").alias("y"), F.col("id").alias("q")), ["grp", "y"]).where("p != q")
    return both.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()
