"""Repair of text from scanned pages.

1. *Edge lines.* Lines near the top and bottom of a file's pages that come again on other pages of the file, also
   misread or with a page number in them, are running lines; lines with the page's number and nothing else are
   page numbers. This is decided file by file.
2. *Hyphen evidence.* A word cut at a line's end is joined if the joined word occurs more often elsewhere than the
   hyphenated compound; counts come from all pages of all files.
3. *Anagram hashing.* Every word has a hash that is the sum of its characters' hashes, so a confusion such as
   ``rn`` for ``m`` shifts it by a constant. Rare words are joined in SQL with frequent ones whose hash differs by up to
   three known confusions: frequent words, the fewer ones, stand under their shifts by none, one or two, rare words look
   for theirs by none or one. A candidate counts if the confusions really turn one word into the other, at most one for
   every two letters beyond the second, and it is at least ``ratio`` times as frequent. Words on pages that were read with
   low ``confidence`` count less, so a form that stands on bad pages only is corrected on less evidence. Corrections are
   ranked by the number of confusions, then by frequency. ``confusions`` lists what may be read as what. Numbers with
   letters in them are joined with frequent numbers by what a digit may be read as.
4. *Without a frequent form.* A misread number or a word with a stray sign that the join leaves is turned back
   character by character; labels such as ``12b`` and words with more letters than digits stay as they were read.

Defined results: only ``ocr`` pages are repaired, all pages give counts; null pages and texts give nothing; blank
pages give an empty text; a file that comes twice counts once; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.runtime import cut, spread

#: What a character may be read as.
CONFUSIONS = "a>@ l>1 i>1 e>c n>ri k>lc t>† m>rn ı>l i>l d>cl u>ii y>v o>0 z>2 g>9 h>lı h>li ş>$ s>5 b>8 r>r·"
#: Letters a digit may be read as.
DIGITS = {"o": "0", "O": "0", "l": "1", "I": "1", "i": "1", "ı": "1", "z": "2", "Z": "2", "S": "5", "s": "5", "B": "8", "b": "6", "g": "9"}
PAGE_WORDS = ("sayfa", "sf", "s", "syf", "page", "p", "pg", "seite", "no")

LINE = "file_id long, page_number int, line_no int, is_ocr boolean, weight double, kind string, text string"
TOKEN = "file_id long, page_number int, line_no int, token_no int, is_ocr boolean, weight double, raw string, key string, compound string, cut int, sure boolean"

_EDGE = " .,;:!?()\"'[]{}“”‘’…"
_HYPHEN = re.compile(r"(?<=\w)([-‐‑¬­])\s*$")
_PAIRS = [tuple(c.split(">")) for c in CONFUSIONS.split()]


def lower(text: str) -> str:
    """Lower case with the Turkish rule for I."""
    return text.replace("İ", "i").replace("I", "ı").lower()


_DIGIT_PAIRS = sorted({(d, lower(c)) for c, d in DIGITS.items()})


def skeleton(text: str) -> str:
    """What is left of a line when confusable readings fall together; digits and blanks do not count."""
    s = lower(text).replace("·", "").replace("†", "t").replace("@", "a").replace("$", "ş")
    for a, b in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("lc", "k"), ("ii", "u"), ("lı", "h"), ("li", "h")):
        s = s.replace(b, "~").replace(a, b).replace("~", b)
    table = str.maketrans({"1": "i", "l": "i", "ı": "i", "0": "o", "c": "e", "2": "z", "9": "g", "5": "s", "8": "b", "v": "y"})
    return re.sub(r"[\W\d_]", "", s.translate(table))


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def _roman(s: str) -> int | None:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    s = s.lower().replace("1", "i").replace("ı", "i")
    if not s or any(c not in value for c in s):
        return None
    total = 0
    for c, d in zip(s, [*s[1:], "i"]):
        total += -value[c] if value[c] < value[d] else value[c]
    return total


def _number(s: str) -> int | None:
    digits = "".join(DIGITS.get(c, c) for c in s)
    return int(digits) if digits.isascii() and digits.isdigit() and len(digits) < 6 else None


_PAGE = re.compile(r"^[\s\-–—\[\(|.]*(?:(?P<word>[^\W\d_][^\s\d]*?)[.:]?\s+)?(?P<n>[0-9OoIlıiSsBZz]{1,5})(?:\s*(?:/|von|of|-)\s*(?P<m>[0-9OoIlıiSsBZz]{1,5}))?[\s\-–—\]\)|.]*$")


def page_number_of(line: str) -> tuple[int, bool] | None:
    """Number that a line holds, and whether the line has more than the bare number; None for any other line."""
    bare = line.strip()
    m = _PAGE.match(line)
    if m and (n := _number(m["n"])) is not None and (any(c.isdigit() for c in bare) or m["word"] or m["m"] or bare[0] in "-[(" or len(bare) == 1):
        word = m["word"]
        if word and not any(distance(skeleton(word), skeleton(w), 1 if len(w) > 3 else 0) <= (1 if len(w) > 3 else 0) for w in PAGE_WORDS):
            return None
        return n, bool(word or m["m"] or bare[0] in "-[(")
    if (n := _roman(bare.strip("-–—[]() ."))) is not None:
        return n, False
    return None


_TAIL = re.compile(r"\s{2,}[-–\[(]?[0-9OoIlıS]{1,4}[-–\])]?\s*$|^\s*[-–\[(]?[0-9OoIl]{1,4}[-–\])]?\s{2,}")


def edge_kinds(pages: list[tuple[int, list[str]]], depth: int = 3) -> dict[tuple[int, int], str]:
    """``running_line`` or ``page_number`` for lines ``(page index, line index)`` of one file."""
    kinds: dict[tuple[int, int], str] = {}
    sides: dict[str, list] = {"top": [], "bottom": []}
    for i, (number, lines) in enumerate(pages):
        filled = [k for k, line in enumerate(lines) if line.strip()]
        for side, order in (("top", filled), ("bottom", filled[::-1])):
            for rank, k in enumerate(order[:depth]):
                sides[side].append((i, k, rank, number, lines))
    numbers = []
    for side, rows in sides.items():
        for i, k, rank, number, lines in rows:
            if rank < 2 and (found := page_number_of(lines[k])):
                numbers.append((found[0] - number, i, k, found[1], side))
    offsets: dict[tuple[int, str], set[int]] = defaultdict(set)
    for off, i, _, _, side in numbers:
        offsets[off, side].add(i)
    for off, i, k, marked, side in numbers:
        agreed = len(offsets[off, side])
        if off == 0 or marked and (agreed >= 2 or max((len(p) for (o, s), p in offsets.items() if s == side and o != off), default=0) < 2 or "/" in pages[i][1][k]) or not marked and agreed >= 3:
            kinds[i, k] = "page_number"
    for side, rows in sides.items():
        groups: list[tuple[str, set[int], list]] = []
        for i, k, rank, _, lines in rows:
            line = _TAIL.sub("", lines[k]).strip()
            if (i, k) in kinds or not line or not any(c.isalpha() for c in line):
                continue
            plain = re.sub(r"[^\w.]", "", line)
            if (line.endswith((".", ",", ";")) or line[0].islower()) and " " in line or line[0].islower() and "." not in plain.strip("."):
                continue
            following = next((x for x in lines[k + 1 :] if x.strip()), "")
            if " " not in line and re.fullmatch(r"[\d.,OolI]+", following.strip()) and (page_number_of(following) is None or page_number_of(following)[0] != pages[i][0]):
                continue
            sk, digits = skeleton(line), re.sub(r"\D", "", line)
            if len(sk) < 2:
                continue
            for name, where, members in groups:
                if distance(name[0], sk, max(1, len(sk) // 5) if len(sk) > 5 else 0) <= (max(1, len(sk) // 5) if len(sk) > 5 else 0) and (len(sk) > 5 or name[1] == digits):
                    where.add(i)
                    members.append((i, k))
                    break
            else:
                groups.append(((sk, digits), {i}, [(i, k)]))
        for _, where, members in groups:
            if len(where) > 1:
                kinds.update({m: "running_line" for m in members})
    return kinds


def page_weight(confidence: float | None) -> float:
    """What a word of a page counts: its confidence in hundredths, at least 0.3; 1 where it is not known."""
    return 1.0 if confidence is None or not 0 <= confidence <= 100 else max(0.3, confidence / 100)


def page_lines(df: DataFrame) -> DataFrame:
    """Every line of every page with its kind: ``text``, ``running_line`` or ``page_number``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, pages in zip(pdf["file_id"], pdf["pages"]):
                split = [(p["page_number"] if p["page_number"] is not None else n, p["text"].split("\n"), p["extract_method"], page_weight(p["confidence"])) for n, p in enumerate(pages, 1) if p is not None and p["text"] is not None]
                kinds = edge_kinds([(n, lines) for n, lines, *_ in split])
                for i, (n, lines, method, weight) in enumerate(split):
                    rows += [(file_id, n, k + 1, method == "ocr", weight, kinds.get((i, k), "text"), line) for k, line in enumerate(lines)]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINE.split(", ")])

    once = df.select(F.col("file_id").cast("long").alias("file_id"), F.transform("pages", lambda p: F.struct(p["page_number"].cast("int").alias("page_number"), p["text"].alias("text"), p["extract_method"].alias("extract_method"), p["confidence"].cast("double").alias("confidence"))).alias("pages"))
    once = once.where("file_id is not null and pages is not null")
    return spread(once, "file_id").dropDuplicates(["file_id"]).mapInPandas(run, LINE)


def tokens(lines: DataFrame) -> DataFrame:
    """Words of the text lines; a word cut at a line's end comes once, joined, with its hyphenated form beside it."""
    page = Window.partitionBy("file_id", "page_number").orderBy("line_no")
    near = spread(lines.where("kind = 'text'"), "file_id", "page_number").withColumn("next_no", F.lead("line_no").over(page)).withColumn("next_text", F.lead("text").over(page)).withColumn("before_no", F.lag("line_no").over(page)).withColumn("before_text", F.lag("text").over(page))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                words = r.text.split()
                before = r.before_text if r.before_no == r.line_no - 1 and _HYPHEN.search(r.before_text or "") else None
                after = r.next_text if r.next_no == r.line_no + 1 else None
                for k, raw in enumerate(words):
                    if k == 0 and before and words[0][0].isalnum():
                        continue
                    word = raw.strip(_EDGE)
                    hyphen = _HYPHEN.search(raw) if k == len(words) - 1 else None
                    rest = after.split() if hyphen and after else []
                    if rest and rest[0][0].isalnum():
                        head, tail = raw[: hyphen.start()].lstrip(_EDGE), rest[0].rstrip(_EDGE)
                        sure = hyphen.group(1) in "¬­"
                        compound = None if sure else lower(head + "-" + tail)
                        rows.append((r.file_id, r.page_number, r.line_no, k, r.is_ocr, r.weight, raw[: hyphen.start()] + rest[0], lower(head + tail), compound, len(head), sure))
                    elif word:
                        rows.append((r.file_id, r.page_number, r.line_no, k, r.is_ocr, r.weight, raw, lower(word), None, None, False))
            if rows:
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in TOKEN.split(", ")])
                out["cut"] = out["cut"].astype("Int32")
                yield out

    return near.mapInPandas(run, TOKEN)


def vocabulary(words: DataFrame) -> DataFrame:
    """How often each word stands uncut on any page, and that weighed by the pages' confidence."""
    return words.where("cut is null").groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))


def resolve_cuts(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Hyphen evidence for cut words: ``joined`` true, false or null where neither form is known."""
    cuts = words.where("cut is not null")
    forms = cuts.select("key", "compound", "sure").distinct()
    vocab = vocab.select("key", "n")
    forms = forms.join(vocab.withColumnRenamed("n", "n_word"), "key", "left")
    forms = forms.join(vocab.select(F.col("key").alias("compound"), F.col("n").alias("n_compound")), "compound", "left").fillna(0, ["n_word", "n_compound"])
    number = F.coalesce(F.col("compound").rlike(r"^\d+-\d"), F.lit(False))
    joined = F.when(F.col("sure"), True).when(number, False).when(F.col("n_compound") > F.col("n_word"), False).when(F.col("n_word") > 0, True)
    return forms.select("key", "compound", joined.alias("joined"))


def _anagram(word: Column) -> Column:
    """Sum of the characters' hashes: the same for all anagrams, and additive."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, lambda c: F.shiftright(F.xxhash64(c), 14)), F.lit(0).cast("long"), lambda a, x: a + x)


def turns_into(word: str, seen: str, most: int = 3, confusions: list[tuple[str, str]] = _PAIRS) -> int | None:
    """Number of confusions that turn ``word`` into ``seen``; None if they cannot."""
    pairs = confusions if any(c.isalpha() for c in word) else _DIGIT_PAIRS
    best: dict[tuple[int, int], int] = {(0, 0): 0}
    for i in range(len(word) + 1):
        for j in range(len(seen) + 1):
            n = best.get((i, j))
            if n is None or n > most:
                continue
            if i < len(word) and j < len(seen) and word[i] == seen[j]:
                best[i + 1, j + 1] = min(n, best.get((i + 1, j + 1), n))
            for a, b in pairs:
                if word.startswith(a, i) and seen.startswith(b, j):
                    at = (i + len(a), j + len(b))
                    best[at] = min(n + 1, best.get(at, n + 1))
    return best.get((len(word), len(seen)))


def _shifts(spark: SparkSession, pairs: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """One row each with the hash shifts of at most one, and of at most two confusions."""
    single = spark.createDataFrame([*pairs, ("", "")], "a string, b string").select((_anagram(F.col("b")) - _anagram(F.col("a"))).alias("d")).distinct()
    double = single.alias("x").join(single.alias("y"), F.col("x.d") <= F.col("y.d")).select((F.col("x.d") + F.col("y.d")).alias("d"))  # about 25 by 25
    row = lambda df: df.distinct().agg(F.collect_list("d").alias("shifts"))
    return row(single), row(double)


def corrections(vocab: DataFrame, ratio: int = 10, confusions: str = CONFUSIONS) -> DataFrame:
    """Ranked corrections ``(key, correct, confusions)`` of misread words ``vocab(key, n, w)``, one per word."""
    spark = vocab.sparkSession
    pairs = [tuple(c.split(">")) for c in confusions.split()]
    hashed = cut(vocab.where("length(key) > 1").withColumn("h", _anagram(F.col("key"))), "anagrams")
    number = F.col("key").rlike(_NUMBER) & ~F.col("key").rlike(_LABEL)
    digits = F.col("key").rlike(r"^[\d.,/-]+$")
    frequent = hashed.where(~number & (F.col("n") >= ratio)).select(F.col("key").alias("correct"), "h", F.col("n").alias("m"), F.col("w").alias("mw"), digits.alias("digits"))
    rare = hashed.select("key", "h", "w", number.alias("number"))
    most = frequent.agg(F.max("mw").alias("top"))  # one row
    rare = rare.join(F.broadcast(most), F.col("w") * ratio <= F.col("top")).drop("top")

    def met(kind: bool, shifts: tuple[DataFrame, DataFrame]) -> DataFrame:
        few, many = (F.broadcast(x) for x in shifts)  # one row each
        right = frequent.where("digits") if kind else frequent
        right = right.join(many).select("correct", "m", "mw", "h", F.explode("shifts").alias("d")).select("correct", "m", "mw", (F.col("h") + F.col("d")).alias("h"))
        wrong = rare.where("number") if kind else rare
        wrong = wrong.join(few).select("key", "w", "h", F.explode("shifts").alias("d")).select("key", "w", (F.col("h") - F.col("d")).alias("h"))
        return wrong.join(right, "h").where((F.col("mw") >= ratio * F.col("w")) & (F.col("correct") != F.col("key"))).select("key", "correct", "m")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = [turns_into(c, s, min(3, max(2, len(c) // 2)), pairs) for c, s in zip(pdf["correct"], pdf["key"])]
            out = pdf.assign(confusions=pd.array(k, dtype="Int32"))
            yield out[out["confusions"].notna()][["key", "correct", "m", "confusions"]]

    both = met(False, _shifts(spark, pairs)).unionByName(met(True, _shifts(spark, _DIGIT_PAIRS)))
    good = both.distinct().mapInPandas(check, "key string, correct string, m long, confusions int")
    best = good.groupBy("key").agg(F.min(F.struct("confusions", (-F.col("m")).alias("m"), "correct")).alias("b"))
    return best.select("key", F.col("b.correct").alias("correct"), F.col("b.confusions").alias("confusions"))


_STRAY = re.compile(r"[^\W\d_]+(?:[@†$][^\W\d_]+|[^\W\d_]*·[^\W\d_]*)[^\W\d_]*$")  # _INNER for re
_INNER = r"^\p{L}+(?:[@†$]\p{L}+|\p{L}*·\p{L}*)\p{L}*$"
_NUMBER = r"^(?=.*\d)(?=.*[oılisbz])[\doılisbz]+(?:[.,/-][\doılisbz]+)*$"
#: Forms of _NUMBER with a part that letters may belong to: 12b, 5l, b12, 5/b.
_LABEL = r"(?:^|[.,/-])(?:\d{1,2}[bls]|[bis]\d{1,2}|[bisz]+)(?:$|[.,/-])"


class Repair:
    """The steps over a table of documents; intermediate results are written once and shared."""

    def __init__(self, documents: DataFrame, ratio: int = 10, confusions: str = CONFUSIONS):
        self.lines = cut(page_lines(documents), "page-lines")
        self.words = cut(tokens(self.lines), "page-words")
        vocab = cut(vocabulary(self.words), "vocabulary")
        cuts = resolve_cuts(self.words, vocab)
        unknown = cuts.where("joined is null")
        unknown = unknown.select("key").union(unknown.select("compound")).where("key is not null").distinct().join(vocab, "key", "left_anti")
        counted = vocab.unionByName(unknown.select("key", F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("w")))
        self.fixes = cut(corrections(counted, ratio, confusions), "corrections")
        known = self.fixes.select("key", F.lit(True).alias("word_fixed"))
        other = self.fixes.select(F.col("key").alias("compound"), F.lit(True).alias("compound_fixed"))
        decided = cuts.join(known, "key", "left").join(other, "compound", "left")
        compound = F.coalesce(F.col("compound_fixed"), F.lit(False)) & ~F.coalesce(F.col("word_fixed"), F.lit(False))
        self.cuts = cut(decided.select("key", "compound", F.coalesce("joined", ~compound).alias("joined")).distinct(), "cuts")

    def _decided(self) -> DataFrame:
        cuts = self.cuts.withColumn("compound", F.coalesce("compound", F.lit("")))
        w = self.words.where("is_ocr").withColumn("compound", F.coalesce("compound", F.lit("")))
        w = w.join(cuts, ["key", "compound"], "left")
        form = F.when(F.col("cut").isNotNull() & ~F.col("joined"), F.col("compound")).otherwise(F.col("key"))
        return w.withColumn("form", form).join(self.fixes.withColumnRenamed("key", "form"), "form", "left")

    def found(self) -> DataFrame:
        """``(file_id, page_number, line_no, noise_kind)`` of every noisy line of an ``ocr`` page."""
        edge = self.lines.where("is_ocr and kind != 'text'").select("file_id", "page_number", "line_no", F.col("kind").alias("noise_kind"))
        w = self._decided()
        split = w.where("cut is not null and joined").select("file_id", "page_number", "line_no", F.lit("split_word").alias("noise_kind"))
        bad = F.col("correct").isNotNull() | F.col("form").rlike(_INNER) | F.col("form").rlike(_NUMBER)
        first = _first_difference("form", "correct")
        late = F.col("cut").isNotNull() & (F.coalesce(first, F.lit(0)) >= F.col("cut") + F.when(F.col("joined"), 0).otherwise(1))
        misread = w.where(bad).select("file_id", "page_number", (F.col("line_no") + F.when(late, 1).otherwise(0)).cast("int").alias("line_no"), F.lit("misread").alias("noise_kind"))
        return edge.unionByName(split).unionByName(misread).distinct()

    def pages(self) -> DataFrame:
        """Continuous paragraphs ``(file_id, page_number, text)`` of every ``ocr`` page."""
        w = self._decided().select("file_id", "page_number", "line_no", "token_no", "raw", "form", "correct", "cut", "joined")
        text = self.lines.where("is_ocr").withColumn("blank", (F.trim("text") == "") & (F.col("kind") == "text"))
        per_line = text.groupBy("file_id", "page_number").agg(F.array_sort(F.collect_list(F.when(F.col("blank"), F.col("line_no")))).alias("blanks"))
        per_page = w.groupBy("file_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("line_no", "token_no", "raw", "form", "correct", "cut", "joined"))).alias("words"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"file_id": pdf["file_id"], "page_number": pdf["page_number"], "text": [_paragraphs(a, b) for a, b in zip(pdf["words"], pdf["blanks"])]})

        return per_line.join(per_page, ["file_id", "page_number"], "left").select("file_id", "page_number", "words", "blanks").mapInPandas(run, "file_id long, page_number int, text string")


def _first_difference(a: str, b: str) -> Column:
    """0-based place of the first character in which two columns differ."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b)))
    same = F.transform(at, lambda i: F.when(F.substring(F.col(a), i, F.lit(1)) != F.substring(F.col(b), i, F.lit(1)), i))
    return F.array_min(same) - 1


def _recased(raw: str, word: str) -> str:
    """The correction with the edges and the capital of what was read."""
    core = raw.strip(_EDGE)
    lead = raw[: raw.find(core)] if core else ""
    tail = raw[len(lead) + len(core) :]
    if core[:1].isupper():
        word = {"i": "İ", "ı": "I"}.get(word[:1], word[:1].upper()) + word[1:]
    return lead + word + tail


def _turned_back(raw: str) -> str:
    """A misread number or a word with a stray sign, character by character; anything else as it is."""
    core = raw.strip(_EDGE)
    word = lower(core)
    if re.match(_NUMBER, word):
        digits = sum(c.isdigit() for c in core)
        if re.search(_LABEL, word) or 2 * digits < sum(c.isalnum() for c in core) and re.search("[ısbziİ]", core):
            return raw
        return raw.replace(core, "".join(DIGITS.get(c, c) for c in core))
    if _STRAY.match(word):
        letters = str.maketrans({"@": "A", "†": "T", "$": "Ş", "·": ""} if core.isupper() else {"@": "a", "†": "t", "$": "ş", "·": ""})
        return raw.replace(core, core.translate(letters))
    return raw


def _paragraphs(words, blanks) -> str:
    if words is None:
        return ""
    out: list[list[str]] = [[]]
    stops = [b for b in blanks if b is not None]
    at = 0
    for w in words:
        while at < len(stops) and stops[at] < w["line_no"]:
            at += 1
            if out[-1]:
                out.append([])
        raw = w["raw"]
        if w["correct"]:
            out[-1].append(_recased(raw, w["correct"]))
        elif w["cut"] is not None and not pd.isna(w["cut"]):
            out[-1].append(_turned_back(_recased(raw, w["form"])))
        else:
            out[-1].append(_turned_back(raw))
    return "\n\n".join(" ".join(p) for p in out if p)
