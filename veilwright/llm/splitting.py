"""Splitting oversized texts by lexical cohesion.

The text is cut into sentences. Around every sentence end a block of sentences on either side is compared by the
cosine of its word counts; a valley of that similarity marks a change of topic, and its depth is how far the
similarity rises again on both sides. A piece ends at the deepest valley in its size window, page and paragraph ends
counting deeper than sentence ends alone; without a sentence end in the window it ends at a word end, and only a
text without any break is cut at the limit (never between a letter and its combining marks or inside a CR LF).
Every piece after the first starts with about ``overlap`` code points of the one before, from a word's start.

Defined results: null and empty texts have no pieces; a text within the limit is one piece; dropping the first
``overlap`` code points of each piece and joining gives back the text exactly; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = "piece_no int, start_pos int, end_pos int, overlap int, boundary string, piece string"

_BREAK = re.compile(r"(?P<page>\s*\f\s*)|(?P<paragraph>[^\S\n\f]*(?:\r?\n[^\S\n\f]*){2,})|(?P<line>[^\S\n\f]*\r?\n[^\S\n\f]*)|(?P<sentence>(?<=[.!?…;:])[\"'”’)\]]*[^\S\n\f]+|(?<=[。！？]))")
_WORD = re.compile(r"\w{3,}")
_GAP = re.compile(r"\s+")
_BONUS = {"page": 3.0, "paragraph": 1.0, "line": 0.25, "sentence": 0.25}


def natural_ends(text: str) -> tuple[list[int], list[str]]:
    """Ends of pages, paragraphs, lines and sentences, in order; a break belongs to what stands before it."""
    at, kind = [], []
    for m in _BREAK.finditer(text):
        if 0 < m.end() < len(text) and (not at or m.end() > at[-1]):
            at.append(m.end())
            kind.append(m.lastgroup)
    return at, kind


def depths(text: str, ends: list[int], block: int = 6) -> list[float]:
    """Depth of the similarity valley at each end."""
    cuts = [0, *ends, len(text)]
    bags = [Counter(w[:6] for w in _WORD.findall(text[a:b].lower())) for a, b in zip(cuts, cuts[1:])]
    sims = []
    left, right = Counter(), Counter()
    for b in bags[:block]:
        right.update(b)
    for i in range(1, len(bags)):
        moved = bags[i - 1]
        left.update(moved)
        right.subtract(moved)
        if i + block - 1 < len(bags):
            right.update(bags[i + block - 1])
        if i > block:
            left.subtract(bags[i - block - 1])
        small, big = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(n * big[w] for w, n in small.items() if n)
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        sims.append(dot / norm if norm else 0.0)
        if i % 64 == 0:
            left, right = +left, +right
    rise_left, rise_right = [], []
    for side, out in ((sims, rise_left), (sims[::-1], rise_right)):
        top = 0.0
        for s, before in zip(side, [None, *side]):
            top = s if before is None or s >= before else max(top, before)
            out.append(top - s)
    return [a + b for a, b in zip(rise_left, rise_right[::-1])]


def _word_end(text: str, low: int, high: int) -> int | None:
    """The last end of blanks in ``(low, high]``."""
    at = high
    while at > low:
        if text[at - 1].isspace() and not (at < len(text) and text[at].isspace()):
            return at
        at -= 1
    return None


def _hard_end(text: str, low: int, high: int) -> int:
    at = high
    while at > low + 1 and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1 : at + 1] == "\r\n"):
        at -= 1
    return at if at > low + 1 else high


def _overlap_start(text: str, low: int, end: int, overlap: int) -> int:
    """A word's start near ``end - overlap``, else exactly there."""
    want = max(low, end - overlap)
    for d in range(overlap // 3):
        for at in (want - d, want + d):
            if low < at < end and text[at - 1].isspace() and not text[at].isspace():
                return at
    return _hard_end(text, low, want) if want > low + 1 else want


def split(text: str, limit: int = 2000, overlap: int = 150) -> list[tuple]:
    """Pieces ``(piece_no, start, end, overlap, boundary, piece)``; ``start`` counts the overlap in."""
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text), 0, "end", text)]
    ends, kinds = natural_ends(text)
    score = [d + _BONUS[k] for d, k in zip(depths(text, ends), kinds)]
    out: list[tuple] = []
    start = done = 0
    while True:
        if len(text) - start <= limit:
            out.append((len(out), start, len(text), done - start, "end", text[start:]))
            return out
        high = start + limit
        low = max(done, start + limit // 2)
        a, b = bisect.bisect_right(ends, low), bisect.bisect_right(ends, high)
        if a == b:
            a = bisect.bisect_right(ends, done)
            a = max(a, b - 1)
        if a < b and ends[a] > done:
            best = max(range(a, b), key=lambda i: (score[i], ends[i]))
            end, kind = ends[best], kinds[best]
        else:
            word = _word_end(text, done, high)
            end, kind = (word, "word") if word is not None else (_hard_end(text, done, high), "none")
        out.append((len(out), start, end, done - start, kind, text[start:end]))
        start, done = _overlap_start(text, max(start, end - 2 * overlap), end, overlap), end


def split_table(df: DataFrame, keys: list[str], text: str, limit: int = 2000, overlap: int = 150) -> DataFrame:
    """Pieces of every row's whole text, with ``keys``."""
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be less than half the limit")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*keys, "piece_no", "start_pos", "end_pos", "overlap", "boundary", "piece"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for *key, t in zip(*(pdf[k] for k in keys), pdf["_text"]):
                for p in split(t, limit, overlap) if t else ():
                    rows.append((*key, *p))
                    size += len(p[-1])
                    if size > 4_000_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return df.select(*keys, F.col(text).alias("_text")).mapInPandas(run, f"{head}, {PIECE}")
