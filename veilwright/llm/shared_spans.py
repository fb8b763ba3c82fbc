"""Long exact spans shared between records: a log-structured index of window fingerprints.

Every window of ``length`` code points elects the smallest hash among its ``length - gram + 1`` gram hashes, the
left one of equals. Consecutive windows with the same elected gram form a *context*: the text from the first such
window to the end of the last. A passage of at least ``length`` code points that stands in two records elects the
same grams in both, so only contexts with an elected gram in common need to be compared. A record yields about two
contexts per ``length - gram`` code points.

The index has tables of immutable sorted runs, one run per batch: the *texts* by record, *places* ``(gram hash m, digest c, doc_id, x, n)``
of all contexts by gram, and *classes* of equal contexts ``(m, c)`` with the smallest and largest record and one place. ``c`` is
a cryptographic digest of the context's text, so that ``m`` and ``c`` are 128 bits. Rows of one gram are split over parts by record, and a class is one row
however often it occurs, so a notice that stands everywhere is no hot key.

:meth:`SpanIndex.add` writes a batch's run and merge-joins its grams with the earlier runs, bucket by bucket:

* A class that becomes shared by the batch is shared as a whole: its places in the batch, and its places in the one
  earlier record if it was not shared before, are matches.
* Where a gram of the batch is shared but contexts differ, one text of each differing context is fetched, its windows
  are compared with those of the others, and equal ones are verified code point by code point. Groups of more than
  ``group_limit`` differing contexts are compared by an aggregation over digests of their windows' texts instead of
  inside one task; both ways find the same windows.

Matches are appended; earlier runs are read but never shuffled or rewritten by a batch. :meth:`SpanIndex.compact` merges
the runs, by itself once there are more than ``fan_in``, and keeps the places of a shared class in one record only, for
comparisons, as no later batch can add to the others. :meth:`SpanIndex.coverage` joins the matches of each record into maximal runs.

Defined results: null and shorter texts have no runs; copies of a text are covered whole; passages repeated only
inside one record do not count; a ``doc_id`` that comes twice counts as one record; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilwright.operators.skew import SALTS, salt
from veilwright.runtime import cut, drop_path, empty, release, scratch

CONTEXT = "m long, c long, doc_id long, x int, n int"
INTERVAL = "doc_id long, start_pos int, end_pos int"

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 14) * 2
        base = int(_BASES[which])
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, dtype=_U)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=_U))
        have = _powers[which] = (made[0], made[1])
    return have


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _MIX[1]
    return h ^ (h >> _U(29))


class Prefix:
    """Polynomial prefix sums over code points: the hash of any slice in constant time."""

    def __init__(self, codes: np.ndarray, which: int):
        pw, self.inv = _pow(which, len(codes) + 1)
        v = (codes.astype(_U) + _U(1 + which)) * _MIX[which]
        v ^= v >> _U(29)
        self.sums = np.zeros(len(codes) + 1, dtype=_U)
        np.cumsum(v * pw[: len(codes)], out=self.sums[1:])

    def slices(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.inv[a])


BLOCK = 1 << 22


def elected(codes: np.ndarray, length: int, gram: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the gram that each window elects, a block of windows at a time."""
    places, hashes = [], []
    windows, width = len(codes) - length + 1, length - gram + 1
    for s in range(0, windows, block):
        part = codes[s : min(windows, s + block) + length - 1]
        first = Prefix(part, 0)
        grams = len(part) - gram + 1
        h = _mixed((first.sums[gram:] - first.sums[:grams]) * first.inv[:grams])
        best = (h & ~_U(0xFFFFFFF)) | np.arange(grams, dtype=_U)  # places in a block need fewer than 28 bits
        have = 1
        while have * 2 <= width:
            best = np.minimum(best[:-have], best[have:])
            have *= 2
        if have < width:
            best = np.minimum(best[: grams - width + 1], best[width - have :])
        at = (best & _U(0xFFFFFFF)).astype(np.int64)
        places.append(at + s)
        hashes.append(h[at])
    return np.concatenate(places), np.concatenate(hashes)


def contexts(codes: np.ndarray, length: int, gram: int, block: int = BLOCK) -> tuple | None:
    """``(m, c, x, n, anchor)`` of each context: windows x .. x + n elect the gram with hash m at ``anchor``."""
    if len(codes) < length:
        return None
    at, h = elected(codes, length, gram, block)
    x = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[x[1:], len(at)] - 1
    raw = memoryview(np.ascontiguousarray(codes)).cast("B")
    c = b"".join(hashlib.blake2b(raw[4 * a : 4 * b], digest_size=8).digest() for a, b in zip(x.tolist(), (last + length).tolist()))
    return h[x].view(np.int64), np.frombuffer(c, dtype=np.int64), x, last - x, at[x]


def _fingerprints(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, ids = [], []
            for doc_id, text in zip(pdf["doc_id"].to_numpy(), pdf["text"]):
                found = contexts(codes_of(text), length, gram)
                if found is not None:
                    parts.append(found)
                    ids.append(np.full(len(found[0]), doc_id, dtype=np.int64))
            if parts:
                m, c, x, n, _ = (np.concatenate(z) for z in zip(*parts))
                yield pd.DataFrame({"m": m, "c": c, "doc_id": np.concatenate(ids), "x": x.astype(np.int32), "n": n.astype(np.int32)})

    return run


def _texts_of(length: int, gram: int):
    """Text of each wanted context of a record, with the place of its elected gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, wants in zip(pdf["text"], pdf["wants"]):
                for w in wants:
                    part = text[w["x"] : w["x"] + w["n"] + length]
                    at, _ = elected(codes_of(part), length, gram)
                    rows.append((w["m"], w["c"], w["lo"], w["hi"], w["n"], int(at[0]), w["large"], part))
            if rows:
                yield pd.DataFrame(rows, columns=["m", "c", "lo", "hi", "n", "anchor", "large", "part"])

    return run


PART = "m long, c long, lo long, hi long, n int, anchor int, large boolean, part string"


def _windows(pdf: pd.DataFrame, length: int) -> tuple[np.ndarray, ...]:
    """Hashes of every window of every context: context number, offset to the elected gram, two hashes, place."""
    codes = [codes_of(p) for p in pdf["part"]]
    sizes = np.array([len(c) for c in codes])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    flat = np.concatenate(codes)
    one, two = Prefix(flat, 0), Prefix(flat, 1)
    count = pdf["n"].to_numpy() + 1
    who = np.repeat(np.arange(len(pdf)), count)
    step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    place = starts[who] + step
    offset = step - pdf["anchor"].to_numpy()[who]
    return who, offset, step, place, one.slices(place, place + length), two.slices(place, place + length), flat


def shared_windows(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of windows of each context that stand in another record too, verified on the text.

    ``pdf`` holds whole groups of equal ``m``. Result: ``(m, c, a, b)``, code points a .. b of the context.
    """
    who, offset, step, place, h1, h2, flat = _windows(pdf, length)
    group = pd.factorize(pdf["m"])[0][who]
    order = np.lexsort((h2, h1, offset, group))
    g, o, p, q, w = group[order], offset[order], h1[order], h2[order], who[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
    at = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    lo, hi = pdf["lo"].to_numpy()[w], pdf["hi"].to_numpy()[w]
    several = (np.minimum.reduceat(lo, at) != np.maximum.reduceat(hi, at))[run]
    partner = np.where(new, np.r_[order[1:], order[-1]], np.r_[order[0], order[:-1]])
    flag = np.zeros(len(who), dtype=bool)
    flag[order] = several
    with_whom = np.empty(len(who), dtype=np.int64)
    with_whom[order] = partner
    single = (pdf["lo"].to_numpy() == pdf["hi"].to_numpy())[who]
    flag &= single
    edge = flag & (np.r_[True, ~flag[:-1]] | np.r_[~flag[1:], True] | (step % (length // 2) == 0) | np.r_[True, who[1:] != who[:-1]])
    for part in np.array_split(np.flatnonzero(edge), max(1, int(edge.sum()) // 20_000)):
        span = np.arange(length)
        same = (flat[place[part][:, None] + span] == flat[place[with_whom[part]][:, None] + span]).all(axis=1)
        flag[part[~same]] = False
    begin = np.flatnonzero(flag & np.r_[True, ~flag[:-1] | (who[1:] != who[:-1])])
    end = np.flatnonzero(flag & np.r_[~flag[1:] | (who[1:] != who[:-1]), True])
    rows = pdf.iloc[who[begin]]
    return pd.DataFrame({"m": rows["m"].to_numpy(), "c": rows["c"].to_numpy(), "a": step[begin].astype(np.int32), "b": (step[end] + length).astype(np.int32)})


def _compare(length: int):
    """Whole groups out of a partition sorted by ``m``, a bounded number of contexts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            kept.append(pdf)
            size += len(pdf)
            if size < 4000:
                continue
            whole = pd.concat(kept, ignore_index=True)
            tail = whole["m"] == whole["m"].iloc[-1]
            if (~tail).any():
                yield shared_windows(whole[~tail].reset_index(drop=True), length)
            kept, size = [whole[tail]], int(tail.sum())
        if size:
            yield shared_windows(pd.concat(kept, ignore_index=True), length)

    return run


def _exploded(length: int):
    """Every window of every context with a digest of its text, the elected gram and its place in the window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                count = pdf["n"].to_numpy() + 1
                who = np.repeat(np.arange(len(pdf)), count)
                step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                w = []
                for part, n, m, anchor in zip(pdf["part"], count.tolist(), pdf["m"].tolist(), pdf["anchor"].tolist()):
                    raw = memoryview(codes_of(part)).cast("B")
                    gram = m.to_bytes(8, "little", signed=True)
                    w += [hashlib.blake2b(raw[4 * i : 4 * (i + length)], digest_size=16, salt=gram, person=(anchor - i).to_bytes(8, "little")).digest() for i in range(n)]
                halves = np.frombuffer(b"".join(w), dtype=np.int64).reshape(-1, 2)
                rows = {c: pdf[c].to_numpy()[who] for c in ("m", "c", "lo", "hi")}
                yield pd.DataFrame({**rows, "step": step.astype(np.int32), "w1": halves[:, 0], "w2": halves[:, 1]})

    return run


def merge_intervals(df: DataFrame) -> DataFrame:
    """Union of intervals per ``doc_id``; those that touch become one."""
    w = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos")
    before = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (F.col("start_pos") > before)).cast("int")
    islands = df.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return islands.groupBy("doc_id", "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("island")


class SpanIndex:
    """Runs of context fingerprints and the matches found so far."""

    def __init__(self, spark: SparkSession, length: int = 200, gram: int = 40, buckets: int = 0, fan_in: int = 4, group_limit: int = 2000, salts: int = SALTS):
        if not 1 < gram < length:
            raise ValueError("gram must be shorter than length")
        self.spark, self.length, self.gram, self.salts = spark, length, gram, salts
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.fan_in, self.group_limit = fan_in, group_limit
        self.batches = self.runs = 0
        self.tables: dict[str, str] = {}
        self.paths: dict[str, str] = {}

    def _append(self, kind: str, df: DataFrame, keys: list[str]) -> None:
        """Append a run to the table of ``kind``, bucketed by ``keys`` and sorted."""
        first = kind not in self.tables
        if first:
            self.tables[kind] = f"veilwright_{kind}_{uuid.uuid4().hex}"
            self.paths[kind] = scratch(self.spark, kind)
        df = df.repartition(self.buckets, *keys).withColumn("batch", F.lit(self.batches))
        writer = df.write.mode("append").partitionBy("batch").bucketBy(self.buckets, *keys).sortBy(*keys).option("compression", "zstd")
        (writer.option("path", self.paths[kind]) if first else writer).saveAsTable(self.tables[kind])

    def _read(self, kind: str) -> DataFrame:
        return self.spark.table(self.tables[kind])

    def add(self, docs: DataFrame) -> None:
        """Index the records of a batch and append the matches it brings."""
        key = "spark.sql.requireAllClusterKeysForCoPartition"  # joins on more columns than the buckets' must not shuffle
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")
        try:
            self._add(docs)
        finally:
            self.spark.conf.set(key, before)

    def _add(self, docs: DataFrame) -> None:
        n = self.batches
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"length(text) >= {self.length}")
        self._append("texts", source, ["doc_id"])
        rows = self._read("texts").where(f"batch = {n}").select("doc_id", "text").mapInPandas(_fingerprints(self.length, self.gram), CONTEXT)
        self._append("places", rows.withColumn("salt", salt(F.col("doc_id"), self.salts)), ["m", "salt"])
        mine = self._read("places").where(f"batch = {n}")
        fold = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("parts").alias("parts")]
        few = mine.select("m", "salt", "c", F.col("doc_id").alias("lo"), F.col("doc_id").alias("hi"), F.expr("shiftleft(1, salt)").alias("parts"))
        few = few.groupBy("m", "salt", "c").agg(*fold)  # in place: a notice shrinks to one row a part before it is shuffled
        self._append("classes", few.repartition(self.buckets, "m").groupBy("m", "c").agg(*fold), ["m"])
        classes = self._read("classes")
        if n:
            old = lambda c: F.when(F.col("batch") < n, F.col(c))
            touched = classes.join(classes.where(f"batch = {n}").select("m").distinct(), "m", "left_semi")
            touched = touched.groupBy("m", "c").agg(*fold, (F.max("batch") == n).alias("fresh"), (F.min(old("lo")) == F.max(old("hi"))).alias("was_single"))
        else:  # no earlier run to join
            touched = classes.select("m", "c", "lo", "hi", "parts", F.lit(True).alias("fresh"), F.lit(False).alias("was_single"))
        group = Window.partitionBy("m")  # of classes, which stand sorted by m
        differs = F.min("c").over(group) != F.max("c").over(group)
        several = (F.min("lo").over(group) != F.max("hi").over(group)) & (F.max(F.col("lo") == F.col("hi")).over(group))
        touched = touched.withColumn("open", differs & several & F.max("fresh").over(group)).withColumn("size", F.count("*").over(group))
        touched = cut(touched.where("open or (fresh and lo != hi)"), "span-classes")

        whole = touched.where("fresh and lo != hi").select("m", "c", F.coalesce("was_single", F.lit(False)).alias("was_single"), F.explode(self._parts()).alias("salt"))
        whole = self._read("places").join(whole, ["m", "salt", "c"]).where(F.col("was_single") | (F.col("batch") == n))
        whole = whole.select("doc_id", F.col("x").alias("start_pos"), (F.col("x") + F.col("n") + self.length).alias("end_pos"))
        fine, used = self._compared(touched.where("open"))
        single = touched.where("open and lo = hi").select("m", "c", salt(F.col("lo"), self.salts).alias("salt"))
        partial = self._read("places").join(single.join(fine, ["m", "c"]), ["m", "salt", "c"])
        partial = partial.select("doc_id", (F.col("x") + F.col("a")).alias("start_pos"), (F.col("x") + F.col("b")).alias("end_pos"))
        found = whole.unionByName(partial).selectExpr("doc_id", "cast(start_pos as int) start_pos", "cast(end_pos as int) end_pos")
        self._append("matches", found, ["doc_id"])
        release(touched, *used)
        self.batches += 1
        self.runs += 1
        if self.runs > self.fan_in:
            self.compact()

    def _parts(self) -> Column:
        """Parts in which a class has places."""
        return F.filter(F.sequence(F.lit(0), F.lit(self.salts - 1)), lambda i: F.call_function("shiftright", F.col("parts"), i).bitwiseAND(F.lit(1)) == 1)

    def _compared(self, groups: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Shared windows ``(m, c, a, b)`` of differing contexts with one elected gram, and the cut points they rest on."""
        groups = groups.select("m", "c", "lo", "hi", salt(F.col("lo"), self.salts).alias("salt"), (F.col("size") > self.group_limit).alias("large"))
        groups = self._read("places").join(groups, ["m", "salt", "c"]).where("doc_id = lo")
        groups = groups.groupBy("m", "salt", "c", "lo", "hi", "large").agg(F.min(F.struct("x", "n")).alias("place"))
        want = F.struct("m", "c", "lo", "hi", "place.x", "place.n", "large")
        wants = groups.groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list(want).alias("wants"))  # bounded by the record's own text
        parts = cut(self._read("texts").select("doc_id", "text").join(wants, "doc_id").select("text", "wants").mapInPandas(_texts_of(self.length, self.gram), PART), "span-parts")
        fine = parts.where("not large").repartition("m").sortWithinPartitions("m").mapInPandas(_compare(self.length), "m long, c long, a int, b int")
        large, shared = self._large(parts.where("large"))
        return fine.unionByName(large), [parts, shared]

    def _large(self, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        win = parts.mapInPandas(_exploded(self.length), "m long, c long, lo long, hi long, step int, w1 long, w2 long")
        key = ["w1", "w2"]
        shared = win.groupBy(*key).agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l != h").select(*key)
        shared = cut(shared, "shared-windows")  # its size is known when the join is planned
        hit = win.where("lo = hi").join(shared, key, "left_semi")
        return hit.select("m", "c", F.col("step").alias("a"), (F.col("step") + self.length).cast("int").alias("b")), shared

    def compact(self) -> None:
        """Merge the runs; of a class that is shared already only the places in its first record are kept."""
        old = {k: (self.tables.pop(k), self.paths.pop(k)) for k in ("places", "classes")}
        read = lambda k: self.spark.table(old[k][0])
        at, self.batches = self.batches, self.batches - 1
        classes = read("classes").groupBy("m", "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_or("parts").alias("parts"))
        first = classes.select("m", "c", "lo", salt(F.col("lo"), self.salts).alias("salt"))  # all places of a class that one record has
        places = read("places").join(first, ["m", "salt", "c"]).where("doc_id = lo")
        self._append("places", places.select("m", "c", "doc_id", "x", "n", "salt"), ["m", "salt"])
        self._append("classes", classes, ["m"])
        self.batches, self.runs = at, 1
        for name, path in old.values():
            self.spark.sql(f"DROP TABLE {name}")
            drop_path(self.spark, path)

    def coverage(self) -> DataFrame:
        """Maximal runs ``(doc_id, start_pos, end_pos)`` in which every code point lies in a shared passage."""
        return merge_intervals(self._read("matches").drop("batch")) if self.batches else empty(self.spark, INTERVAL)


def shared_spans(documents: DataFrame, batches: int = 2, **options) -> DataFrame:
    """Index ``documents`` in batches and return the shared runs of all of them."""
    index = SpanIndex(documents.sparkSession, **options)
    for i in range(batches):
        index.add(documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    return index.coverage()


def shared_fraction(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Per record: number of shared runs, shared code points and their fraction of the text."""
    per = spans.groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    sizes = documents.groupBy("doc_id").agg(F.max(F.length("text")).alias("chars"))
    out = sizes.join(per, "doc_id", "left").fillna(0, ["runs", "shared_chars"])
    return out.withColumn("shared_fraction", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0)).fillna(0, ["chars"])
