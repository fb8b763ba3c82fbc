"""References to records that do not exist.

:class:`OrphanTracker` keeps keyed state that is moved forward batch by batch, in three tables of the shared folder
that only grow by what a batch changes:

* ``index``    parent rows and deletions, bucketed by key: first creation, until when a row of it stands, last deletion;
* ``refs``     references with their kind (``missing``, ``deleted``, ``later``, ``ok``), the orphans stored apart,
  bucketed by key and part of key; a reference that changes its kind is taken out of the old kind and put into the new one by two appended rows;
* ``counts``   what each batch added to the number of references per table, month and kind.

In a batch new references probe the index; arriving parents are joined with waiting orphans only and resolve them;
deletions are joined with the references of their parents and reopen them. The index and the references are read in
place, bucket by bucket: only the batch's own rows and the keys that it touches are shuffled or written, so a batch
costs no more shuffle late in the history than early. :meth:`OrphanTracker.snapshot` sums the counts of the batches
up to a given one. After ``compact_after`` batches the tables are rewritten without what was taken out.

Rows of one key are split over parts (:mod:`veilwright.operators.skew`), in every join and every table.

Kinds: ``missing`` no row of the parent ever stood; ``deleted`` the parent stood and its last deletion is not
followed by a row, or only the deletion is known; ``later`` the parent stands and was created after the reference.

Defined results: a null, cut-off or all-zero key refers to nothing and is ignored; a record that occurs twice in a
batch counts once; a reference without a time is an orphan only if its parent is absent; a parent without a creation
time existed always; empty inputs give an empty report; extra columns of the inputs are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.operators.skew import SALTS, copies, salt
from veilwright.runtime import cut, scratch

FOREVER = "9999-12-31 00:00:00"
ALWAYS = "0001-01-01 00:00:00"

INDEX = "key binary, first_created timestamp, stands_until timestamp, deleted_at timestamp"
REF = ["key", "salt", "src_table", "record_id"]


def uuid_key(col: Column | str) -> Column:
    """16 bytes of a UUID however it is written; null for anything else and for the all-zero UUID."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.lower(c), r"[-{}()\[\]\"'\s\p{Z}]", "")
    hexa = F.right(bare, F.lit(32))
    return F.when(bare.rlike("^(?:urn:)?(?:uuid:)?[0-9a-f]{32}$") & (hexa != "0" * 32), F.unhex(hexa))


def references(df: DataFrame, src_table: str, record_id: str, key: str, occurred_at: str) -> DataFrame:
    """The reference columns the tracker reads, without rows that refer to nothing."""
    out = df.select(uuid_key(key).alias("key"), F.lit(src_table).alias("src_table"), F.col(record_id).cast("string").alias("record_id"), F.col(occurred_at).cast("timestamp").alias("occurred_at"))
    return out.where(F.col("key").isNotNull())


def _parent_rows(df: DataFrame, key: str, created: Column, until: Column, deleted: Column) -> DataFrame:
    at = {"first_created": created, "stands_until": until, "deleted_at": deleted}
    return df.select(uuid_key(key).alias("key"), *[c.cast("timestamp").alias(n) for n, c in at.items()]).where(F.col("key").isNotNull())


def parents(df: DataFrame, key: str, created_at: str, stands_until: Column | None = None) -> DataFrame:
    """Parent rows. A row stands for ever, whatever is deleted, unless ``stands_until`` says otherwise."""
    return _parent_rows(df, key, F.col(created_at), F.lit(FOREVER) if stands_until is None else stands_until, F.lit(None))


def deletions(df: DataFrame, key: str, deleted_at: str) -> DataFrame:
    return _parent_rows(df, key, F.lit(None), F.lit(None), F.col(deleted_at))


def history(jobs: DataFrame, removed: DataFrame, key: str, created_at: str, deleted_at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(arrivals, removals, restored)`` behind a table of parents as it stands now and a log of deletions.

    Each parent arrived at its creation and stood until its deletion; those deleted once that stand in the table
    were restored by the time the table was taken.
    """
    created = F.coalesce(F.col(created_at).cast("timestamp"), F.lit(ALWAYS).cast("timestamp"))
    gone = deletions(removed, key, deleted_at)
    back = parents(jobs, key, created_at).join(gone.select("key").distinct(), "key", "left_semi")
    return parents(jobs, key, created_at, created), gone, back


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min("first_created").alias("first_created"), F.max("stands_until").alias("stands_until"), F.max("deleted_at").alias("deleted_at"))


def _kind() -> Column:
    """Kind of a reference beside its parent's row of the index (nulls if there is none)."""
    alive = F.col("stands_until").isNotNull() & (F.col("deleted_at").isNull() | (F.col("stands_until") > F.col("deleted_at")))
    late = F.col("first_created") > F.col("occurred_at")
    return F.when(alive, F.when(late, "later").otherwise("ok")).when(F.col("deleted_at").isNotNull(), "deleted").otherwise("missing")


def _filed(rows: DataFrame) -> DataFrame:
    """Orphans are stored apart from references whose parent stands."""
    return rows.withColumn("waits", F.col("kind") != "ok")


class OrphanTracker:
    """``keep_live`` keeps references whose parent stands, so that deletions can reopen them."""

    def __init__(self, spark: SparkSession, keep_live: bool = True, salts: int = SALTS, buckets: int = 0, compact_after: int = 32):
        self.spark, self.keep_live, self.salts, self.compact_after = spark, keep_live, salts, compact_after
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.batches = 0
        self.index = self.refs = self.counts = None

    def _append(self, df: DataFrame, name: str | None, partition_by: list[str], bucket_by: list[str]) -> str:
        first = name is None
        name = name or f"veilwright_orphans_{uuid.uuid4().hex}"
        writer = df.write.mode("append").partitionBy(*partition_by)
        writer = writer.bucketBy(self.buckets, *bucket_by).sortBy(*bucket_by) if bucket_by else writer
        (writer.option("path", scratch(self.spark, name)) if first else writer).saveAsTable(name)
        return name

    def apply(self, refs: DataFrame, arrivals: DataFrame, removed: DataFrame) -> None:
        """Move the state forward by one batch of references, parent rows and deletions."""
        n = self.batches
        delta = _summed(arrivals.unionByName(removed))
        self.index = self._append(delta.withColumn("batch", F.lit(n)), self.index, ["batch"], ["key"])
        index = self.spark.table(self.index)
        refs = refs.where(F.col("key").isNotNull())
        new = refs.select("key", salt(F.col("record_id"), self.salts).alias("salt"), "src_table", "record_id", "occurred_at")
        asked = _summed(index.join(refs.select("key").distinct(), "key", "left_semi"))
        probed = new.join(copies(asked, self.salts), ["key", "salt"], "left").withColumn("kind", _kind())
        rows = probed.dropDuplicates(REF).select(*REF, "occurred_at", "kind", F.lit(1).alias("op"))
        if self.refs is not None:
            rows = rows.unionByName(self._moved(index, n))
        if not self.keep_live:
            rows = rows.where("kind != 'ok'")
        self.refs = self._append(_filed(rows).withColumn("batch", F.lit(n)), self.refs, ["batch", "waits"], ["key", "salt"])
        month = F.date_format("occurred_at", "yyyy-MM").alias("month")
        added = self.spark.table(self.refs).where(f"batch = {n} and waits").groupBy("batch", "src_table", month, "kind").agg(F.sum("op").alias("orphans"))
        self.counts = self._append(added, self.counts, ["batch"], [])
        self.batches += 1
        if self.batches % self.compact_after == 0:
            self._compact()

    def _moved(self, index: DataFrame, n: int) -> DataFrame:
        """References of earlier batches that change their kind: out of the old one, into the new one."""
        fresh = index.where(f"batch = {n}")
        changed = _summed(index.join(fresh.select("key").distinct(), "key", "left_semi"))
        held = self.spark.table(self.refs)
        reopening = bool(fresh.where("deleted_at is not null").limit(1).count())
        held = self._current(held if reopening else held.where("waits"))  # 'ok' ends by deletions only
        met = held.join(copies(changed, self.salts), ["key", "salt"]).withColumnRenamed("kind", "old").withColumn("kind", _kind()).where("kind != old")
        both = F.explode(F.array(F.struct(F.col("old").alias("kind"), (-F.col("op")).alias("op")), F.struct("kind", F.lit(1).alias("op")))).alias("x")
        return met.select(*REF, "occurred_at", both).select(*REF, "occurred_at", "x.kind", F.col("x.op").cast("int").alias("op"))

    @staticmethod
    def _current(held: DataFrame) -> DataFrame:
        """References that stand in a kind now. A kind's rows are enough to tell, and they stand in one bucket."""
        return held.groupBy(*REF, "kind").agg(F.min("occurred_at").alias("occurred_at"), F.sum("op").alias("op")).where("op > 0")

    def _compact(self) -> None:
        """Rewrite the index and the references without what later batches took out."""
        n = self.batches - 1
        old = [self.index, self.refs]
        refs = self._current(self.spark.table(self.refs)).withColumn("op", F.lit(1)).withColumn("batch", F.lit(n))
        self.refs = self._append(_filed(refs.select(*REF, "occurred_at", "kind", "op", "batch")), None, ["batch", "waits"], ["key", "salt"])
        self.index = self._append(_summed(self.spark.table(self.index)).withColumn("batch", F.lit(n)), None, ["batch"], ["key"])
        for name in old:
            self.spark.sql(f"DROP TABLE {name}")

    def orphans(self) -> DataFrame:
        """Every orphan after the last batch with its kind."""
        rows = self._current(self.spark.table(self.refs).where("waits"))
        return rows.groupBy("src_table", "record_id").agg(F.min("occurred_at").alias("occurred_at"), F.min("kind").alias("kind"))

    def snapshot(self, batch: int | None = None) -> DataFrame:
        """Orphans per table, calendar month and kind after ``batch``, or after the last one."""
        rows = self.spark.table(self.counts).where(F.col("batch") <= (self.batches if batch is None else batch))
        return rows.groupBy("src_table", "month", "kind").agg(F.sum("orphans").alias("orphans")).where("orphans > 0")

    def snapshots(self) -> DataFrame:
        """The snapshot after each batch: ``batch, src_table, month, kind, orphans``."""
        upto = self.spark.range(self.batches).select(F.col("id").cast("int").alias("upto"))
        rows = self.spark.table(self.counts).join(F.broadcast(upto), F.col("batch") <= F.col("upto"))  # one row per batch
        return rows.groupBy(F.col("upto").alias("batch"), "src_table", "month", "kind").agg(F.sum("orphans").alias("orphans")).where("orphans > 0")


def replay(refs: DataFrame, arrivals: DataFrame, removed: DataFrame, restored: DataFrame | None = None, batches: int = 4, keep_live: bool = True, **options) -> OrphanTracker:
    """Feed a whole history to a tracker in ``batches`` equal stretches of time.

    Rows without a time come with the first batch (parents) or the last (references); ``restored`` rows come last.
    """
    tracker = OrphanTracker(refs.sparkSession, keep_live, **options)
    refs, arrivals = cut(refs, "references"), cut(arrivals, "arrivals")  # keys are parsed once, each batch reads its stretch
    edges = stretches(refs, batches)

    def part(df: DataFrame, when: Column, i: int, null_at: int) -> DataFrame:
        cond = F.lit(True)
        if i > 0:
            cond = cond & (when >= F.timestamp_seconds(F.lit(edges[i - 1])))
        if i < batches - 1:
            cond = cond & (when < F.timestamp_seconds(F.lit(edges[i])))
        return df.where(cond | when.isNull() if i == null_at else cond)

    for i in range(batches):
        new = part(arrivals, F.col("first_created"), i, 0)
        if restored is not None and i == batches - 1:
            new = new.unionByName(restored)
        tracker.apply(part(refs, F.col("occurred_at"), i, batches - 1), new, part(removed, F.col("deleted_at"), i, 0))
    return tracker


def stretches(refs: DataFrame, batches: int) -> list[int]:
    """Whole seconds at which each batch but the first begins."""
    span = refs.agg(F.min("occurred_at").cast("long").alias("a"), F.max("occurred_at").cast("long").alias("b")).first()
    lo, hi = span["a"] or 0, span["b"] or 0
    return [lo + (hi - lo) * i // batches for i in range(1, batches)]
