"""Queries of problem 1 over audit_log, corrections, jobs and job_deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.operators import orphans as O
from veilwright.runtime import table

#: Stretches of time in which the registered queries take the history.
BATCHES = 4


def _tracker(spark: SparkSession, sf_dir: str) -> O.OrphanTracker:
    refs = O.references(table(spark, sf_dir, "audit_log"), "audit_log", "log_id", "job_id", "occurred_at").unionByName(
        O.references(table(spark, sf_dir, "corrections"), "corrections", "correction_id", "job_id", "occurred_at")
    )
    arrived, gone, back = O.history(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "job_deletions"), "job_id", "created_at", "deleted_at")
    return O.replay(refs, arrived, gone, back, BATCHES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracker(spark, sf_dir).orphans().select("src_table", "record_id")


def p1_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracker(spark, sf_dir).snapshot()


def p1_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracker(spark, sf_dir).snapshots()


_KEY = "lower(regexp_replace(regexp_replace(trim({c}, chr(32) || chr(9) || chr(10) || chr(13)), '^(urn:)?(uuid:)?', '', 'i'), '[-{{}}()\\[\\]\"''\\s]', '', 'g'))"


def _key(c: str) -> str:
    k = _KEY.format(c=c)
    return f"CASE WHEN regexp_full_match({k}, '[0-9a-f]{{32}}') AND {k} <> repeat('0', 32) THEN {k} END"


_ORPHANS = f"""
WITH refs AS (
  SELECT 'audit_log' AS src_table, log_id AS record_id, {_key('job_id')} AS k, min(occurred_at) AS occurred_at FROM audit_log GROUP BY 1, 2, 3
  UNION ALL
  SELECT 'corrections', correction_id, {_key('job_id')}, min(occurred_at) FROM corrections GROUP BY 1, 2, 3
), parents AS (
  SELECT {_key('job_id')} AS k, min(created_at) AS created_at FROM jobs GROUP BY 1
), gone AS (
  SELECT DISTINCT {_key('job_id')} AS k FROM job_deletions
), orphans AS (
  SELECT src_table, record_id, occurred_at,
         CASE WHEN p.k IS NOT NULL THEN 'later' WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
  FROM refs LEFT JOIN parents p ON refs.k = p.k LEFT JOIN gone g ON refs.k = g.k
  WHERE refs.k IS NOT NULL AND (p.k IS NULL OR p.created_at > refs.occurred_at)
)"""

# What was known after each stretch: references, creations and deletions before its end; restored jobs at the very end.
_SNAPSHOTS = f"""
WITH refs AS (
  SELECT 'audit_log' AS src_table, log_id AS record_id, {_key('job_id')} AS k, min(occurred_at) AS occurred_at FROM audit_log GROUP BY 1, 2, 3
  UNION ALL
  SELECT 'corrections', correction_id, {_key('job_id')}, min(occurred_at) FROM corrections GROUP BY 1, 2, 3
), r AS (SELECT * FROM refs WHERE k IS NOT NULL),
span AS (SELECT CAST(floor(epoch(min(occurred_at))) AS BIGINT) AS a, CAST(floor(epoch(max(occurred_at))) AS BIGINT) AS b FROM r),
ends AS (SELECT CAST(i AS INT) AS batch, CASE WHEN i < {BATCHES - 1} THEN CAST(a + (b - a) * (i + 1) // {BATCHES} AS DOUBLE) ELSE 'infinity'::DOUBLE END AS upto FROM span, range({BATCHES}) t(i)),
j AS (SELECT {_key('job_id')} AS k, epoch(created_at) AS ts FROM jobs),
d AS (SELECT {_key('job_id')} AS k, epoch(deleted_at) AS ts FROM job_deletions),
known AS (
  SELECT batch, k, min(ts) FILTER (what = 'j') AS created, max(ts) FILTER (what = 'j') AS stands, max(ts) FILTER (what = 'd') AS deleted
  FROM ends, (SELECT 'j' AS what, k, ts FROM j UNION ALL SELECT 'd', k, ts FROM d) e WHERE e.ts < upto AND k IS NOT NULL GROUP BY 1, 2
), kinds AS (
  SELECT e.batch, src_table, strftime(r.occurred_at, '%Y-%m') AS month,
         CASE WHEN created IS NOT NULL AND (deleted IS NULL OR stands > deleted OR e.batch = {BATCHES - 1}) THEN CASE WHEN created > epoch(r.occurred_at) THEN 'later' ELSE 'ok' END
              WHEN deleted IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
  FROM ends e JOIN r ON epoch(r.occurred_at) < e.upto OR (r.occurred_at IS NULL AND e.batch = {BATCHES - 1}) LEFT JOIN known ON known.batch = e.batch AND known.k = r.k
)
SELECT batch, src_table, month, kind, count(*) AS orphans FROM kinds WHERE kind <> 'ok' GROUP BY 1, 2, 3, 4"""

QUERIES = {"p1_found": p1_found, "p1_orphans_by_month": p1_orphans_by_month, "p1_snapshots": p1_snapshots}
SQL = {
    "p1_found": f"{_ORPHANS} SELECT src_table, record_id FROM orphans",
    "p1_orphans_by_month": f"{_ORPHANS} SELECT src_table, strftime(occurred_at, '%Y-%m') AS month, kind, count(*) AS orphans FROM orphans GROUP BY 1, 2, 3",
    "p1_snapshots": _SNAPSHOTS,
}
