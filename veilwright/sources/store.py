"""Mapping table with a time limit, and the small sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.runtime import empty

MAPPING = "job_id string, placeholder string, original string, expires_at timestamp"


def mapping_rows(masked: DataFrame, job_id: str, now: Column, ttl_seconds: int = 86_400) -> DataFrame:
    """One row per placeholder; a document without any gives none."""
    until = now + F.make_interval(secs=F.lit(ttl_seconds))
    return masked.select(F.col(job_id).cast("string").alias("job_id"), F.explode("mapping").alias("placeholder", "original"), until.alias("expires_at"))


def alive(mappings: DataFrame, now: Column) -> DataFrame:
    return mappings.where(F.col("expires_at") > now)


def as_maps(mappings: DataFrame) -> DataFrame:
    """The whole mapping of each job."""
    return mappings.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("mapping"))


def lookup(mappings: DataFrame, job_id: str, now: Column, placeholder: str | None = None) -> DataFrame:
    rows = alive(mappings, now).where(F.col("job_id") == job_id)
    return rows if placeholder is None else rows.where(F.col("placeholder") == placeholder)


def deleted(mappings: DataFrame, jobs: DataFrame) -> DataFrame:
    """The table without the mappings of ``jobs``."""
    return mappings.join(jobs.select("job_id").distinct(), "job_id", "left_anti")


def remaining(jobs: DataFrame, mappings: DataFrame, now: Column) -> DataFrame:
    """Seconds left per job: -2 where there is no mapping, -1 where it does not expire."""
    last = mappings.groupBy("job_id").agg(F.max("expires_at").alias("until"), F.max(F.col("expires_at").isNull()).alias("ever"))
    left = F.unix_timestamp("until") - F.unix_timestamp(now)
    out = jobs.join(last, "job_id", "left")
    return out.select("job_id", F.when(F.col("ever").isNull(), -2).when(F.col("ever"), -1).when(left <= 0, -2).otherwise(left).cast("long").alias("seconds"))


def restore(requests: DataFrame, mappings: DataFrame, now: Column) -> DataFrame:
    """``requests(job_id, masked_text)`` with ``text`` and ``status``; jobs without a mapping are ``missing``."""
    from veilwright.operators.masking import unmask

    out = requests.join(as_maps(alive(mappings, now)), "job_id", "left")
    return out.withColumn("text", unmask("masked_text", F.col("mapping"))).withColumn("status", F.when(F.col("mapping").isNull(), "missing").otherwise("ok"))


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> bool:
    """Append to a table; a failing sink is reported, not raised, so that masking goes on."""
    try:
        writer = df.write.mode("append")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    except Exception as e:  # the audit trail must not stop the work
        print(f"append to {path} failed: {e}")
        return False
    return True


def append_together(frames: dict[str, DataFrame], root: str) -> str | None:
    """Append to several tables under ``root`` as one: their rows count once the batch is committed.

    Gives the batch's id, or None if a write failed; what was written of it then is never read.
    """
    batch = uuid.uuid4().hex
    try:
        for name, df in frames.items():
            df.write.parquet(f"{root}/{name}/batch={batch}")
        spark = next(iter(frames.values())).sparkSession
        spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{root}/commits")
    except Exception as e:  # the audit trail must not stop the work
        print(f"append under {root} failed: {e}")
        return None
    return batch


def read_together(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Committed rows of a table; an empty table if it cannot be read."""
    rows = read_or_empty(spark, f"{root}/{name}", f"{schema}, batch string")
    return rows.join(read_or_empty(spark, f"{root}/commits", "batch string").distinct(), "batch", "left_semi").drop("batch")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or no rows of its schema where it is missing or broken: reports degrade, they do not fail."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.limit(1).count()
        return df
    except Exception as e:
        print(f"reading {path} failed: {e}")
        return empty(spark, schema)


def health(model_available: bool, service: str = "veilwright") -> dict:
    """What a health check answers."""
    return {"status": "ok", "service": service, "ner_available": bool(model_available)}


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, append_rows: bool = False) -> None:
    df.write.mode("append" if append_rows else "overwrite").option("header", True).csv(path)


def chat_context(masked: Column, turns: Column, limit: int = 12_000) -> Column:
    """What a chat prompt may see: the first ``limit`` characters of the masked text and the user's and assistant's turns."""
    return F.struct(F.substring(masked, 1, limit).alias("document"), F.filter(turns, lambda t: t["role"].isin("user", "assistant")).alias("turns"))
