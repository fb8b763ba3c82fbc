"""The masking plan on a stream, and windowed counts of corrections with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veilwright.operators.masking import Settings, mask
from veilwright.sources.store import mapping_rows


def mask_stream(spark: SparkSession, path: str, schema: T.StructType, text: str = "text", settings: Settings | None = None) -> DataFrame:
    """Masked documents of a folder of parquet files, as they arrive. The plan has no state across rows."""
    return mask(spark.readStream.schema(schema).parquet(path), text, settings)


def write_masked(stream: DataFrame, job_id: str, documents: str, mappings: str, checkpoint: str, ttl_seconds: int = 86_400) -> StreamingQuery:
    """Masked texts and their mappings into two tables; a repeated micro-batch overwrites its own folder."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.drop("mapping", "spans").write.mode("overwrite").parquet(f"{documents}/epoch={epoch}")
        mapping_rows(batch, job_id, F.current_timestamp(), ttl_seconds).write.mode("overwrite").parquet(f"{mappings}/epoch={epoch}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def correction_counts(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Corrections per window, kind and label; each id counts once within the allowed lateness."""
    once = stream.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["correction_id"])
    return once.groupBy(F.window("occurred_at", window), "event_type", "entity_label").agg(F.count("*").alias("n"))


def expired(mappings: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Mappings that stay, and one expiry event per job whose mapping ended."""
    gone = mappings.where(F.col("expires_at") <= now)
    events = gone.groupBy("job_id").agg(F.count("*").alias("placeholder_count"), F.max("expires_at").alias("occurred_at")).withColumn("event_type", F.lit("expiry"))
    return mappings.where((F.col("expires_at") > now) | F.col("expires_at").isNull()), events
