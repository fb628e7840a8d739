"""Coupling and enrichment kept up to date by Structured Streaming.

The stream keeps counts per term and day (coupling) and per term and kind of event (enrichment). Both are mergeable, so state is a plain
streaming aggregate in the state store; the ordered part, the fold over days, runs on the small result. Redelivered events are dropped
within a watermark that bounds the state; `late` must cover the longest delay of a delivery.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocabula.operators import signals as s
from vocabula.session import checkpoint_folder

USAGE = "event_id long, ts timestamp, type string, termIds array<string>, query string, client string, receivedAt timestamp"


def usage_stream(spark: SparkSession, path: str, schema: str | None = None, late: str = "400 days") -> DataFrame:
    """The event log as a stream of files; one row per event id."""
    schema = schema or spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)
    raw = raw.withColumn("arrived", F.col("receivedAt").cast("timestamp")).withWatermark("arrived", late)
    return raw.dropDuplicatesWithinWatermark(["event_id"])


def run_once(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an aggregating stream over what is there and returns its final rows. Each trigger writes its changed rows under its own number,
    so a repeated trigger overwrites itself; the last number of a key counts."""
    spark = counts.sparkSession
    home = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4()}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("trigger", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{home}/out/number={number}")

    counts.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{home}/out").drop("number")
    rest = [c for c in rows.columns if c not in (*keys, "trigger")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("r")).select(*keys, "r.*")


def coupling(stream: DataFrame) -> DataFrame:
    """Same rows as the batch fold over the same events."""
    return s.coupling(run_once(s.daily(s.coupling_events(stream)), ["term_id", "day"]))


def usage_counts(stream: DataFrame) -> DataFrame:
    """(term_id, type, events): the counters of the enrichment."""
    rows = stream.select(F.explode("termIds").alias("term_id"), "type").filter("term_id IS NOT NULL")
    return run_once(rows.groupBy("term_id", "type").agg(F.count(F.lit(1)).alias("events")), ["term_id", "type"])
