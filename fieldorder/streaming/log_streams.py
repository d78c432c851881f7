"""Structured Streaming twins of the log, snapshot and ledger operators.

Each takes a streaming (or batch) DataFrame and returns one; the caller chooses sink and trigger.
State is bounded by watermarks or by the number of keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldorder.operators import ledger as lg


def read_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files appended to a folder, with a stated schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(folder)


def snapshots(quotes: DataFrame, start: Column, open_from: Column, late: str = "2 hours", keys: Sequence[str] = ("ticker", "event_id")) -> DataFrame:
    """Quotes in [open_from, start), each once even if delivered again within the watermark."""
    d = quotes.where((F.col("ts") >= open_from) & (F.col("ts") < start))
    d = d.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return d.dropDuplicatesWithinWatermark(list(keys))


def request_counts(requests: DataFrame, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Requests per key and clock hour (tumbling); a row is final once the watermark passes."""
    d = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = d.groupBy(*keys, F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("window.start").alias("hour"), "n")


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("rejected", F.greatest(F.col("n") - limit, F.lit(0)))


def settled_stream(tickets: DataFrame, results: DataFrame) -> DataFrame:
    """Ticket stream against the static results table."""
    return lg.settle(tickets.withColumn("status", F.lit("open")), results)


def append_sink(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Append to files, exactly once through the checkpoint; runs what is available and stops."""
    return (
        df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
