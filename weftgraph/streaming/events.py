"""Streams: windows over events, and artifacts processed as they arrive.

An extension; the corpus operators themselves are batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.durable import new_path


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of a table's Parquet files; timestamps without zone are read in the session's zone."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.select(*[F.col(f.name).cast("timestamp") if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in schema.fields])


def window_counts(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """``window_start, event_type, n, total`` per tumbling window; works on streams and tables alike."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{minutes} minutes"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``user_id, session_start, session_end, n``: stretches of a user's events without a gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
    )


def drain(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result as a table.

    In ``complete`` mode the last trigger's result counts; in ``append`` mode all rows whose
    windows the watermark has closed.
    """
    spark = stream.sparkSession
    out = new_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or new_path(spark, "stream-state")).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def process_new_files(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each file that is new since the last call to ``work`` once; ``work`` gets the batch and its number, by which it can skip a repeat."""
    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(work).start().awaitTermination()
