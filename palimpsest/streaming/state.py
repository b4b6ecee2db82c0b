"""Current state kept up to date from a growing log, and windows over event time, by Structured Streaming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.fold import INSERT, fold
from ..sources.store import Files


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The event files of a log folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def maintain(events: DataFrame, key: list[str], values: list[str], to: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Folds each batch of events into the state under `to`/<batch>; `current` reads the newest. A batch that runs again
    after a failure writes the same folder, so results count once."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        files = Files(spark)
        done = sorted(int(x) for x in files.names(to) if x.isdigit() and int(x) < n and files.exists(f"{to}/{x}/_SUCCESS"))
        if done:
            old = spark.read.parquet(f"{to}/{done[-1]}")
            base = old.select(F.col("last_seq").alias("seq"), F.col("last_ts").alias("ts"), F.lit(INSERT).alias("op"), *[f"`{c}`" for c in (*key, *values)])
            batch = base.unionByName(batch, allowMissingColumns=True)
        fold(batch, key, values, meta=True).write.mode("overwrite").parquet(f"{to}/{n}")
        for x in done[:-1]:
            files.delete(f"{to}/{x}")

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, to: str) -> DataFrame:
    done = sorted(int(x) for x in Files(spark).names(to) if x.isdigit())
    return spark.read.parquet(f"{to}/{done[-1]}").drop("last_seq", "last_ts")


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n over event time; events later than the watermark are left out of a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def windowed_stream(spark: SparkSession, path: str, schema: StructType, to: str, checkpoint: str, batches: list[DataFrame], width: str = "1 hour", late: str = "10 minutes") -> None:
    """`windowed_counts` as a stream over a folder that gets one batch after the other: each run takes up where the last one
    stopped, and windows are appended under `to` once the watermark has passed them; a last event far ahead closes all."""
    for batch in [*batches, None, None]:  # one to move the watermark, one to write what it closes
        if batch is None:
            batch = spark.createDataFrame([(datetime(9999, 1, 1), None)], schema)
        batch.select([F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(path)
        counts = windowed_counts(spark.readStream.schema(schema).parquet(path), width, late=late)
        writer = counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start(to).awaitTermination()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, session_end, n: stretches of a user's events with no gap as long as `gap`."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    made = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
