"""Extensions over event streams: success rates by tumbling window, with late data cut off by a watermark; the latest event of each user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, files: str, schema, per_trigger: int = 1) -> DataFrame:
    """Events of the parquet files of a folder whose names match, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", files).parquet(folder)


def success_rate(events: DataFrame, success: Column, width: str = "1 hour", lateness: str | None = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """window_start, n, ok, rate for each window; the same plan over a table and over a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness is not None and events.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    out = rows.groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.sum(success.cast("long")).alias("ok"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "ok", (F.col("ok") / F.col("n")).alias("rate"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("window_start",)) -> DataFrame:
    """The last value of each key of an aggregated stream once all that is there now has been read.

    Batches append only what they changed, each under its own number, so a batch that is run again replaces itself; the watermark lets the stream forget windows that are
    over. The table of changes is under path, what it says last of a key is worked out when it is read."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    values = [c for c in stream.columns if c not in keys]
    last = stream.sparkSession.read.schema(schema).parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in stream.columns])
