"""Activity by minute or day as a stream, with the same result as the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Events of a folder or file as they arrive; the time becomes a UTC timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name)
    return read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,6)")), 2).cast("double").alias("total"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
    )


def run_once(stream: DataFrame, sink: str, mode: str = "complete") -> DataFrame:
    """All that has arrived, run to its end into a table in memory."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(sink)


def snapshots(stream: DataFrame, path: str, checkpoint: str, key: list[str]):
    """Each micro-batch appended once, by its id; a restart goes on from the checkpoint."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(key).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
