"""Structured Streaming twins of the run-event queries, and stateful duplicate suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.readers import EVENT


def event_stream(spark: SparkSession, path: str, schema: str = EVENT, kind: str = "json", files: int = 64) -> DataFrame:
    """Events as files arrive; with json, lines that don't parse have a null event and are left out."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)
    return rows.where(F.col("event").isNotNull()) if kind == "json" else rows


def windowed_counts(stream: DataFrame, key: str, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))


def latest_state(stream: DataFrame, key: list[str], order: str, payload: list[str]) -> DataFrame:
    """The last row of each key so far (update or complete mode)."""
    return stream.groupBy(*key).agg(F.max_by(F.struct(*payload), order).alias("last")).select(*key, "last.*")


def unseen(stream: DataFrame, fingerprint: str, ts: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows whose fingerprint hasn't been seen; with ts the state is bounded by the watermark."""
    if ts:
        return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([fingerprint])
    return stream.dropDuplicates([fingerprint])


def drain(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what is there, write, and stop; the checkpoint lets the next call go on behind it."""
    query = result.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain_to_table(result: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run over what is there; the table as of the last batch is in files of the shared folder, not in the driver's memory."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)


def refreshed(result: DataFrame, path: str, checkpoint: str, seconds: int = 5, mode: str = "complete") -> StreamingQuery:
    """The same table, written anew every few seconds while the query runs; the caller stops it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch as JSON lines, once for each batch id."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
