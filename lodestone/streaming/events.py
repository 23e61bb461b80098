"""The same operators on unbounded input: windowed counts with late data, de-duplication, usage totals, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("from_ts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("from_ts"), "n")


def distinct(events: DataFrame, late: str = "10 minutes", *keys: str) -> DataFrame:
    """The first event of each key; the state of a key goes when the watermark has passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys) or ["event_id"])


def usage(calls: DataFrame) -> DataFrame:
    """Running totals of each session, for update or complete output."""
    return calls.groupBy("session_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def to_table(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Runs over all that is there now, one call of write(rows, batch) a batch."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def feedback_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Appends feedback rows whose text isn't blank, as JSON with the time of arrival."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.where(F.trim(F.coalesce("feedback_text", F.lit(""))) != "").withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)

    return write


def unseen(hits: DataFrame, late: str = "400 days") -> DataFrame:
    """The first hit of each section in a session (session_id, section_id, ts, ...), whichever call it comes with; the
    store keeps a key until the watermark has passed it by ``late``."""
    return hits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "section_id"])
