"""Status events as streams. Each job is the batch operator behind a watermark; the sink is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statloom.operators import history

EVENTS = "event_id long, ts timestamp, task_id long, status string, progress int, value double"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder)


def latest_status(events: DataFrame) -> DataFrame:
    """Run in update mode."""
    return history.latest_status(events)


def event_rates(events: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Run in append mode: a window is final once the watermark has passed it."""
    return history.event_rates(events.withWatermark("ts", late), length, slide)


def expired(events: DataFrame, gap: str = "6 hours", late: str = "30 minutes") -> DataFrame:
    """Sessions that have ended, which are tasks that fell silent."""
    return history.sessions(events.withWatermark("ts", late), gap)


def progress(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("task_id").agg(F.max("progress").alias("progress"), F.count("*").alias("n"))


def without_repeats(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def score_arrivals(statements: DataFrame, score, sink: str, checkpoint: str) -> StreamingQuery:
    """Scores the statements of each micro-batch with a batch function and appends them to a folder; a batch that runs
    again writes over its own part only."""

    def batch(df: DataFrame, batch_id: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return statements.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
