"""Streams against their batch twins."""

import tempfile

from pyspark.sql import functions as F

from statloom.operators import history
from statloom.plans.operations import events
from statloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def run(stream, mode, name, spark):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def folder(spark, parts=3):
    path = tempfile.mkdtemp(prefix="spark-")
    events(spark, SF).repartition(parts).write.mode("overwrite").parquet(path)
    return path


def test_latest_status_as_batch(spark):
    stream = run(jobs.latest_status(jobs.read_events(spark, folder(spark))), "complete", "latest", spark)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, history.latest_status(events(spark, SF)).collect()))


def test_final_windows_as_batch(spark):
    batch = {(r.start, r.status): r.n for r in history.event_rates(events(spark, SF), "10 minutes").collect()}
    stream = run(jobs.event_rates(jobs.read_events(spark, folder(spark, 1))), "append", "rates", spark).collect()
    assert len(stream) > 0.9 * len(batch) and all(batch[r.start, r.status] == r.n for r in stream)


def test_repeats_are_removed(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    e = events(spark, SF)
    e.union(e).coalesce(1).write.mode("overwrite").parquet(path)
    assert run(jobs.without_repeats(jobs.read_events(spark, path), "60 days"), "append", "once", spark).count() == e.count()


def test_progress_and_silent_tasks(spark):
    got = run(jobs.progress(jobs.read_events(spark, folder(spark))), "complete", "progress", spark)
    want = events(spark, SF).groupBy("task_id").agg(F.max("progress").alias("progress"), F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    ended = run(jobs.expired(jobs.read_events(spark, folder(spark, 1))), "append", "silent", spark).collect()
    batch = {tuple(r) for r in history.sessions(events(spark, SF), "6 hours").collect()}
    assert ended and all(tuple(r) in batch for r in ended)


def test_arrivals_are_scored_batch_by_batch(spark):
    path, sink, check = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    spark.range(10).write.mode("overwrite").parquet(path)
    jobs.score_arrivals(spark.readStream.schema("id long").parquet(path), lambda df: df.withColumn("score", F.col("id") * 2.0), sink, check).awaitTermination(60)
    assert spark.read.parquet(sink).agg(F.sum("score")).first()[0] == 90.0
