"""Stored analyses: lists, lookups, cleanup, recovery, constraints, and status events with their batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ["completed", "failed", "cancelled"]


def page(analyses: DataFrame, number: int, size: int) -> DataFrame:
    """One page, newest first; a top-k per task, not a sort of the table."""
    return analyses.orderBy(F.desc("created_at"), F.desc("task_id")).offset((number - 1) * size).limit(size)


def stale(heartbeat: Column, created: Column, status: Column, cutoff: Column) -> Column:
    return (status == "processing") & (F.coalesce(heartbeat, created) < cutoff)


def cleanup_candidates(analyses: DataFrame, old: str, stuck: str) -> DataFrame:
    """Finished and older than old, or in progress and without a sign of life since stuck."""
    done = F.col("status").isin(TERMINAL) & (F.col("created_at") < F.lit(old).cast("timestamp"))
    return analyses.where(done | stale(F.col("heartbeat_at"), F.col("created_at"), F.col("status"), F.lit(stuck).cast("timestamp")))


def after_cleanup(analyses: DataFrame, candidates: DataFrame) -> DataFrame:
    return analyses.join(candidates.select("task_id"), "task_id", "left_anti")


def recovered(analyses: DataFrame, cutoff: str) -> DataFrame:
    """Stale rows become failed, with the reason; all others stay."""
    hit = F.coalesce(stale(F.col("heartbeat_at"), F.col("created_at"), F.col("status"), F.lit(cutoff).cast("timestamp")), F.lit(False))
    return analyses.withColumns({"status": F.when(hit, "failed").otherwise(F.col("status")), "error": F.when(hit, "runtime_stale")})


def merged_payloads(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both payloads (map columns) by key; the new one wins on equal names."""
    a, b = stored.select(key, F.col("payload").alias("_a")), new.select(key, F.col("payload").alias("_b"))
    empty = F.create_map().cast("map<string,string>")
    old, now = F.coalesce("_a", empty), F.coalesce("_b", empty)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(now, k))
    return a.join(b, key, "full").select(key, F.map_concat(kept, now).alias("payload"))


def summary_columns(results: DataFrame, json: str = "result") -> DataFrame:
    """Typed columns from a JSON payload, null where a value is out of range or of another type."""
    score = F.get_json_object(json, "$.score.value").try_cast("double")
    sure = F.get_json_object(json, "$.score.confidence").try_cast("double")
    risk = F.get_json_object(json, "$.score.risk_level")
    return results.select("task_id", F.when(score.between(0, 100), score).alias("score"), F.when(sure.between(0, 1), sure).alias("confidence_score"), F.when(risk.isin("low", "medium", "high", "critical"), risk).alias("risk_level"))


def violations(analyses: DataFrame) -> DataFrame:
    """task_id, violations: rows of the stored table that break its constraints."""
    checks = F.array_compact(F.array(
        F.when(~F.col("status").isin("uploading", "processing", "completed", "failed", "cancelled"), F.lit("status")),
        F.when(~F.col("score").between(0, 100), F.lit("score")), F.when((F.col("status") == "completed") & F.col("score").isNull(), F.lit("completed_without_score")),
    ))
    return analyses.withColumn("violations", checks).where(F.size("violations") > 0)


def latest_status(events: DataFrame) -> DataFrame:
    """task_id, status, progress, at: the last event of each task; also as a stream in update mode."""
    last = F.max_by(F.struct("status", "progress"), F.struct("ts", "event_id"))
    return events.groupBy("task_id").agg(last.alias("x"), F.max("ts").alias("at")).select("task_id", "x.status", "x.progress", "at")


def event_rates(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """task_id, start, end, n: a session ends when its task is silent for the gap."""
    return events.groupBy("task_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("task_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def illegal_steps(events: DataFrame) -> DataFrame:
    """task_id, before, status, n: a finished task that goes on."""
    w = Window.partitionBy("task_id").orderBy("ts", "event_id")
    each = events.withColumn("before", F.lag("status").over(w))
    return each.where(F.col("before").isin(TERMINAL) & (F.col("status") != F.col("before"))).groupBy("task_id", "before", "status").agg(F.count("*").alias("n"))


def task_metrics(finished: DataFrame, most: int = 1000) -> DataFrame:
    """source, n, n_failed, mean_value of the last 1000: the limit is the measure's own window."""
    w = Window.partitionBy("status").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = finished.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    mean = recent.groupBy("status").agg(F.count("*").alias("n_recent"), F.avg("value").alias("mean_value"))
    return finished.groupBy("status").agg(F.count("*").alias("n")).join(mean, "status")
