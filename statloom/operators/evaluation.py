"""Calibration: how well confidences and thresholds fit outcomes (case_id, suite, surface, confidence, correct)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reliability_bins(outcomes: DataFrame, n: int = 5) -> DataFrame:
    """bin, count, mean_confidence, accuracy: equal bins, the last one closed; empty bins stay, as zeros."""
    bins = outcomes.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    found = outcomes.withColumn("bin", F.least(F.floor(F.col("confidence") * n), F.lit(n - 1)).cast("int"))
    found = found.groupBy("bin").agg(F.count("*").alias("count"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    out = F.broadcast(bins).join(found, "bin", "left")
    return out.select("bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("count", "mean_confidence", "accuracy")])


def summary(outcomes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: n, accuracy, acceptance, share near the threshold, mean confidence, Brier score, calibration error."""
    hit = F.col("correct").cast("double")
    one = outcomes.agg(
        F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg((F.col("confidence") >= threshold).cast("double")).alias("acceptance"),
        F.avg((F.abs(F.col("confidence") - threshold) <= 0.05).cast("double")).alias("boundary"), F.avg("confidence").alias("mean_confidence"),
        F.avg((F.col("confidence") - hit) * (F.col("confidence") - hit)).alias("brier"),
    )
    error = reliability_bins(outcomes).agg((F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("count")).alias("ece"))
    return one.join(F.broadcast(error))  # one row each


def threshold_sweep(outcomes: DataFrame, threshold: float, steps: list[float]) -> DataFrame:
    """threshold, accepted, false_accepts, false_rejects for each step, in one pass over the outcomes."""
    at = F.explode(F.array(*[F.lit(round(threshold + s, 2)) for s in steps])).alias("threshold")
    each = outcomes.select("confidence", "correct", at)
    taken = F.col("confidence") >= F.col("threshold")
    return each.groupBy("threshold").agg(F.count_if(taken).alias("accepted"), F.count_if(taken & ~F.col("correct")).alias("false_accepts"), F.count_if(~taken & F.col("correct")).alias("false_rejects"))


def policy_diff(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose confidence or acceptance differs between two policies, or that only one of them has."""
    a = base.select(*keys, F.col("accepted").alias("base_accepted"), F.col("confidence").alias("base_confidence"))
    b = other.select(*keys, F.col("accepted").alias("other_accepted"), F.col("confidence").alias("other_confidence"))
    return a.join(b, keys, "full").where(~F.col("base_accepted").eqNullSafe(F.col("other_accepted")))


def rank_order(order: DataFrame) -> DataFrame:
    """pair, holds: whether each profile is trusted at least as much as the next in order (no, profile, confidence)."""
    w = Window.partitionBy("policy").orderBy("no")
    out = order.withColumns({"next": F.lead("profile").over(w), "next_confidence": F.lead("confidence").over(w)}).where("next IS NOT NULL")
    return out.select("policy", F.concat_ws(">", "profile", "next").alias("pair"), (F.col("confidence") >= F.col("next_confidence")).alias("holds"))


def coverage(outcomes: DataFrame, required: list[str]) -> DataFrame:
    """suite (null: all), surface, n: required surfaces that a scope lacks are there with n = 0."""
    counted = outcomes.rollup("suite", "surface").agg(F.count("*").alias("n"), F.grouping("suite").alias("g1"), F.grouping("surface").alias("g2"))
    by_suite = counted.where("g1 = 0 AND g2 = 0").select("suite", "surface", "n")
    overall = outcomes.groupBy("surface").agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("suite"), "surface", "n")
    wanted = outcomes.select("suite").distinct().union(outcomes.limit(1).select(F.lit(None).cast("string"))).select("suite", F.explode(F.array(*map(F.lit, required))).alias("surface"))
    both = by_suite.union(overall)
    return wanted.join(both, wanted.suite.eqNullSafe(both.suite) & (wanted.surface == both.surface), "left").select(wanted.suite, wanted.surface, F.coalesce("n", F.lit(0)).alias("n"))
