"""Scores from 0 to 100: ratios normalised against a profile's benchmarks, weighted, and capped where data are missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dims
from statloom.functions.numbers import canonical
from statloom.operators.ratios import array_of

PROFILES = ("generic", "retail_demo")


def normalised(value: Column, row: tuple, profile: Column) -> Column:
    """A ratio between 0 and 1 against its target; null outside plausible limits."""
    _, _, generic, retail, higher, least, most = row
    target = F.when(profile == "retail_demo", F.lit(retail)).otherwise(F.lit(generic))
    score = F.when(value <= 0, 0.0).otherwise(F.least(value / target, F.lit(1.0))) if higher else F.when(value <= 0, None).when(value >= 2 * target, 0.0).otherwise(1 - value / (2 * target))
    score = F.when(value.isNull() | F.isnan(value), None).otherwise(score)
    return score if least is None else F.when(value.between(least, most), score)


def scored(wide: DataFrame, profile: Column | None = None) -> DataFrame:
    """wide (a column for each ratio) with raw_score, score, confidence_score, risk_level; one row stays one row."""
    profile = F.lit("generic") if profile is None else profile
    parts = [(normalised(F.col(r[0]), r, profile), r[1]) for r in dims.SCORING if r[0] in wide.columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(s * w, F.lit(0.0)) for s, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts])
    out = wide.withColumns({"_total": total, "_weight": weight})
    out = out.withColumn("raw_score", F.when(F.col("_weight") > 0, F.col("_total") / F.col("_weight") * 100).otherwise(0.0))
    return out.withColumns({"score": F.round("raw_score", 2), "confidence_score": F.round("_weight", 2), "risk_level": risk(F.col("raw_score"))}).drop("_total", "_weight")


def risk(score: Column) -> Column:
    return F.when(score >= 75, "low").when(score >= 55, "medium").when(score >= 35, "high").otherwise("critical")


def capped(scored: DataFrame) -> DataFrame:
    """Scores of statements with missing facts or little weight are capped; guardrails say why, if the score fell."""
    missing = lambda keys, tag: array_of(*[(F.col(k).isNull(), f"{tag}:{k}") for k in keys])
    core, supporting = missing(dims.CORE, "missing_core"), missing(dims.SUPPORTING, "missing_supporting")
    low = F.col("confidence_score") < dims.LEAST_CONFIDENCE
    cap = F.when(F.size(core) > 0, dims.CAPS["core"]).when(F.size(supporting) > 0, dims.CAPS["supporting"]).when(low, dims.CAPS["confidence"])
    why = F.when(F.size(core) > 0, core).when(F.size(supporting) > 0, supporting).when(low, F.array(F.lit("low_confidence")))
    fell = F.coalesce(F.col("score") > cap, F.lit(False))
    return scored.withColumns({
        "capped_score": F.when(fell, cap).otherwise(F.col("score")), "capped_risk": F.when(fell, risk(cap)).otherwise(F.col("risk_level")),
        "guardrails": F.when(fell, why).otherwise(F.array().cast("array<string>")),
    })


def any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def period_basis(text: Column, revenue: Column) -> Column:
    low = F.lower(text)
    return F.when(revenue.isNull(), "reported").when(any_word(low, dims.Q1_MARKERS), "annualized_q1").when(any_word(low, dims.H1_MARKERS), "annualized_h1").otherwise("reported")


def annualised(facts: DataFrame, basis: str = "period_basis") -> DataFrame:
    factor = F.when(F.col(basis) == "annualized_q1", 4.0).when(F.col(basis) == "annualized_h1", 2.0).otherwise(1.0)
    return facts.withColumns({k: F.col(k) * factor for k in dims.ANNUALISED if k in facts.columns})


def profile_of(text: Column, inventory: Column, asset_turnover: Column, receivables_turnover: Column) -> Column:
    quick = F.coalesce(asset_turnover >= 1.2, F.lit(False)) | F.coalesce(receivables_turnover >= 20, F.lit(False))
    return F.when(any_word(F.lower(text), dims.RETAIL_WORDS) | (inventory.isNotNull() & quick), "retail_demo").otherwise("generic")


def factors(wide: DataFrame, keys: list[str], profile: Column | None = None) -> DataFrame:
    """keys, ratio, normalised, impact: the ratios that count, as rows."""
    profile = F.lit("generic") if profile is None else profile
    each = [F.struct(F.lit(r[0]).alias("ratio"), canonical(normalised(F.col(r[0]), r, profile)).alias("normalised")) for r in dims.SCORING if r[0] in wide.columns]
    long = wide.select(*keys, F.explode(F.array(*each)).alias("f")).select(*keys, "f.*").where(F.col("normalised").isNotNull())
    return long.withColumn("impact", F.when(F.col("normalised") >= 0.65, "positive").when(F.col("normalised") >= 0.35, "neutral").otherwise("negative"))
