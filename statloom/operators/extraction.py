"""Metric candidates from table rows and model responses: generation, ranking, gates, derivation, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import words
from statloom.functions.numbers import materially_differs, parse_amount, valid_value
from statloom.operators.text import fresh


def first_number(cells: Column) -> Column:
    """The first cell that is an amount: it has digits and is no code of one to three digits and no year."""
    return F.try_element_at(F.filter(F.transform(F.filter(cells, lambda c: c.rlike("[0-9]") & ~c.rlike("^[0-9]{1,3}$")), parse_amount), lambda v: valid_value(v)), F.lit(1))


def by_code(rows: DataFrame) -> DataFrame:
    """doc, row_no, metric_key, value, quality: rows of three cells or more with a known line code in one of them."""
    codes = F.create_map(*[F.lit(x) for pair in words.CODES.items() for x in pair])
    each = rows.where(F.size("cells") >= 3).select("doc", "row_no", "cells", F.posexplode("cells").alias("at", "cell"))
    known = each.where(F.col("cell").isin(list(words.CODES))).withColumn("metric_key", codes[F.col("cell")])
    value = first_number(F.slice("cells", F.col("at") + 2, F.greatest(F.size("cells"), F.lit(1))))
    return known.select("doc", "row_no", "metric_key", value.alias("value"), F.lit(120).alias("quality")).where(F.col("value").isNotNull())


def financial_tables(rows: DataFrame) -> DataFrame:
    """doc, n_rows, n_large (rows with an amount of six digits), financial."""
    row = F.lower(F.array_join("cells", " "))
    hit = F.greatest(*[row.contains(k).cast("int") for k in words.LABELS])
    large = F.exists("cells", lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")) >= 6)
    agg = rows.groupBy("doc").agg(F.count("*").alias("n_rows"), F.count_if(large).alias("n_large"), F.sum(hit).alias("n_hits"))
    return agg.select("doc", "n_rows", "n_large", ((F.col("n_hits") >= 2) | (F.col("n_large") >= 5)).alias("financial"))


def priority() -> Column:
    exact = F.when(F.col("match_type") == "table", 3).otherwise(2)
    return F.when(F.col("is_exact"), exact).when(F.col("match_type") == "text", 2).when(F.col("match_type") == "table", 1).otherwise(0)


def winners(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of each key with the highest priority, then quality; the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc("priority"), F.desc("quality"), "seq")
    (place,) = fresh([*candidates.columns, "priority"], "place")
    return candidates.withColumn("priority", priority()).withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def conflicts(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_conflicts: later candidates of quality 60 or more that differ materially from the winner."""
    best = winners(candidates, keys).select(*keys, F.col("seq").alias("w_seq"), F.col("value").alias("w_value"))
    against = (F.col("seq") > F.col("w_seq")) & (F.col("quality") >= 60) & materially_differs("value", "w_value")
    return candidates.join(best, keys).groupBy(*keys).agg(F.count_if(against).alias("n_conflicts"))


def gated(candidates: DataFrame, keys: list[str], gate: int) -> DataFrame:
    """Candidates of the stage gate exist only where no earlier stage reached priority 2."""
    before = F.max(F.when(F.col("stage") < gate, priority())).over(Window.partitionBy(*keys))
    (held,) = fresh(candidates.columns, "held")
    return candidates.withColumn(held, F.coalesce(before, F.lit(0))).where((F.col("stage") < gate) | (F.col(held) < 2)).drop(held)


def kept_value(value: Column, confidence: Column, threshold: float = 0.5, override: Column | None = None) -> Column:
    ok = confidence >= threshold
    return F.when(ok if override is None else ok | override, value)


def level(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def derived(facts: DataFrame) -> DataFrame:
    """Liabilities from assets and equity, short-term ones as the rest, current assets from parts or as the remainder."""
    gap = F.col("total_assets") - F.col("equity")
    out = facts.withColumn("liabilities", F.coalesce("liabilities", F.when(gap / F.when(F.col("total_assets") != 0, F.col("total_assets")) >= 0.02, gap)))
    short = F.col("liabilities") - F.col("long_term_liabilities")
    out = out.withColumn("short_term_liabilities", F.coalesce("short_term_liabilities", F.when(short >= 0, short)) if "short_term_liabilities" in facts.columns else F.when(short >= 0, short))
    left = F.col("total_assets") - F.col("equity") - F.col("liabilities")
    parts = F.array_compact(F.array(*[F.col(c) for c in ("inventory", "accounts_receivable", "cash_and_equivalents") if c in facts.columns]))
    total = F.when(F.size(parts) >= 2, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))
    return out.withColumn("current_assets", F.coalesce("current_assets", total, F.when(left > 0, left)))


def guarded(facts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Parts larger than their totals become null, in the order of the rules, with an event for each."""
    out = facts.withColumn("events", F.array().cast("array<string>"))
    for part, whole in rules:
        bad = F.coalesce(F.col(part) > F.col(whole), F.lit(False))
        out = out.withColumns({"events": F.when(bad, F.array_append("events", F.lit(f"{part}>{whole}"))).otherwise(F.col("events")), part: F.when(~bad, F.col(part))})
    return out


def model_items(responses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric_key, value, confidence: the items of a response, fenced or not; of one cut off, its whole items."""
    items = F.regexp_extract_all("response", F.lit(r'\{[^{}]*"metric"[^{}]*\}'), 0)
    item = F.from_json("item", "metric string, value double, confidence_score double")
    each = responses.select(*keys, F.explode(items).alias("item")).select(*keys, item.alias("x"))
    known = sorted({*words.LABELS.values(), *words.CODES.values()})
    out = each.select(*keys, F.col("x.metric").alias("metric_key"), F.col("x.value").alias("value"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x.confidence_score"))).alias("confidence"))
    return out.where(F.col("metric_key").isin(known) & F.col("value").isNotNull())


def merged(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, confidence: of several chunks the most confident, the first of equals."""
    best = F.max_by(F.struct("value", "confidence"), F.struct("confidence", -F.col("chunk_no")))
    return items.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.value", "b.confidence")


def anomaly_checked(items: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Items outside a metric's limits have a confidence of 0.3 at most."""
    outside = F.lit(False)
    for key, (low, high) in limits.items():
        broken = (F.col("value") < low if low is not None else F.lit(False)) | (F.col("value") > high if high is not None else F.lit(False))
        outside = F.when(F.col("metric_key") == key, broken).otherwise(outside)
    return items.withColumn("confidence", F.when(outside, F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence")))


def prefer_model(value: Column, confidence: Column, fallback: Column) -> Column:
    """A confident model value beats a missing fallback, and one of its sign and size within a factor of ten."""
    ratio = F.greatest(F.abs(fallback), F.abs(value)) / F.least(F.abs(fallback), F.abs(value))
    near = (F.signum(fallback) == F.signum(value)) & (ratio < 10)
    return (confidence >= 0.7) & (fallback.isNull() | near)
