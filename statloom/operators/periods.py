"""Reporting periods: labels, links to the prior and the opening period, comparability, average balances, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.numbers import canonical
from statloom.operators.ratios import array_of

ENDS = {"FY": (12, 31), "Q1": (3, 31), "Q2": (6, 30), "H1": (6, 30), "Q3": (9, 30), "Q4": (12, 31)}
ORDER = {"Q1": 1, "Q2": 2, "H1": 3, "Q3": 4, "Q4": 6, "FY": 7}


def parse(label: Column | str) -> dict[str, Column]:
    """period_class, fiscal_year, period_id, period_end of a label Qn/YYYY, H1/YYYY or YYYY; null for any other."""
    text = F.upper(F.trim(F.col(label) if isinstance(label, str) else label))
    kind = F.when(text.rlike(r"^(Q[1-4]|H1)/[0-9]{4}$"), F.substring_index(text, "/", 1)).when(text.rlike(r"^[0-9]{4}$"), "FY")
    year = F.when(kind.isNotNull(), F.right(text, F.lit(4)).try_cast("int"))
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in ENDS.items() for x in (k, v[i])]), kind)
    return {"period_class": kind, "fiscal_year": year, "period_id": F.concat_ws("/", kind, year.cast("string")), "period_end": F.make_date(year, pick(0), pick(1))}


def parsed(periods: DataFrame, label: str = "period_label") -> DataFrame:
    out = periods.withColumns(parse(label))
    return out.withColumn("period_id", F.when(F.col("period_class").isNotNull(), F.col("period_id")))


def sort_key(kind: Column, year: Column) -> tuple[Column, Column]:
    order = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])
    return F.coalesce(year, F.lit(9999)).alias("sort_year"), F.coalesce(F.element_at(order, kind), F.lit(99)).alias("sort_class")


def linked(periods: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Parsed periods with their links: has_prior, has_opening, opening_<base>, opening_currency, state, flags. One
    shuffle by entity and class serves duplicates and the prior link; the opening year is joined by entity and year."""
    w = Window.partitionBy(entity, "period_class", "fiscal_year")
    each = periods.withColumn("is_duplicate", (F.count("*").over(w) > 1) & F.col("period_class").isNotNull())
    usable = each.where(~F.col("is_duplicate") & F.col("period_class").isNotNull())
    prior = usable.select(entity, "period_class", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.lit(True).alias("has_prior"))
    opening = usable.where("period_class = 'FY'").select(
        entity, (F.col("fiscal_year") + 1).alias("fiscal_year"), F.lit(True).alias("has_opening"), F.col("total_assets").alias("opening_total_assets"),
        F.col("equity").alias("opening_equity"), F.col("currency").alias("opening_currency"),
    )
    out = each.join(prior, [entity, "period_class", "fiscal_year"], "left").join(opening, [entity, "fiscal_year"], "left")
    strict = F.col("period_class").isin("FY", "Q1", "H1") & ~F.col("is_duplicate")
    has_prior, has_opening = F.coalesce(strict & F.col("has_prior"), F.lit(False)), F.coalesce(strict & F.col("has_opening"), F.lit(False))
    out = out.withColumns({"has_prior": has_prior, "has_opening": has_opening})
    keep = F.col("has_opening")
    out = out.withColumns({c: F.when(keep, F.col(c)) for c in ("opening_total_assets", "opening_equity", "opening_currency")})
    state = F.when(F.col("has_prior") & keep, "comparable").when(keep, "partially_comparable").otherwise("not_comparable")
    strict = F.coalesce(F.col("period_class").isin("FY", "Q1", "H1"), F.lit(False))
    flags = (
        F.when(F.col("is_duplicate"), F.array(F.lit("duplicate_period_id"))).when(~strict, F.array(F.lit("unsupported_period_class")))
        .otherwise(array_of((~F.col("has_prior"), "missing_prior_period"), (~keep, "missing_opening_balance"), (keep & ~F.col("has_prior"), "partially_comparable_context"), (keep & (F.col("currency") != F.col("opening_currency")), "inconsistent_currency")))
    )
    return out.withColumns({"state": state, "flags": flags})


def averaged(periods: DataFrame) -> DataFrame:
    """Linked periods with average_<base> to 4 digits, null where the balances can't be compared."""
    fits = (F.col("state") != "not_comparable") & ~F.array_contains("flags", "inconsistent_currency")
    mean = lambda b: canonical(F.when(fits, (F.col(f"opening_{b}") + F.col(b)) / 2))
    return periods.withColumns({f"average_{b}": mean(b) for b in ("total_assets", "equity")})


def trends(ratios: DataFrame, threshold: float, entity: str = "entity_id") -> DataFrame:
    """entity, metric_id, previous, latest, direction, is_anomaly, from the last two values of each ratio's periods."""
    w = Window.partitionBy(entity, "metric_id").orderBy("sort_year", "sort_class")
    last = Window.partitionBy(entity, "metric_id").orderBy(F.desc("sort_year"), F.desc("sort_class"))
    known = ratios.where(F.col("value").isNotNull()).withColumn("previous", F.lag("value").over(w)).withColumn("rn", F.row_number().over(last)).where("rn = 1")
    change = F.col("value") - F.col("previous")
    direction = F.when(change.isNull(), "none").when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    return known.select(entity, "metric_id", "previous", F.col("value").alias("latest"), direction.alias("direction"), F.coalesce(F.abs(change) > threshold, F.lit(False)).alias("is_anomaly"))
