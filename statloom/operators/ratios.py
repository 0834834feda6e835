"""Ratios with validity and reasons. Each ratio passes the same gates in order; the first that fails decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dims
from statloom.functions.numbers import canonical


def array_of(*pairs: tuple[Column, str]) -> Column:
    """The reasons whose conditions hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in pairs]))


def input_reasons(key: Column, value: Column, unit: Column) -> Column:
    """Why an input is not usable: its unit, then not finite, then negative where that can't be."""
    infinite = F.isnan(value) | (F.abs(value) == float("inf"))
    reason = (
        F.when(~unit.isin(dims.UNITS), "MATH_INPUT_UNEXPECTED_UNIT")  # no unit is none to object to
        .when(infinite, "MATH_INPUT_NON_FINITE")
        .when((value < 0) & key.isin(dims.NON_NEGATIVE), "MATH_INPUT_UNEXPECTED_NEGATIVE")
    )
    return F.array_compact(F.array(reason))


def validate_inputs(inputs: DataFrame) -> DataFrame:
    """inputs (metric_key, value, unit) with reason_codes; the value of an unusable input is null."""
    out = inputs.withColumn("reason_codes", input_reasons(F.col("metric_key"), F.col("value"), F.col("unit")))
    return out.withColumn("value", F.when(F.size("reason_codes") == 0, F.col("value")))


def candidates(validated: DataFrame) -> DataFrame:
    """Validated inputs as reported candidates with a state."""
    state = F.when(F.size("reason_codes") > 0, "invalid").when(F.col("value").isNull(), "missing").otherwise("ready")
    return validated.withColumns({"kind": F.lit("reported"), "state": state})


def denominator_class(x: Column) -> Column:
    return (
        F.when(x.isNull(), "missing").when(F.isnan(x) | (F.abs(x) == float("inf")), "non_finite").when(x == 0, "zero")
        .when(F.abs(x) < 1e-9, "near_zero").when(x < 0, "negative").otherwise("positive")
    )


def denominator_reason(x: Column, policy: str = "strict_positive") -> Column:
    allowed = ["positive"] if policy == "strict_positive" else ["positive", "negative"]
    kind = denominator_class(x)
    return F.when(kind == "missing", "MATH_DENOMINATOR_INPUT_MISSING").when(~kind.isin(allowed), "MATH_DENOMINATOR_POLICY_REFUSED")


def guarded_ratio(num: Column, den: Column) -> tuple[Column, Column]:
    """The quotient, or null and the guard that refused it."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    guard = (
        F.when(num.isNull() | den.isNull(), "MATH_FORMULA_INPUTS_MISSING").when(bad(num) | bad(den), "MATH_FORMULA_INPUT_NON_FINITE")
        .when(den == 0, "MATH_FORMULA_DENOMINATOR_ZERO").when(F.abs(den) < 1e-9, "MATH_FORMULA_DENOMINATOR_NEAR_ZERO")
    )
    return F.when(guard.isNull(), num / F.when(den != 0, den)), guard


def ordered_reasons(reasons: Column) -> Column:
    """Different reasons by (tier, code): the first is the primary one."""
    tier = F.create_map(*[F.lit(x) for pair in dims.TIERS.items() for x in pair])
    ranked = F.array_sort(F.transform(F.array_distinct(reasons), lambda r: F.struct(F.coalesce(tier[r], F.lit(999)).alias("tier"), r.alias("code"))))
    return F.transform(ranked, lambda x: x["code"])


def confidence(*known: Column) -> Column:
    """The least of the known confidences, less a tenth (to 4 digits) if one is unknown."""
    least = F.array_min(F.array(*known))
    some_unknown = F.array_contains(F.array(*[k.isNull() for k in known]), True)
    return F.when(some_unknown, F.round(least * 0.9, 4)).otherwise(least)


def all_ratios(facts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric_id, value, validity, reason, reasons: 15 rows for each statement, without a shuffle. facts may have
    opening_total_assets and opening_equity; without them the average ratios lack their opening balance. The inputs of
    each ratio become a row first, so that the gates are one expression and not one for each ratio."""
    for base in ("total_assets", "equity"):
        if f"opening_{base}" not in facts.columns:
            facts = facts.withColumn(f"opening_{base}", F.lit(None).cast("double"))
    none = F.lit(None).cast("double")

    def row(metric, kind, n, opening, closing, n_signed, d_signed):
        cells = {"metric_id": F.lit(metric), "kind": F.lit(kind), "n": n, "opening": opening, "closing": closing, "n_signed": F.lit(n_signed), "d_signed": F.lit(d_signed)}
        return F.struct(*[c.alias(k) for k, c in cells.items()])

    signed = lambda k: k not in dims.NON_NEGATIVE
    each = [row(m, "simple", F.col(n), none, F.col(d), signed(n), signed(d)) for m, n, d in dims.RATIOS]
    each += [row(m, "average", F.col(n), F.col(f"opening_{b}"), F.col(b), signed(n), False) for m, n, b in dims.AVERAGE_RATIOS]
    each += [row(m, "suppressed", none, none, none, True, True) for m in dims.SUPPRESSED]
    long = facts.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.*")
    average = F.col("kind") == "average"
    long = long.withColumn("d", F.when(average, (F.col("opening") + F.col("closing")) / 2).otherwise(F.col("closing")))
    n, d = F.col("n"), F.col("d")
    basis = (
        F.when(F.col("kind") == "suppressed", F.array(F.lit("MATH_COVERAGE_INTENTIONALLY_SUPPRESSED")))
        .when(average & F.col("opening").isNull(), F.array(F.lit("COMPARATIVE_MISSING_OPENING_BALANCE"), F.lit("COMPARATIVE_FORBIDDEN_APPROXIMATION")))
        .when(average & F.col("closing").isNull(), F.array(F.lit("COMPARATIVE_MISSING_CLOSING_BALANCE")))
    )
    negative = ((n < 0) & ~F.col("n_signed")) | ((d < 0) & ~F.col("d_signed"))
    quotient, guard = guarded_ratio(n, d)
    later = array_compact(denominator_reason(d), F.when(n.isNull(), F.lit("MATH_REQUIRED_INPUT_MISSING")))
    reasons = F.coalesce(basis, F.when(F.coalesce(negative, F.lit(False)), F.array(F.lit("MATH_INPUT_UNEXPECTED_NEGATIVE"))), F.when(F.size(later) > 0, later), array_compact(guard))
    judged = long.withColumns({"quotient": quotient, "found": reasons})
    ok = F.size("found") == 0
    validity = F.when(ok, "valid").when(F.col("kind") == "suppressed", "suppressed").otherwise("invalid")
    out = judged.select(*keys, "metric_id", canonical(F.when(ok, F.col("quotient"))).alias("value"), validity.alias("validity"), ordered_reasons(F.col("found")).alias("reasons"))
    return out.select(*keys, "metric_id", "value", "validity", F.try_element_at("reasons", F.lit(1)).alias("reason"), "reasons")


def array_compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def wide(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """One column for each ratio, null unless valid."""
    names = [r[0] for r in dims.RATIOS + dims.AVERAGE_RATIOS] + dims.SUPPRESSED
    return ratios.groupBy(*keys).pivot("metric_id", names).agg(F.first(F.when(F.col("validity") == "valid", F.col("value")), ignorenulls=True))


def emission_violations(ratios: DataFrame) -> DataFrame:
    """Rows that break the rules of what may leave the engine."""
    valid = F.col("validity") == "valid"
    broken = array_of(
        (valid & F.col("value").isNull(), "valid_without_value"), (~valid & F.col("value").isNotNull(), "value_without_validity"),
        (~valid & F.col("reason").isNull(), "refusal_without_reason"), (valid & F.col("reason").isNotNull(), "valid_with_primary_reason"),
    )
    return ratios.withColumn("violations", broken).where(F.size("violations") > 0)


def precedence(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of the ready candidates (kind, state, value) of a key the best kind wins; two of it are ambiguous."""
    rank = F.when(F.col("kind") == "reported", 0).when(F.col("kind") == "derived", 1).otherwise(2)
    ready = F.col("state") == "ready"
    best = F.min(F.when(ready, rank))
    agg = candidates.groupBy(*keys).agg(best.alias("best"), *[F.sum(F.when(ready & (rank == i), 1).otherwise(0)).alias(f"n{i}") for i in range(3)], *[F.max(F.when(ready & (rank == i), F.col("value"))).alias(f"v{i}") for i in range(3)])
    n = F.element_at(F.array("n0", "n1", "n2"), F.col("best") + 1)
    outcome = F.when(F.col("best").isNull(), "no_candidate").when(n > 1, "ambiguous").otherwise("resolved")
    value = F.when(outcome == "resolved", F.element_at(F.array("v0", "v1", "v2"), F.col("best") + 1))
    kind = F.when(outcome == "resolved", F.element_at(F.array(*map(F.lit, ("reported", "derived", "synthetic"))), F.col("best") + 1))
    return agg.select(*keys, outcome.alias("outcome"), kind.alias("kind"), value.alias("value"))
