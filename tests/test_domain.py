"""Cases with known results: periods, ratios, scores, amounts."""

import pytest
from pyspark.sql import functions as F

from statloom.functions import dims, numbers
from statloom.operators import periods, ratios, scoring

COLUMNS = "entity_id int, period_label string, revenue double, net_profit double, total_assets double, equity double, liabilities double, current_assets double, short_term_liabilities double, cash_and_equivalents double, currency string"


def statements(spark, *rows):
    return spark.createDataFrame(rows, COLUMNS)


def values(df):
    return {(r.period_label, r.metric_id): r for r in df.collect()}


def test_opening_balance_makes_average_ratios(spark):
    facts = statements(spark, (1, "2023", 100.0, 10.0, 100.0, 50.0, 50.0, 60.0, 30.0, 9.0, "RUB"), (1, "2024", 120.0, 12.0, 140.0, 70.0, 70.0, 60.0, 30.0, 9.0, "RUB"))
    got = values(ratios.all_ratios(periods.linked(periods.parsed(facts)), ["entity_id", "period_label"]))
    assert (got["2024", "roa"].value, got["2024", "roe"].value, got["2024", "asset_turnover"].value) == (0.1, 0.2, 1.0)
    assert got["2023", "roa"].reason == "COMPARATIVE_FORBIDDEN_APPROXIMATION" and got["2023", "roa"].value is None
    assert got["2023", "current_ratio"].value == 2.0 and got["2023", "quick_ratio"].validity == "suppressed" and len(got) == 30


def test_half_year_opens_with_the_prior_full_year_and_a_gap_links_nothing(spark):
    row = lambda p: (1, p, 1.0, 1.0, 10.0, 5.0, 5.0, 1.0, 1.0, 1.0, "RUB")
    got = {r.period_label: r for r in periods.linked(periods.parsed(statements(spark, row("2020"), row("h1/2021"), row("2023"), row("Q4/2021"), row("x")))).collect()}
    assert got["h1/2021"].has_opening and not got["h1/2021"].has_prior and got["h1/2021"].state == "partially_comparable"
    assert not got["2023"].has_opening and got["2023"].flags == ["missing_prior_period", "missing_opening_balance"]
    assert got["Q4/2021"].flags == ["unsupported_period_class"] and got["x"].period_id is None


def test_duplicates_are_not_comparable(spark):
    row = lambda e, p: (e, p, 1.0, 1.0, 10.0, 5.0, 5.0, 1.0, 1.0, 1.0, "RUB")
    got = periods.linked(periods.parsed(statements(spark, row(1, "2020"), row(1, " 2020 "), row(1, "2021"), row(2, "2020")))).collect()
    assert sorted((r.entity_id, r.period_label.strip(), r.is_duplicate, r.has_opening) for r in got) == [(1, "2020", True, False), (1, "2020", True, False), (1, "2021", False, False), (2, "2020", False, False)]


@pytest.mark.parametrize(("value", "kind"), [(None, "missing"), (0.0, "zero"), (-0.0, "zero"), (1e-12, "near_zero"), (-3.0, "negative"), (float("nan"), "non_finite"), (float("inf"), "non_finite"), (2.0, "positive")])
def test_denominators(spark, value, kind):
    assert spark.createDataFrame([(value,)], "x double").select(ratios.denominator_class(F.col("x"))).first()[0] == kind


def test_missing_revenue_caps_the_score(spark):
    wide = statements(spark, (1, "2024", None, 5.0, 100.0, 60.0, 40.0, 90.0, 30.0, 30.0, "RUB"))
    wide = wide.withColumns({"current_ratio": F.lit(3.0), "absolute_liquidity_ratio": F.lit(1.0), "equity_ratio": F.lit(0.6)})
    r = scoring.capped(scoring.scored(wide)).first()
    assert (r.score, r.capped_score, r.capped_risk, r.guardrails) == (100.0, 39.99, "high", ["missing_core:revenue"])


def test_weights_sum_to_one():
    assert abs(sum(r[1] for r in dims.SCORING) - 1) < 1e-9


def test_reasons_are_ordered_by_tier(spark):
    df = spark.range(1).select(ratios.ordered_reasons(F.array(*map(F.lit, ["MATH_INPUT_NON_FINITE", "MATH_REQUIRED_INPUT_MISSING", "MATH_INPUT_NON_FINITE", "MATH_DENOMINATOR_INPUT_MISSING"]))).alias("r"))
    assert df.first().r == ["MATH_REQUIRED_INPUT_MISSING", "MATH_DENOMINATOR_INPUT_MISSING", "MATH_INPUT_NON_FINITE"]


AMOUNTS = [
    ("1 234 567", 1234567.0), ("1,234.56", 1234.56), ("1.234.567,89", 1234567.89), ("(1 234)", -1234.0), ("−55", -55.0), ("12,5", 12.5), ("1,234", 1234.0), ("1.234", 1234.0),
    ("12345678901234567", None), ("", None), ("-", None), ("abc", None), (None, None), ("7 руб", 7.0),
]


@pytest.mark.parametrize(("raw", "want"), AMOUNTS)
def test_amounts(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(numbers.parse_amount("x")).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("1,5 млн", 1.5e6), ("500 тыс руб", 5e5), ("$1,234,567.89", 1234567.89), ("1.234.567", 1234567.0), ("2 млрд.", 2e9), ("-", None), ("x", None), (None, None), ("1 234", 1234.0)])
def test_scaled_amounts(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(numbers.parse_scaled("x")).first()[0] == want


@pytest.mark.parametrize(("x", "want"), [(1234.5, "X,XXX"), (-12.0, "-XX"), (0.0, "X"), (None, None)])
def test_masks(spark, x, want):
    assert spark.createDataFrame([(x,)], "x double").select(numbers.masked("x")).first()[0] == want
