"""Fixed values of the domain: metric keys, ratios, weights, benchmarks, limits, reasons. All tables are small."""

#: Facts of a statement.
FACTS = "revenue net_profit cost_of_goods_sold interest_expense total_assets equity liabilities current_assets short_term_liabilities accounts_receivable cash_and_equivalents".split()

#: Ratio, numerator, denominator.
RATIOS = [
    ("current_ratio", "current_assets", "short_term_liabilities"),
    ("absolute_liquidity_ratio", "cash_and_equivalents", "short_term_liabilities"),
    ("ros", "net_profit", "revenue"),
    ("equity_ratio", "equity", "total_assets"),
]
#: Ratios over the average of opening and closing balance.
AVERAGE_RATIOS = [("roa", "net_profit", "total_assets"), ("roe", "net_profit", "equity"), ("asset_turnover", "revenue", "total_assets")]
#: Ratios that are never computed.
SUPPRESSED = "ebitda_margin quick_ratio financial_leverage financial_leverage_total financial_leverage_debt_only interest_coverage inventory_turnover receivables_turnover".split()
NON_NEGATIVE = "current_assets short_term_liabilities cash_and_equivalents revenue equity total_assets average_total_assets average_equity".split()
UNITS = ["currency"]

#: Ratio, weight, generic target, retail target, higher is better, least and greatest plausible value.
SCORING = [
    ("current_ratio", 0.15, 2.0, 1.0, True, None, None),
    ("quick_ratio", 0.07, 1.0, 0.7, True, None, None),
    ("absolute_liquidity_ratio", 0.03, 0.2, 0.1, True, None, None),
    ("roa", 0.10, 0.08, 0.05, True, -1.0, 2.0),
    ("roe", 0.10, 0.15, 0.12, True, -5.0, 5.0),
    ("ros", 0.08, 0.10, 0.04, True, -2.0, 2.0),
    ("ebitda_margin", 0.07, 0.15, 0.08, True, -2.0, 2.0),
    ("equity_ratio", 0.12, 0.5, 0.35, True, -1.0, 1.5),
    ("financial_leverage", 0.08, 1.0, 2.0, False, 0.0, 100.0),
    ("interest_coverage", 0.05, 3.0, 2.0, True, -50.0, 500.0),
    ("asset_turnover", 0.05, 1.0, 1.5, True, 0.0, 50.0),
    ("inventory_turnover", 0.05, 8.0, 10.0, True, 0.0, 500.0),
    ("receivables_turnover", 0.05, 8.0, 10.0, True, 0.0, 500.0),
]
CORE = ["revenue", "total_assets", "liabilities", "current_assets", "short_term_liabilities"]
SUPPORTING = ["net_profit", "equity"]
CAPS = {"core": 39.99, "supporting": 54.99, "confidence": 59.99}
LEAST_CONFIDENCE = 0.4
ANNUALISED = ["revenue", "net_profit", "ebitda", "ebit", "interest_expense", "cost_of_goods_sold"]
RETAIL_WORDS = ["магнит", "x5", "лента", "fix price", "окей", "детский мир", "retail", "рознич", "торговая сеть", "магазин"]
Q1_MARKERS = ["1 квартал", "q1", "three months", "январь - март", "январь-март"]
H1_MARKERS = ["1 полугодие", "h1", "half-year", "six months", "январь - июнь", "январь-июнь"]

#: Reason codes by tier; the lowest (tier, code) is the primary reason.
TIERS = {
    "MATH_REQUIRED_INPUT_MISSING": 10,
    "MATH_UNIT_INCOMPATIBLE": 20,
    "MATH_DENOMINATOR_INPUT_MISSING": 30,
    "MATH_DENOMINATOR_POLICY_REFUSED": 30,
    "MATH_COMPUTE_BASIS_MISSING": 30,
    "MATH_INPUT_NOT_NUMERIC": 40,
    "MATH_INPUT_UNEXPECTED_UNIT": 40,
    "MATH_INPUT_NON_FINITE": 40,
    "MATH_INPUT_UNEXPECTED_NEGATIVE": 40,
    "MATH_FORMULA_INPUTS_MISSING": 50,
    "MATH_FORMULA_INPUT_NON_FINITE": 50,
    "MATH_FORMULA_DENOMINATOR_ZERO": 50,
    "MATH_FORMULA_DENOMINATOR_NEAR_ZERO": 50,
    "MATH_FORMULA_DIVISION_ERROR": 50,
    "COMPARATIVE_MISSING_OPENING_BALANCE": 60,
    "COMPARATIVE_MISSING_CLOSING_BALANCE": 60,
    "COMPARATIVE_INCOMPATIBLE_OPENING_BASIS": 60,
    "COMPARATIVE_INCOMPATIBLE_CLOSING_BASIS": 60,
    "COMPARATIVE_FORBIDDEN_APPROXIMATION": 60,
    "PERIOD_UNSUPPORTED_PERIOD_CLASS": 70,
    "PERIOD_DUPLICATE_PERIOD_ID": 70,
    "MATH_COVERAGE_INTENTIONALLY_SUPPRESSED": 90,
}
