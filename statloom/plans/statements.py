"""Queries over statement facts: inputs, ratios, periods, scores; each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import dims, numbers
from statloom.operators import periods, ratios, scoring
from statloom.sources.facts import FACTS_DUCK, statement_facts, statement_inputs

#: Half-even rounding on the shortest decimal form, in exact decimals.
HALF_EVEN = "(SELECT CAST(sign(d) * CASE WHEN (abs(d) * {m}) % 1 = 0.5 AND floor(abs(d) * {m}) % 2 = 0 THEN floor(abs(d) * {m}) ELSE floor(abs(d) * {m} + 0.5) END AS DOUBLE) / {m} FROM (SELECT CAST(CAST({x} AS VARCHAR) AS DECIMAL(30,12)) AS d))"
KEYS = ["entity_id", "period_label"]
QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


WITH_FACTS = f"WITH facts AS ({FACTS_DUCK})"
UNPIVOT = " UNION ALL ".join(f"SELECT entity_id, fy, cls, period_label, '{k}' AS metric_key, {k} AS value FROM facts" for k in dims.FACTS)
WITH_INPUTS = f"""{WITH_FACTS}, inputs AS (SELECT *, CASE WHEN metric_key <> 'accounts_receivable' THEN CAST(round(0.50 + (entity_id % 6) * 0.08, 2) AS DOUBLE) END AS confidence,
 CASE WHEN (entity_id + fy) % 23 = 0 THEN 'kg' ELSE 'currency' END AS unit FROM ({UNPIVOT}))"""
NON_NEGATIVE = ", ".join(f"'{k}'" for k in dims.NON_NEGATIVE)
REASON = f"CASE WHEN unit <> 'currency' THEN 'MATH_INPUT_UNEXPECTED_UNIT' WHEN value < 0 AND metric_key IN ({NON_NEGATIVE}) THEN 'MATH_INPUT_UNEXPECTED_NEGATIVE' END"


@query(f"{WITH_FACTS} SELECT * FROM facts")
def s1_statement_facts(spark, sf):
    return statement_facts(spark, sf)


@query(f"{WITH_INPUTS} SELECT * FROM inputs")
def a0_statement_inputs(spark, sf):
    return statement_inputs(statement_facts(spark, sf))


@query(f"{WITH_INPUTS}, r AS (SELECT *, {REASON} AS reason FROM inputs) SELECT entity_id, period_label, metric_key, CASE WHEN reason IS NULL THEN value END AS value, coalesce(reason, '') AS reasons FROM r")
def a1_validate_inputs(spark, sf):
    out = ratios.validate_inputs(statement_inputs(statement_facts(spark, sf)))
    return out.select(*KEYS, "metric_key", "value", F.array_join("reason_codes", ",").alias("reasons"))


@query(f"{WITH_INPUTS}, r AS (SELECT *, {REASON} AS reason FROM inputs) SELECT metric_key, CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN value IS NULL THEN 'missing' ELSE 'ready' END AS state, count(*) AS n FROM r GROUP BY 1, 2")
def a2_candidate_states(spark, sf):
    out = ratios.candidates(ratios.validate_inputs(statement_inputs(statement_facts(spark, sf))))
    return out.groupBy("metric_key", "state").agg(F.count("*").alias("n"))


@query(f"{WITH_FACTS} SELECT entity_id, period_label, metric_key, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' ELSE 'ready' END AS state, a + b AS value FROM (SELECT *, liabilities AS a, short_term_liabilities AS b FROM facts), (VALUES ('debt_total'), ('debt_only')) AS v(metric_key)")
def a3_total_debt(spark, sf):
    """Debt from its two parts, missing if one is, for both leverage families."""
    a, b = F.col("liabilities"), F.col("short_term_liabilities")
    out = statement_facts(spark, sf).select(*KEYS, F.explode(F.array(F.lit("debt_total"), F.lit("debt_only"))).alias("metric_key"), (a + b).alias("value"))
    return out.withColumn("state", F.when(F.col("value").isNull(), "missing").otherwise("ready"))


CANDIDATES = f"""{WITH_FACTS}, c AS (SELECT entity_id, cls, 'liabilities' AS metric_key, 'reported' AS kind, fy, liabilities AS value, CASE WHEN fy % 3 = 0 THEN 'missing' ELSE 'ready' END AS state FROM facts
 UNION ALL SELECT entity_id, cls, 'liabilities', 'derived', fy, total_assets - equity, 'ready' FROM facts WHERE fy % 2 = 0 UNION ALL SELECT entity_id, cls, 'liabilities', 'synthetic', fy, total_assets, 'ready' FROM facts WHERE fy % 5 = 0
 UNION ALL SELECT entity_id, cls, 'liabilities', 'derived', fy, total_assets, 'ready' FROM facts WHERE entity_id % 7 = 0)"""


@query(f"""{CANDIDATES}, g AS (SELECT *, CASE kind WHEN 'reported' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END AS r FROM c),
b AS (SELECT *, min(CASE WHEN state = 'ready' THEN r END) OVER (PARTITION BY entity_id, cls, fy) AS best FROM g),
n AS (SELECT entity_id, cls, fy, max(best) AS best, count(*) FILTER (state = 'ready' AND r = best) AS n, max(value) FILTER (state = 'ready' AND r = best) AS v, max(kind) FILTER (state = 'ready' AND r = best) AS k FROM b GROUP BY 1, 2, 3)
SELECT entity_id, cls, fy, CASE WHEN best IS NULL THEN 'no_candidate' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome, CASE WHEN n = 1 THEN k END AS kind, CASE WHEN n = 1 THEN v END AS value FROM n""")
def a8_precedence(spark, sf):
    facts = statement_facts(spark, sf)
    row = lambda df, kind, value, state="ready": df.select("entity_id", "cls", "fy", F.lit(kind).alias("kind"), value.alias("value"), (F.lit(state) if isinstance(state, str) else state).alias("state"))
    both = row(facts, "reported", F.col("liabilities"), F.when(F.col("fy") % 3 == 0, "missing").otherwise("ready"))
    both = both.union(row(facts.where("fy % 2 = 0"), "derived", F.col("total_assets") - F.col("equity"))).union(row(facts.where("fy % 5 = 0"), "synthetic", F.col("total_assets")))
    both = both.union(row(facts.where("entity_id % 7 = 0"), "derived", F.col("total_assets")))
    return ratios.precedence(both, ["entity_id", "cls", "fy"])


CLASS = "CASE WHEN {0} IS NULL THEN 'missing' WHEN {0} = 0 THEN 'zero' WHEN abs({0}) < 1e-9 THEN 'near_zero' WHEN {0} < 0 THEN 'negative' ELSE 'positive' END"


@query(f"{WITH_FACTS} SELECT entity_id, period_label, {CLASS.format('short_term_liabilities')} AS st_class, {CLASS.format('revenue')} AS revenue_class FROM facts")
def a14_denominator_class(spark, sf):
    return statement_facts(spark, sf).select(*KEYS, ratios.denominator_class(F.col("short_term_liabilities")).alias("st_class"), ratios.denominator_class(F.col("revenue")).alias("revenue_class"))


@query(f"""{WITH_FACTS}, k AS (SELECT *, {CLASS.format('short_term_liabilities')} AS c FROM facts)
SELECT entity_id, period_label, CASE WHEN c = 'missing' THEN 'MATH_DENOMINATOR_INPUT_MISSING' WHEN c <> 'positive' THEN 'MATH_DENOMINATOR_POLICY_REFUSED' END AS strict, CASE WHEN c = 'missing' THEN 'MATH_DENOMINATOR_INPUT_MISSING' WHEN c NOT IN ('positive', 'negative') THEN 'MATH_DENOMINATOR_POLICY_REFUSED' END AS any_non_zero FROM k""")
def a15_denominator_policy(spark, sf):
    x = F.col("short_term_liabilities")
    return statement_facts(spark, sf).select(*KEYS, ratios.denominator_reason(x).alias("strict"), ratios.denominator_reason(x, "any_non_zero").alias("any_non_zero"))


@query(f"{WITH_INPUTS} SELECT entity_id, period_label, count(DISTINCT unit) > 1 AS mixed, min(unit) AS unit FROM inputs GROUP BY 1, 2")
def a16_unit_compatibility(spark, sf):
    units = F.collect_set("unit")
    return statement_inputs(statement_facts(spark, sf)).groupBy(*KEYS).agg((F.size(units) > 1).alias("mixed"), F.min("unit").alias("unit"))


@query(f"""{WITH_FACTS} SELECT entity_id, period_label, CASE WHEN net_profit IS NOT NULL AND short_term_liabilities IS NOT NULL AND abs(short_term_liabilities) >= 1e-9 THEN net_profit / nullif(short_term_liabilities, 0) END AS value,
CASE WHEN net_profit IS NULL OR short_term_liabilities IS NULL THEN 'MATH_FORMULA_INPUTS_MISSING' WHEN short_term_liabilities = 0 THEN 'MATH_FORMULA_DENOMINATOR_ZERO' WHEN abs(short_term_liabilities) < 1e-9 THEN 'MATH_FORMULA_DENOMINATOR_NEAR_ZERO' END AS guard FROM facts""")
def a17_guarded_ratio(spark, sf):
    value, guard = ratios.guarded_ratio(F.col("net_profit"), F.col("short_term_liabilities"))
    return statement_facts(spark, sf).select(*KEYS, value.alias("value"), guard.alias("guard"))


def simple_sql(metric, num, den):
    negative = " OR ".join([f"{k} < 0" for k in (num, den) if k in dims.NON_NEGATIVE] or ["false"])
    return f"""SELECT entity_id, period_label, '{metric}' AS metric_id, {num} AS n, {den} AS d, CASE WHEN {negative} THEN 'MATH_INPUT_UNEXPECTED_NEGATIVE' WHEN {num} IS NULL AND {den} IS NULL THEN 'MATH_REQUIRED_INPUT_MISSING,MATH_DENOMINATOR_INPUT_MISSING'
 WHEN {den} IS NULL THEN 'MATH_DENOMINATOR_INPUT_MISSING' WHEN {num} IS NULL AND {den} < 1e-9 THEN 'MATH_REQUIRED_INPUT_MISSING,MATH_DENOMINATOR_POLICY_REFUSED' WHEN {den} < 1e-9 THEN 'MATH_DENOMINATOR_POLICY_REFUSED' WHEN {num} IS NULL THEN 'MATH_REQUIRED_INPUT_MISSING' ELSE '' END AS reasons FROM linked"""


def average_sql(metric, num, base):
    mean = f"(opening_{base} + {base}) / 2"
    negative = f"{mean} < 0" + (f" OR {num} < 0" if num in dims.NON_NEGATIVE else "")
    return f"""SELECT entity_id, period_label, '{metric}' AS metric_id, {num} AS n, {mean} AS d, CASE WHEN opening_{base} IS NULL THEN 'COMPARATIVE_FORBIDDEN_APPROXIMATION,COMPARATIVE_MISSING_OPENING_BALANCE' WHEN {base} IS NULL THEN 'COMPARATIVE_MISSING_CLOSING_BALANCE'
 WHEN {negative} THEN 'MATH_INPUT_UNEXPECTED_NEGATIVE' WHEN {num} IS NULL AND {mean} < 1e-9 THEN 'MATH_REQUIRED_INPUT_MISSING,MATH_DENOMINATOR_POLICY_REFUSED' WHEN {mean} < 1e-9 THEN 'MATH_DENOMINATOR_POLICY_REFUSED' WHEN {num} IS NULL THEN 'MATH_REQUIRED_INPUT_MISSING' ELSE '' END AS reasons FROM linked"""


ALONE = f"{WITH_FACTS}, linked AS (SELECT *, CAST(NULL AS DOUBLE) AS opening_total_assets, CAST(NULL AS DOUBLE) AS opening_equity FROM facts)"
LINKED = f"""{WITH_FACTS}, linked AS (SELECT f.*, p.entity_id IS NOT NULL AS has_prior, o.entity_id IS NOT NULL AS has_opening, o.total_assets AS opening_total_assets, o.equity AS opening_equity, o.currency AS opening_currency
 FROM facts f LEFT JOIN facts p ON p.entity_id = f.entity_id AND p.cls = f.cls AND p.fy = f.fy - 1 LEFT JOIN facts o ON o.entity_id = f.entity_id AND o.cls = 'FY' AND o.fy = f.fy - 1)"""
SUPPRESSED = " UNION ALL ".join(f"SELECT entity_id, period_label, '{m}' AS metric_id, CAST(NULL AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS d, 'MATH_COVERAGE_INTENTIONALLY_SUPPRESSED' AS reasons FROM linked" for m in dims.SUPPRESSED)
RATIO_ROWS = "raw AS (" + " UNION ALL ".join([simple_sql(*r) for r in dims.RATIOS] + [average_sql(*r) for r in dims.AVERAGE_RATIOS] + [SUPPRESSED]) + """),
ratios AS (SELECT entity_id, period_label, metric_id, CASE WHEN reasons = '' THEN round_even(n / nullif(d, 0), 4) END AS value, CASE WHEN reasons = '' THEN 'valid' WHEN reasons LIKE 'MATH_COVERAGE%' THEN 'suppressed' ELSE 'invalid' END AS validity, nullif(split_part(reasons, ',', 1), '') AS reason, reasons FROM raw)"""


def all_ratios(spark, sf, compare):
    facts = statement_facts(spark, sf)
    return ratios.all_ratios(periods.linked(periods.parsed(facts)) if compare else facts, KEYS)


@query(f"{ALONE}, {RATIO_ROWS} SELECT * FROM ratios WHERE metric_id IN ('current_ratio', 'absolute_liquidity_ratio', 'ros', 'equity_ratio')")
def a18_ratios(spark, sf):
    out = all_ratios(spark, sf, False).where(F.col("metric_id").isin([r[0] for r in dims.RATIOS]))
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(f"{LINKED}, {RATIO_ROWS} SELECT * FROM ratios WHERE metric_id IN ('roa', 'roe', 'asset_turnover')")
def a19_average_ratios(spark, sf):
    out = all_ratios(spark, sf, True).where(F.col("metric_id").isin([r[0] for r in dims.AVERAGE_RATIOS]))
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(f"{LINKED}, {RATIO_ROWS} SELECT metric_id, validity, reason, count(*) AS n FROM ratios GROUP BY ALL")
def a25_engine_outcomes(spark, sf):
    """All 15 ratios through all gates, counted by outcome; suppressed ones are among them."""
    return all_ratios(spark, sf, True).groupBy("metric_id", "validity", "reason").agg(F.count("*").alias("n"))


@query(f"{WITH_INPUTS}, w AS (SELECT entity_id, period_label, max(confidence) FILTER (metric_key = 'current_assets') AS a, max(confidence) FILTER (metric_key = 'accounts_receivable') AS b FROM inputs GROUP BY 1, 2) SELECT entity_id, period_label, CASE WHEN a IS NULL OR b IS NULL THEN round(least(a, b) * CAST(0.9 AS DOUBLE), 4) ELSE least(a, b) END AS confidence FROM w")
def a22_ratio_confidence(spark, sf):
    known = statement_inputs(statement_facts(spark, sf)).where(F.col("metric_key").isin("current_assets", "accounts_receivable"))
    both = known.groupBy(*KEYS).pivot("metric_key", ["current_assets", "accounts_receivable"]).agg(F.max("confidence"))
    return both.select(*KEYS, ratios.confidence(F.col("current_assets"), F.col("accounts_receivable")).alias("confidence"))


@query(f"{ALONE}, {RATIO_ROWS} SELECT entity_id, period_label, reasons FROM ratios WHERE validity = 'invalid'")
def a23_reason_resolution(spark, sf):
    return all_ratios(spark, sf, False).where("validity = 'invalid'").select(*KEYS, F.array_join("reasons", ",").alias("reasons"))


WIDE_NAMES = [r[0] for r in dims.RATIOS + dims.AVERAGE_RATIOS] + dims.SUPPRESSED
WIDE_SQL = "wide AS (SELECT entity_id, period_label, " + ", ".join(f"max(value) FILTER (metric_id = '{m}') AS {m}" for m in WIDE_NAMES) + " FROM ratios GROUP BY 1, 2)"


@query(f"{LINKED}, {RATIO_ROWS}, {WIDE_SQL} SELECT * FROM wide")
def a28_wide_ratios(spark, sf):
    return ratios.wide(all_ratios(spark, sf, True), KEYS)


LABELS = "SELECT DISTINCT CASE entity_id % 4 WHEN 0 THEN lower(period_label) WHEN 1 THEN ' ' || period_label ELSE period_label END AS label FROM facts UNION SELECT DISTINCT '9M/' || fy FROM facts UNION SELECT DISTINCT 'q4/' || fy FROM facts"
KIND = "CASE WHEN regexp_full_match(t, 'Q[1-4]/[0-9]{4}') OR regexp_full_match(t, 'H1/[0-9]{4}') THEN split_part(t, '/', 1) WHEN regexp_full_match(t, '[0-9]{4}') THEN 'FY' END"


def some_labels(spark, sf):
    facts = statement_facts(spark, sf)
    e = F.col("entity_id") % 4
    label = F.when(e == 0, F.lower("period_label")).when(e == 1, F.concat(F.lit(" "), "period_label")).otherwise(F.col("period_label"))
    odd = facts.select(F.explode(F.array(F.concat(F.lit("9M/"), "fy"), F.concat(F.lit("q4/"), "fy"))).alias("label"))
    return facts.select(label.alias("label")).union(odd).distinct()


@query(f"{WITH_FACTS}, l AS ({LABELS}), t AS (SELECT label, upper(trim(label)) AS t FROM l), k AS (SELECT *, {KIND} AS period_class FROM t) SELECT label, period_class, CAST(CASE WHEN period_class IS NOT NULL THEN right(t, 4) END AS INT) AS fiscal_year, CASE WHEN period_class IS NOT NULL THEN period_class || '/' || right(t, 4) END AS period_id, CASE period_class WHEN 'FY' THEN make_date(CAST(right(t, 4) AS INT), 12, 31) WHEN 'Q1' THEN make_date(CAST(right(t, 4) AS INT), 3, 31) WHEN 'Q4' THEN make_date(CAST(right(t, 4) AS INT), 12, 31) WHEN 'H1' THEN make_date(CAST(right(t, 4) AS INT), 6, 30) END AS period_end FROM k")
def p1_parse_label(spark, sf):
    return periods.parsed(some_labels(spark, sf), "label")


@query(f"{WITH_FACTS}, l AS ({LABELS}), t AS (SELECT label, upper(trim(label)) AS t FROM l), k AS (SELECT *, {KIND} AS c FROM t), o AS (SELECT label, CASE WHEN c IS NULL THEN 9999 ELSE CAST(right(t, 4) AS INT) END AS sort_year, CASE c WHEN 'Q1' THEN 1 WHEN 'Q2' THEN 2 WHEN 'H1' THEN 3 WHEN 'Q3' THEN 4 WHEN 'Q4' THEN 6 WHEN 'FY' THEN 7 ELSE 99 END AS sort_class FROM k) SELECT * FROM o")
def p2_chronological_key(spark, sf):
    out = periods.parsed(some_labels(spark, sf), "label")
    return out.select("label", *periods.sort_key(F.col("period_class"), F.col("fiscal_year"))).orderBy("sort_year", "sort_class", "label")


@query(f"{WITH_FACTS}, d AS (SELECT entity_id, fy, cls FROM facts UNION ALL SELECT entity_id, fy, cls FROM facts WHERE (entity_id + fy) % 9 = 0) SELECT entity_id, cls || '/' || fy AS period_id, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) > 1")
def p3_duplicate_periods(spark, sf):
    facts = statement_facts(spark, sf)
    twice = facts.union(facts.where("(entity_id + fy) % 9 = 0"))
    found = periods.linked(periods.parsed(twice)).where("is_duplicate")
    return found.groupBy("entity_id", "period_id").agg(F.count("*").alias("n"))


@query(f"{LINKED} SELECT entity_id, period_label, has_prior, has_opening, opening_total_assets, opening_equity FROM linked")
def p4_p5_links(spark, sf):
    return periods.linked(periods.parsed(statement_facts(spark, sf))).select(*KEYS, "has_prior", "has_opening", "opening_total_assets", "opening_equity")


STATE = "CASE WHEN has_prior AND has_opening THEN 'comparable' WHEN has_opening THEN 'partially_comparable' ELSE 'not_comparable' END"


@query(f"{LINKED} SELECT entity_id, period_label, {STATE} AS state, concat_ws(',', CASE WHEN NOT has_prior THEN 'missing_prior_period' END, CASE WHEN NOT has_opening THEN 'missing_opening_balance' END, CASE WHEN has_opening AND NOT has_prior THEN 'partially_comparable_context' END, CASE WHEN has_opening AND currency <> opening_currency THEN 'inconsistent_currency' END) AS flags FROM linked")
def p6_p7_comparability(spark, sf):
    return periods.linked(periods.parsed(statement_facts(spark, sf))).select(*KEYS, "state", F.array_join("flags", ",").alias("flags"))


@query(f"{LINKED}, a AS (SELECT *, has_opening AND currency = opening_currency AS fits FROM linked) SELECT entity_id, period_label, CASE WHEN fits THEN round_even((opening_total_assets + total_assets) / 2, 4) END AS average_total_assets, CASE WHEN fits THEN round_even((opening_equity + equity) / 2, 4) END AS average_equity FROM a")
def p8_average_balance(spark, sf):
    return periods.averaged(periods.linked(periods.parsed(statement_facts(spark, sf)))).select(*KEYS, "average_total_assets", "average_equity")


@query(f"{LINKED}, {RATIO_ROWS} SELECT DISTINCT entity_id, metric_id FROM ratios WHERE value IS NOT NULL")
def p11_ratio_keys(spark, sf):
    return all_ratios(spark, sf, True).where(F.col("value").isNotNull()).select("entity_id", "metric_id").distinct()


@query(f"{LINKED}, {RATIO_ROWS} SELECT metric_id, " + ", ".join(f"max(value) FILTER (entity_id = 3 AND period_label = '{y}') AS y{y}" for y in range(1995, 2002)) + " FROM ratios GROUP BY metric_id")
def p12_period_matrix(spark, sf):
    one = F.when(F.col("entity_id") == 3, F.col("value"))
    out = all_ratios(spark, sf, True).groupBy("metric_id").pivot("period_label", [str(y) for y in range(1995, 2002)]).agg(F.max(one))
    return out.select("metric_id", *[F.col(str(y)).alias(f"y{y}") for y in range(1995, 2002)])


@query(f"""{LINKED}, {RATIO_ROWS}, s AS (SELECT r.*, f.fy, CASE f.cls WHEN 'Q1' THEN 1 WHEN 'H1' THEN 3 ELSE 7 END AS c FROM ratios r JOIN facts f ON f.entity_id = r.entity_id AND f.period_label = r.period_label WHERE value IS NOT NULL),
o AS (SELECT *, lag(value) OVER (PARTITION BY entity_id, metric_id ORDER BY fy, c) AS previous, row_number() OVER (PARTITION BY entity_id, metric_id ORDER BY fy DESC, c DESC) AS rn FROM s)
SELECT entity_id, metric_id, previous, value AS latest, CASE WHEN previous IS NULL THEN 'none' WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'flat' END AS direction, coalesce(abs(value - previous) > 0.5, false) AS is_anomaly FROM o WHERE rn = 1""")
def p13_p14_trends(spark, sf):
    rows = periods.parsed(all_ratios(spark, sf, True))
    return periods.trends(rows.select("*", *periods.sort_key(F.col("period_class"), F.col("fiscal_year"))), 0.5)


def score_sql(profile="generic"):
    each = []
    for name, weight, generic, retail, higher, least, most in dims.SCORING:
        t = generic if profile == "generic" else retail
        s = f"CASE WHEN {name} <= 0 THEN 0.0 ELSE least({name} / {t}, 1.0) END" if higher else f"CASE WHEN {name} <= 0 THEN NULL WHEN {name} >= {2 * t} THEN 0.0 ELSE 1 - {name} / {2 * t} END"
        ok = f"{name} IS NOT NULL" + ("" if least is None else f" AND {name} BETWEEN {least} AND {most}")
        each.append((name, weight, f"CASE WHEN {ok} THEN {s} END"))
    return each


SCORES = "norm AS (SELECT *, " + ", ".join(f"CAST({s} AS DOUBLE) AS s_{n}" for n, _, s in score_sql()) + " FROM wide), tot AS (SELECT *, " + " + ".join(f"coalesce(s_{n} * CAST({w} AS DOUBLE), 0.0)" for n, w, _ in score_sql()) + " AS t, " + " + ".join(f"CASE WHEN s_{n} IS NOT NULL THEN CAST({w} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END" for n, w, _ in score_sql()) + " AS w FROM norm), sc AS (SELECT *, CASE WHEN w > 0 THEN t / w * 100 ELSE 0.0 END AS raw_score, round(CASE WHEN w > 0 THEN t / w * 100 ELSE 0.0 END, 2) AS score, round(w, 2) AS confidence_score FROM tot)"
WIDE_SCORING = WIDE_SQL
RISK = "CASE WHEN {0} >= 75 THEN 'low' WHEN {0} >= 55 THEN 'medium' WHEN {0} >= 35 THEN 'high' ELSE 'critical' END"
SCORED = f"{LINKED}, {RATIO_ROWS}, {WIDE_SCORING}, {SCORES}"


def scores(spark, sf):
    return scoring.scored(ratios.wide(all_ratios(spark, sf, True), KEYS))


@query(f"{SCORED} SELECT entity_id, period_label, score, confidence_score, {RISK.format('raw_score')} AS risk_level FROM sc")
def k2_k3_scores(spark, sf):
    return scores(spark, sf).select(*KEYS, "score", "confidence_score", "risk_level")


@query(f"""{SCORED}, j AS (SELECT sc.*, f.revenue, f.total_assets, f.liabilities, f.current_assets, f.short_term_liabilities, f.net_profit, f.equity, {RISK.format('raw_score')} AS risk FROM sc JOIN facts f ON f.entity_id = sc.entity_id AND f.period_label = sc.period_label),
m AS (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {k} IS NULL THEN 'missing_core:{k}' END" for k in dims.CORE)}) AS core, concat_ws(',', {", ".join(f"CASE WHEN {k} IS NULL THEN 'missing_supporting:{k}' END" for k in dims.SUPPORTING)}) AS supp FROM j),
c AS (SELECT *, CASE WHEN core <> '' THEN 39.99 WHEN supp <> '' THEN 54.99 WHEN confidence_score < 0.4 THEN 59.99 END AS cap, CASE WHEN core <> '' THEN core WHEN supp <> '' THEN supp ELSE 'low_confidence' END AS why FROM m)
SELECT entity_id, period_label, CAST(CASE WHEN score > cap THEN cap ELSE score END AS DOUBLE) AS score, CASE WHEN score > cap THEN {RISK.format('cap')} ELSE risk END AS risk_level, CASE WHEN score > cap THEN why ELSE '' END AS guardrails FROM c""")
def k11_capped_scores(spark, sf):
    facts = statement_facts(spark, sf).select(*KEYS, *dims.CORE, *dims.SUPPORTING)
    out = scoring.capped(scores(spark, sf).join(facts, KEYS))
    return out.select(*KEYS, F.col("capped_score").alias("score"), F.col("capped_risk").alias("risk_level"), F.array_join("guardrails", ",").alias("guardrails"))


@query(f"{SCORED}, f AS (" + " UNION ALL ".join(f"SELECT entity_id, period_label, '{n}' AS ratio, {HALF_EVEN.replace('DECIMAL(30,12)', 'DECIMAL(22,18)').format(x='s_' + n, m=10000)} AS normalised FROM sc" for n, _, _ in score_sql()) + ") SELECT *, CASE WHEN normalised >= 0.65 THEN 'positive' WHEN normalised >= 0.35 THEN 'neutral' ELSE 'negative' END AS impact FROM f WHERE normalised IS NOT NULL")
def k1_k12_factors(spark, sf):
    return scoring.factors(ratios.wide(all_ratios(spark, sf, True), KEYS), KEYS)


@query(f"{SCORED} SELECT entity_id, right(period_label, 4) AS fy, count(*) AS n, count(*) FILTER (score < 35) AS n_critical, max(score) AS best, grouping(entity_id) * 2 + grouping(right(period_label, 4)) AS level FROM sc GROUP BY CUBE (entity_id, right(period_label, 4))")
def k15_score_cube(spark, sf):
    out = scores(spark, sf).withColumn("fy", F.right("period_label", F.lit(4)))
    return out.cube("entity_id", "fy").agg(F.count("*").alias("n"), F.count_if(F.col("score") < 35).alias("n_critical"), F.max("score").alias("best"), F.grouping_id().alias("level"))


BASIS = "CASE WHEN revenue IS NULL THEN 'reported' WHEN cls = 'Q1' THEN 'annualized_q1' WHEN cls = 'H1' THEN 'annualized_h1' ELSE 'reported' END"


@query(f"{WITH_FACTS}, b AS (SELECT *, {BASIS} AS period_basis FROM facts) SELECT entity_id, period_label, period_basis, " + ", ".join(f"{k} * CASE period_basis WHEN 'annualized_q1' THEN 4.0 WHEN 'annualized_h1' THEN 2.0 ELSE 1.0 END AS {k}" for k in ("revenue", "net_profit", "interest_expense", "cost_of_goods_sold")) + " FROM b")
def k6_k7_annualised(spark, sf):
    facts = statement_facts(spark, sf)
    facts = facts.withColumn("period_basis", scoring.period_basis(F.col("period_label"), F.col("revenue")))
    return scoring.annualised(facts).select(*KEYS, "period_basis", "revenue", "net_profit", "interest_expense", "cost_of_goods_sold")


@query(f"{LINKED}, {RATIO_ROWS}, {WIDE_SQL} SELECT w.entity_id, w.period_label, CASE WHEN w.entity_id % 5 = 0 OR asset_turnover >= 1.2 THEN 'retail_demo' ELSE 'generic' END AS profile FROM wide w")
def k5_profile(spark, sf):
    wide = ratios.wide(all_ratios(spark, sf, True), KEYS)
    name = F.when(F.col("entity_id") % 5 == 0, "Retail chain").otherwise("Works")
    return wide.select(*KEYS, scoring.profile_of(name, F.lit(1.0), F.col("asset_turnover"), F.col("receivables_turnover")).alias("profile"))


@query(f"{WITH_FACTS} SELECT entity_id, period_label, {HALF_EVEN.format(x='revenue / nullif(total_assets, 0)', m=10000)} AS c4, {HALF_EVEN.format(x='net_profit / 7', m=100)} AS c2 FROM facts")
def n9_canonical(spark, sf):
    f = statement_facts(spark, sf)
    return f.select(*KEYS, numbers.canonical(F.col("revenue") / F.col("total_assets")).alias("c4"), numbers.canonical(F.col("net_profit") / 7, 2).alias("c2"))


@query(f"{WITH_FACTS} SELECT entity_id, period_label, abs(current_assets - accounts_receivable) > greatest(1000.0, 0.01 * greatest(abs(current_assets), abs(accounts_receivable))) AS differs FROM facts")
def n7_material_difference(spark, sf):
    return statement_facts(spark, sf).select(*KEYS, numbers.materially_differs("current_assets", "accounts_receivable").alias("differs"))


@query(f"{WITH_INPUTS} SELECT entity_id, period_label, metric_key, CASE WHEN value IS NULL THEN NULL WHEN value = 0 THEN 'X' ELSE CASE WHEN value < 0 THEN '-' ELSE '' END || regexp_replace(format('{{:,}}', CAST(round_even(abs(value), 0) AS BIGINT)), '[0-9]', 'X', 'g') END AS masked FROM inputs")
def n8_masked(spark, sf):
    return statement_inputs(statement_facts(spark, sf)).select(*KEYS, "metric_key", numbers.masked("value").alias("masked"))


@query("SELECT o_orderkey, NOT (o_totalprice = floor(o_totalprice) AND o_totalprice BETWEEN 1900 AND 2100) AND abs(o_totalprice) <= 1e13 AND o_totalprice <> 0 AND o_orderkey % 1000 NOT BETWEEN 1900 AND 2100 AS ok, (o_orderkey % 3000 <> 0) AND NOT (o_orderkey % 3000 BETWEEN 1900 AND 2100) AS ok_key FROM orders")
def n3_valid_value(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", numbers.valid_value("o_totalprice").alias("ok"), numbers.valid_value((F.col("o_orderkey") % 3000).cast("double")).alias("ok_key"))
