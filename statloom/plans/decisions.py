"""Queries over decisions: metadata, engine inputs, methodology, merging, landing files; each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import dims
from statloom.operators import decisions as d
from statloom.plans.statements import KEYS, WITH_FACTS
from statloom.sources.facts import read, statement_facts

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def pick(values: list, by: str):
    """One of the values by a number that SQL gives; the same for Spark and DuckDB."""
    return "CASE " + " ".join(f"WHEN ({by}) % {len(values)} = {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


# --- metadata -------------------------------------------------------------------------------------------------------

OLD_SOURCE = pick([*d.V1_SOURCES, "scan", "derived_strong"], "entity_id + fy")


def v1_case(i: int) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return "CASE source " + " ".join(f"WHEN '{k}' THEN {lit(v[i])}" for k, v in d.V1_SOURCES.items()) + f" ELSE {lit(d.V1_OTHER[i])} END"


@query(f"{WITH_FACTS}, m AS (SELECT entity_id, period_label, {OLD_SOURCE} AS source FROM facts) SELECT entity_id, period_label, {v1_case(0)} AS new_source, {v1_case(1)} AS match, {v1_case(2)} AS mode, {v1_case(3)} AS reason, {v1_case(4)} AS override FROM m")
def r9_normalised_metadata(spark, sf):
    out = statement_facts(spark, sf).select(*KEYS, d.normalised_v1(F.expr(OLD_SOURCE)).alias("x"))
    return out.select(*KEYS, F.col("x.source").alias("new_source"), "x.match", "x.mode", "x.reason", "x.override")


MATCH_TYPE = pick(["table", "text_regex", "derived", "derived_strong", "other"], "entity_id + fy")


@query(f"{WITH_FACTS} SELECT entity_id, period_label, CASE {MATCH_TYPE} WHEN 'table' THEN CASE WHEN entity_id % 2 = 0 THEN 'table/exact/direct' ELSE 'table/keyword_match/direct' END WHEN 'text_regex' THEN 'text/keyword_match/direct' ELSE 'derived/not_applicable/derived' END AS profile FROM facts")
def r4_legacy_profile(spark, sf):
    return statement_facts(spark, sf).select(*KEYS, d.legacy_profile(F.expr(MATCH_TYPE), F.col("entity_id") % 2 == 0).alias("profile"))


META = {
    "version": pick(["v2", "v2", "v1"], "entity_id"), "source": pick(["table", "issuer_fallback", "derived", "text", "derived"], "fy"), "match": pick(["exact", "not_applicable", "not_applicable", "keyword_match"], "entity_id + fy"),
    "mode": pick(["direct", "policy_override", "derived"], "fy + entity_id * 2"), "state": pick(["none", "guardrail_adjusted"], "entity_id + fy * 3"), "reason": pick([None, "issuer_repo_override", ""], "entity_id * 5 + fy"),
}
META_SELECT = ", ".join(f"{v} AS {k}" for k, v in META.items()) + ", (entity_id * 3 + fy) % 4 <> 0 AS override, (entity_id + fy) % 2 = 0 AS flagged"


@query(f"""{WITH_FACTS}, m AS (SELECT entity_id, period_label, {META_SELECT} FROM facts) SELECT entity_id, period_label, CASE WHEN mode = 'policy_override' AND source <> 'issuer_fallback' THEN 'override_source' WHEN mode = 'policy_override' AND match <> 'not_applicable' THEN 'override_match'
 WHEN mode = 'policy_override' AND NOT override THEN 'override_not_authoritative' WHEN mode = 'policy_override' AND coalesce(reason, '') = '' THEN 'override_reason' WHEN mode = 'derived' AND source <> 'derived' THEN 'derived_mode_source' WHEN source = 'derived' AND mode <> 'derived' THEN 'derived_source_mode'
 WHEN match = 'not_applicable' AND source NOT IN ('derived', 'issuer_fallback') AND version <> 'v1' THEN 'match_missing' WHEN state = 'guardrail_adjusted' AND coalesce(reason, '') = '' THEN 'guardrail_reason' WHEN state = 'guardrail_adjusted' AND NOT flagged THEN 'guardrail_flag'
 WHEN override AND mode <> 'policy_override' THEN 'authoritative_without_override' END AS violation FROM m""")
def r10_metadata_violations(spark, sf):
    meta = statement_facts(spark, sf).selectExpr(*KEYS, *[f"{v} AS {k}" for k, v in META.items()], "(entity_id * 3 + fy) % 4 <> 0 AS override", "CASE WHEN (entity_id + fy) % 2 = 0 THEN array('x', 'pp:guardrail_adjusted') ELSE array('ev:line_code') END AS flags")
    return meta.select(*KEYS, d.metadata_violation().alias("violation"))


SOME_REASONS = ["llm_extraction", "guardrail_equity_gt_total_assets", "legacy_text_regex_unresolved", "sanity_pnl_conflict_drop_revenue", None, "issuer_repo_override", "guardrail_component_gt_current_assets"]
ONE, TWO, THREE = (pick(SOME_REASONS, by) for by in ("entity_id", "fy", "entity_id + fy"))
PRIORITY_ROWS = ", ".join(f"('{k}', {v})" for k, v in d.REASON_PRIORITY.items())


@query(f"""{WITH_FACTS}, p AS (SELECT * FROM (VALUES {PRIORITY_ROWS}) AS v(reason, priority)), e AS (SELECT entity_id, period_label, 1 AS place, {ONE} AS reason FROM facts UNION ALL SELECT entity_id, period_label, 2, {TWO} FROM facts UNION ALL SELECT entity_id, period_label, 3, {THREE} FROM facts)
SELECT entity_id, period_label, arg_max(e.reason, p.priority * 10 - place) FILTER (p.priority IS NOT NULL) AS reason FROM e LEFT JOIN p ON p.reason = e.reason GROUP BY 1, 2""")
def r11_preferred_reason(spark, sf):
    return statement_facts(spark, sf).select(*KEYS, d.preferred_reason(F.array(F.expr(ONE), F.expr(TWO), F.expr(THREE))).alias("reason"))


BROKEN = {
    "current_assets": "CASE WHEN fy % 4 = 0 THEN total_assets * 1.5 ELSE current_assets END", "equity": "CASE WHEN entity_id % 7 = 0 THEN total_assets * 1.2 ELSE equity END", "short_term_liabilities": "CASE WHEN entity_id % 5 = 0 THEN liabilities * 1.1 WHEN entity_id % 5 = 1 THEN total_assets * 2.0 ELSE short_term_liabilities END",
    "inventory": "accounts_receivable * 0.5", "cash_and_equivalents": "CASE WHEN fy % 3 = 0 THEN total_assets * 2.0 ELSE cash_and_equivalents END", "liabilities": "CASE WHEN entity_id % 11 = 3 THEN total_assets * 1.1 ELSE liabilities END",
}
PARTS = ["current_assets", "liabilities", "equity", "short_term_liabilities", "cash_and_equivalents", "inventory", "accounts_receivable"]


def guardrail_sql() -> str:
    steps, columns = [], ["total_assets", *PARTS]
    plain = ", ".join(f"{BROKEN[c]} AS {c}" if c in BROKEN else c for c in columns)
    steps.append(f"g0 AS (SELECT entity_id, period_label, {plain}, '' AS events FROM facts)")
    for i, (part, whole, reason) in enumerate(d.GUARDRAILS):
        bad = f"coalesce({part} > {whole}, false)"
        kept = ", ".join(f"CASE WHEN NOT {bad} THEN {c} END AS {c}" if c == part else c for c in columns)
        steps.append(f"g{i + 1} AS (SELECT entity_id, period_label, {kept}, CASE WHEN {bad} THEN events || '{part}:{reason};' ELSE events END AS events FROM g{i})")
    return f"{WITH_FACTS}, {', '.join(steps)} SELECT entity_id, period_label, {', '.join(PARTS)}, events FROM g{len(d.GUARDRAILS)}"


@query(guardrail_sql())
def g2_result_guardrails(spark, sf):
    facts = statement_facts(spark, sf)
    broken = facts.select(*KEYS, "total_assets", *[F.expr(BROKEN[c]).alias(c) if c in BROKEN else F.col(c) for c in PARTS])
    events = F.array_join(F.transform("events", lambda e: F.concat(e["part"], F.lit(":"), e["reason"], F.lit(";"))), "")
    return d.guarded(broken).select(*KEYS, *PARTS, events.alias("events"))


LABELS = ["Итого оборотных активов", "Total current assets", "Other current assets", "Non-current assets", "Итого по разделу V", "Lease liabilities, current", "Total liabilities", "Total non-current liabilities", "Прочие обязательства", "Trade receivables", "Long-term receivables", "Дебиторская  задолженность", "Total comprehensive income", "Net profit and total comprehensive income", "Short-term borrowings", "Revenue"]
LABELLED = [*d.LABEL_RULES, "accounts_receivable", "net_profit", "revenue"]


def quality_case() -> str:
    """The quality of a label l for metric_key."""
    has = lambda words: "(" + (" OR ".join(f"contains(l, '{w}')" for w in words) or "false") + ")"
    rules = " ".join(f"WHEN '{m}' THEN CASE WHEN NOT {has(no)} AND {has(yes)} THEN {q} END" for m, (no, yes, q) in d.LABEL_RULES.items())
    owed = f"CASE WHEN {has(['долгосрочн', 'long-term', 'non-current'])} THEN NULL WHEN {has(['торговая и прочая дебиторская задолженность', 'trade receivables'])} THEN 88 WHEN {has(['дебиторск', 'receivable'])} THEN 70 END"
    profit = f"CASE WHEN contains(l, 'совокупный финансовый результат периода') AND NOT {has(['чистая прибыль', '2400'])} THEN NULL WHEN contains(l, 'total comprehensive income') AND NOT {has(['net profit', 'net income', '2400'])} THEN NULL ELSE 50 END"
    return f"CASE metric_key {rules} WHEN 'accounts_receivable' THEN {owed} WHEN 'net_profit' THEN {profit} ELSE 50 END"


def quality_sql() -> str:
    metrics, labels = (", ".join(f"('{x}')" for x in xs) for xs in (LABELLED, LABELS))
    return f"""{WITH_FACTS}, x AS (SELECT metric_key, label, trim(regexp_replace(lower(label || ' ' || coalesce(currency, '')), '\\s+', ' ', 'g')) AS l, n FROM (SELECT currency, count(*) AS n FROM facts GROUP BY 1), (VALUES {metrics}) AS m(metric_key), (VALUES {labels}) AS b(label))
SELECT metric_key, label, l AS text, n, {quality_case()} AS quality FROM x"""


@query(quality_sql())
def c9_label_quality(spark, sf):
    """Labels as statements print them, with their currency, for each metric that could claim them."""
    each = statement_facts(spark, sf).groupBy("currency").agg(F.count("*").alias("n"))
    each = each.select("currency", "n", F.explode(F.array(*map(F.lit, LABELLED))).alias("metric_key")).select("*", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    text = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "label", "currency")), r"\s+", " "))
    return each.select("metric_key", "label", text.alias("text"), "n", d.label_quality(F.col("metric_key"), text).alias("quality"))


# --- the engine's inputs --------------------------------------------------------------------------------------------

STATES = ["ready", "missing", "ready", None, "invalid", "ready"]
OPENING, CLOSING = pick(STATES, "fy"), pick(STATES, "entity_id")
SAME_UNIT = "(entity_id + fy) % 4 <> 0"


@query(f"""{WITH_FACTS}, s AS (SELECT entity_id, period_label, {OPENING} AS o, {CLOSING} AS c, {SAME_UNIT} AS same FROM facts) SELECT entity_id, period_label, CASE WHEN o IS NULL OR o = 'missing' THEN 'COMPARATIVE_MISSING_OPENING_BALANCE,COMPARATIVE_FORBIDDEN_APPROXIMATION' WHEN o <> 'ready' THEN 'COMPARATIVE_INCOMPATIBLE_OPENING_BASIS'
 WHEN c IS NULL OR c = 'missing' THEN 'COMPARATIVE_MISSING_CLOSING_BALANCE' WHEN c <> 'ready' THEN 'COMPARATIVE_INCOMPATIBLE_CLOSING_BASIS' WHEN NOT same THEN 'COMPARATIVE_INCOMPATIBLE_OPENING_BASIS' END AS reasons FROM s""")
def a11_average_eligibility(spark, sf):
    return statement_facts(spark, sf).select(*KEYS, d.average_eligibility(F.expr(OPENING), F.expr(CLOSING), F.expr(SAME_UNIT)).alias("reasons"))


COVERAGE = pick(["fully_supported", "reported_only", "derived_formula", "approximate_only", "intentionally_suppressed", "out_of_scope"], "entity_id + fy")
KIND = pick(["reported", "derived", None, "synthetic"], "entity_id")


@query(f"""{WITH_FACTS}, s AS (SELECT entity_id, period_label, {COVERAGE} AS c, {KIND} AS k, fy % 2 = 0 AS approx FROM facts), r AS (SELECT *, CASE c WHEN 'reported_only' THEN CASE WHEN k <> 'reported' THEN 'INVALID:MATH_COVERAGE_REPORTED_CANDIDATE_REQUIRED' END WHEN 'derived_formula' THEN CASE WHEN k = 'reported' THEN 'INVALID:MATH_COVERAGE_REPORTED_CANDIDATE_REQUIRED' END
 WHEN 'approximate_only' THEN CASE WHEN NOT approx THEN 'INVALID:MATH_COVERAGE_APPROXIMATION_SEMANTICS_REQUIRED' END WHEN 'intentionally_suppressed' THEN 'SUPPRESSED:MATH_COVERAGE_INTENTIONALLY_SUPPRESSED' WHEN 'out_of_scope' THEN 'NOT_APPLICABLE:MATH_COVERAGE_OUT_OF_SCOPE' END AS g FROM s)
SELECT entity_id, period_label, split_part(coalesce(g, 'VALID:'), ':', 1) AS validity, split_part(coalesce(g, 'VALID:'), ':', 2) AS reason FROM r""")
def a12_coverage_gate(spark, sf):
    gate = d.coverage_gate(F.expr(COVERAGE), F.expr(KIND), F.col("fy") % 2 == 0)
    return statement_facts(spark, sf).select(*KEYS, F.split(gate, ":")[0].alias("validity"), F.split(gate, ":")[1].alias("reason"))


FAMILY = f"""{WITH_FACTS}, f AS (SELECT entity_id, period_label, unnest(['financial_leverage', 'financial_leverage_total']) AS metric_key, liabilities, accounts_receivable AS lease, fy FROM facts),
c AS (SELECT entity_id, period_label, metric_key, 'liabilities_total' AS grp, liabilities AS value, 'ready' AS state FROM f WHERE fy % 5 <> 0 UNION ALL SELECT entity_id, period_label, metric_key, 'lease_liabilities', lease, CASE WHEN lease IS NULL THEN 'missing' ELSE 'ready' END FROM f WHERE fy % 3 <> 0)"""


def liability_families(spark, sf):
    """Candidates of the leverage families: total liabilities, and leases where the statement has them."""
    kinds = F.array(
        F.when(F.col("fy") % 5 != 0, F.struct(F.lit("liabilities_total").alias("grp"), F.col("liabilities").alias("value"), F.lit("ready").alias("state"))),
        F.when(F.col("fy") % 3 != 0, F.struct(F.lit("lease_liabilities").alias("grp"), F.col("accounts_receivable").alias("value"), F.when(F.col("accounts_receivable").isNull(), "missing").otherwise("ready").alias("state"))),
    )
    each = statement_facts(spark, sf).select(*KEYS, F.explode(F.array(F.lit("financial_leverage"), F.lit("financial_leverage_total"))).alias("metric_key"), F.array_compact(kinds).alias("c"))
    return each.select(*KEYS, "metric_key", F.explode("c").alias("x")).select(*KEYS, "metric_key", "x.grp", "x.value", "x.state")


@query(f"{FAMILY} SELECT * FROM c")
def a5_liability_families(spark, sf):
    return liability_families(spark, sf)


@query(f"{FAMILY} SELECT entity_id, period_label, metric_key, grp, row_number() OVER (PARTITION BY entity_id, period_label, metric_key ORDER BY grp) AS place FROM c")
def a7_candidate_set(spark, sf):
    """All candidates of a metric in their order."""
    ordered = liability_families(spark, sf).groupBy(*KEYS, "metric_key").agg(F.array_sort(F.collect_list("grp")).alias("g"))
    return ordered.select(*KEYS, "metric_key", F.posexplode("g").alias("place", "grp")).withColumn("place", F.col("place") + 1)


@query(f"{FAMILY}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, period_label, metric_key ORDER BY grp) AS place FROM c WHERE state = 'ready') SELECT entity_id, period_label, metric_key, grp, value FROM r WHERE place = 1")
def a13_selected_inputs(spark, sf):
    """The first ready candidate of each metric."""
    ready = liability_families(spark, sf).where("state = 'ready'")
    return ready.groupBy(*KEYS, "metric_key").agg(F.min(F.struct("grp", "value")).alias("x")).select(*KEYS, "metric_key", "x.grp", "x.value")


EBITDA = f"{WITH_FACTS}, e AS (SELECT entity_id, period_label, CASE WHEN fy % 7 <> 0 THEN net_profit + interest_expense END AS ebitda, {pick(['approximation', 'reported', 'none'], 'entity_id')} AS basis FROM facts)"


@query(f"{EBITDA} SELECT entity_id, period_label, CASE basis WHEN 'approximation' THEN 'derived' ELSE 'reported' END AS kind, CASE basis WHEN 'approximation' THEN 'approximated' ELSE 'reported' END AS precedence_group, ebitda AS value FROM e WHERE ebitda IS NOT NULL AND basis <> 'none'")
def a4_a10_ebitda_variants(spark, sf):
    """EBITDA by what is known of it: approximated, reported, or no candidate."""
    e = statement_facts(spark, sf).select(*KEYS, F.when(F.col("fy") % 7 != 0, F.col("net_profit") + F.col("interest_expense")).alias("value"), F.expr(pick(["approximation", "reported", "none"], "entity_id")).alias("basis"))
    e = e.where("value IS NOT NULL AND basis <> 'none'")
    return e.select(*KEYS, F.when(F.col("basis") == "approximation", "derived").otherwise("reported").alias("kind"), F.when(F.col("basis") == "approximation", "approximated").otherwise("reported").alias("precedence_group"), "value")


UPSTREAM = ["unexpected_unit", "MATH_INPUT_NON_FINITE", "input_not_numeric", "some_other_reason", "unexpected_negative_input", "MATH_INPUT_UNEXPECTED_UNIT"]
FIRST, SECOND = pick(UPSTREAM, "entity_id"), pick(UPSTREAM, "fy")
OLD_CASE = "CASE r " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in d.OLD_INPUT_REASONS.items()) + " ELSE r END"


@query(f"""{WITH_FACTS}, r AS (SELECT entity_id, period_label, 1 AS place, {FIRST} AS r FROM facts UNION ALL SELECT entity_id, period_label, 2, {SECOND} FROM facts), n AS (SELECT entity_id, period_label, min(place) AS place, {OLD_CASE} AS reason FROM r GROUP BY 1, 2, 4)
SELECT entity_id, period_label, coalesce(string_agg(reason, ',' ORDER BY place) FILTER (starts_with(reason, 'MATH_')), '') AS reasons FROM n GROUP BY 1, 2""")
def a24_outward_reasons(spark, sf):
    return statement_facts(spark, sf).select(*KEYS, F.array_join(d.outward_reasons(F.array(F.expr(FIRST), F.expr(SECOND)), list(dims.TIERS)), ",").alias("reasons"))


@query(f"{WITH_FACTS}, m AS (SELECT entity_id, period_label, CAST(revenue AS DECIMAL(38,4)) AS canonical, CASE WHEN entity_id % 6 <> 0 THEN revenue END AS projected FROM facts) SELECT entity_id, period_label, canonical IS NULL AS canonical_missing FROM m WHERE (canonical IS NULL) <> (projected IS NULL)")
def a27_lifecycle_violations(spark, sf):
    """Canonical and projected values are both there or both missing; these are not."""
    m = statement_facts(spark, sf).select(*KEYS, F.col("revenue").cast("decimal(38,4)").alias("canonical"), F.when(F.col("entity_id") % 6 != 0, F.col("revenue")).alias("projected"))
    return m.where(F.col("canonical").isNull() != F.col("projected").isNull()).select(*KEYS, F.col("canonical").isNull().alias("canonical_missing"))


# --- methodology ----------------------------------------------------------------------------------------------------

NAMES = pick(["auto", " Retail_Demo ", None, "bank", "generic"], "entity_id + fy")


@query(f"{WITH_FACTS}, n AS (SELECT entity_id, period_label, lower(trim(coalesce({NAMES}, 'auto'))) AS n FROM facts) SELECT entity_id, period_label, CASE WHEN n IN ('generic', 'retail_demo') THEN n ELSE 'generic' END AS profile FROM n")
def k4_profile_names(spark, sf):
    return statement_facts(spark, sf).select(*KEYS, d.profile(F.expr(NAMES)).alias("profile"))


DEBT = "CASE WHEN entity_id % 3 <> 0 THEN short_term_liabilities / nullif(equity, 0) END"


@query(f"{WITH_FACTS}, l AS (SELECT entity_id, period_label, entity_id % 2 = 0 AS retail, liabilities / nullif(equity, 0) AS total, {DEBT} AS debt FROM facts) SELECT entity_id, period_label, CASE WHEN retail AND debt IS NOT NULL THEN 'debt_only' ELSE 'total_liabilities' END AS basis, CASE WHEN retail AND debt IS NOT NULL THEN debt ELSE total END AS leverage FROM l")
def k8_leverage_basis(spark, sf):
    profile = F.when(F.col("entity_id") % 2 == 0, "retail_demo").otherwise("generic")
    out = statement_facts(spark, sf).select(*KEYS, d.leverage(profile, F.expr("liabilities / nullif(equity, 0)"), F.expr(DEBT)).alias("x"))
    return out.select(*KEYS, "x.basis", "x.leverage")


METHOD = {"period": pick(["annualized_Q1 ", "monthly", None, "annualized_h1", "reported"], "fy"), "reason": pick(["a", "b", "a"], "entity_id"), "other": pick(["b", "a"], "fy")}


@query(f"{WITH_FACTS}, m AS (SELECT entity_id, period_label, lower(trim({METHOD['period']})) AS p, {METHOD['reason']} AS r, {METHOD['other']} AS o FROM facts) SELECT entity_id, period_label, CASE WHEN p IN ('reported', 'annualized_q1', 'annualized_h1') THEN p ELSE 'reported' END AS period_basis, CASE WHEN r = o THEN r ELSE r || ',' || o END AS reasons FROM m")
def k10_methodology(spark, sf):
    return statement_facts(spark, sf).select(*KEYS, d.one_of(F.expr(METHOD["period"]), d.PERIOD_BASES).alias("period_basis"), F.array_join(F.array_distinct(F.array(F.expr(METHOD["reason"]), F.expr(METHOD["other"]))), ",").alias("reasons"))


# --- merging --------------------------------------------------------------------------------------------------------

MODEL = {"value": "CASE WHEN entity_id % 9 = 0 THEN NULL WHEN entity_id % 9 = 1 THEN -total_assets WHEN entity_id % 9 = 2 THEN total_assets * 12.0 ELSE total_assets * 1.5 END", "confidence": "CASE WHEN fy % 4 = 0 THEN 0.4 ELSE 0.8 END", "fallback": "CASE WHEN fy % 5 <> 0 THEN total_assets END"}


@query(f"""{WITH_FACTS}, m AS (SELECT entity_id, period_label, {MODEL['value']} AS v, CAST({MODEL['confidence']} AS DOUBLE) AS c, {MODEL['fallback']} AS f, entity_id % 2 = 0 AS strong, fy % 3 = 0 AS auth, entity_id % 5 = 0 AS weak FROM facts) SELECT entity_id, period_label, CASE WHEN v IS NULL THEN NULL WHEN c < 0.5 OR NOT strong THEN 'llm_rejected_below_threshold' WHEN f IS NULL THEN NULL
 WHEN auth THEN 'llm_rejected_authoritative_override' WHEN weak THEN NULL WHEN f = 0 OR v = 0 OR f * v < 0 OR greatest(abs(f), abs(v)) / greatest(least(abs(f), abs(v)), 1e-9) >= 10 THEN 'llm_rejected_same_sign_ratio' ELSE 'llm_rejected_strong_direct_fallback' END AS reason FROM m""")
def m6_rejections(spark, sf):
    m = statement_facts(spark, sf)
    e = F.col("entity_id")
    return m.select(*KEYS, d.rejection(F.expr(MODEL["value"]), F.expr(MODEL["confidence"]), e % 2 == 0, F.expr(MODEL["fallback"]), F.col("fy") % 3 == 0, e % 5 == 0, 0.5).alias("reason"))


#: The overrides kept with the code, and how a report is recognised as theirs.
OVERRIDES = [("ebitda", 85_628_000_000.0), ("interest_expense", 29_095_000_000.0), ("net_profit", 6_544_000_000.0)]
ISSUERS = ["магнит", "magnit"]
PERIODS = ["1 полугод", "за шесть месяцев", "шесть месяцев", "30 июня 2025", "six months", "30 june 2025", "half-year 2025", "half year 2025", "h1 2025"]
CONTEXT = "lower(concat(CASE WHEN entity_id % 3 = 0 THEN 'MAGNIT ' ELSE 'Other ' END, CASE WHEN fy % 2 = 0 THEN 'H1 2025 ' ELSE 'FY 2025 ' END, period_label))"
MARKED = "(" + " OR ".join(f"contains(context, '{m}')" for m in ISSUERS) + ") AND contains(context, '2025') AND (" + " OR ".join(f"contains(context, '{m}')" for m in PERIODS) + ")"


@query(f"""{WITH_FACTS}, o AS (SELECT * FROM (VALUES {", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in OVERRIDES)}) AS v(metric_key, override)), m AS (SELECT entity_id, period_label, {CONTEXT} AS context, 'net_profit' AS metric_key, CASE WHEN fy % 5 = 0 THEN 6500000000.0 ELSE net_profit END AS value FROM facts UNION ALL SELECT entity_id, period_label, {CONTEXT}, 'interest_expense', CAST(NULL AS DOUBLE) FROM facts),
g AS (SELECT *, CASE WHEN coalesce(value, 0) = 0 THEN 1.0 ELSE abs(value - override) / greatest(abs(override), 1.0) END AS gap FROM m JOIN o USING (metric_key) WHERE {MARKED}) SELECT entity_id, period_label, metric_key, value AS original, override AS value, CAST(gap * 100.0 AS DOUBLE) AS discrepancy_pct FROM g WHERE value IS NULL OR gap > 0.1""")
def s11_m7_issuer_overrides(spark, sf):
    row = lambda k, v: F.struct(F.lit(k).alias("metric_key"), v.alias("value"))
    metrics = statement_facts(spark, sf).select(*KEYS, F.expr(CONTEXT).alias("context"), F.explode(F.array(row("net_profit", F.when(F.col("fy") % 5 == 0, 6_500_000_000.0).otherwise(F.col("net_profit"))), row("interest_expense", F.lit(None).cast("double")))).alias("m"))
    listed = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    rows = ", ".join(f"('{k}', {v}D)" for k, v in OVERRIDES)
    overrides = spark.sql(f"SELECT metric_key, override, {listed(ISSUERS)} AS issuers, '2025' AS year, {listed(PERIODS)} AS periods FROM VALUES {rows} AS v(metric_key, override)")
    return d.overridden(metrics.select(*KEYS, "context", "m.metric_key", "m.value"), overrides, KEYS)


FOUND = {k: f"CASE WHEN entity_id % 4 <> 0 THEN floor({k} / {n}) * 1.0 END" for k, n in (("revenue", 1000), ("net_profit", 100000), ("total_assets", 1000), ("equity", 10_000_000))}
KEPT = {"revenue": "revenue", "net_profit": "CASE WHEN fy % 3 <> 0 THEN net_profit END", "total_assets": "CASE WHEN fy % 2 = 0 THEN total_assets END", "equity": "CASE WHEN fy % 4 <> 0 THEN equity END"}


@query(f"""{WITH_FACTS}, m AS (SELECT entity_id, period_label, {", ".join(f"{v} AS k_{k}" for k, v in KEPT.items())}, {", ".join(f"CAST({v} AS DOUBLE) AS f_{k}" for k, v in FOUND.items())} FROM facts), t AS (SELECT *, coalesce(k_revenue, 0) = 0 OR coalesce(k_total_assets, 0) = 0 AS due FROM m)
SELECT entity_id, period_label, {", ".join(f"coalesce(k_{k}, CASE WHEN due AND abs(f_{k}) >= 1000" + (" AND NOT (k_net_profit IS NOT NULL AND k_total_assets IS NOT NULL)" if k == "revenue" else "") + f" THEN f_{k} END) AS {k}" for k in KEPT)} FROM t""")
def m8_pattern_fallback(spark, sf):
    """Missing metrics from patterns, if revenue or assets are missing or zero; no revenue beside known profit and assets."""
    m = statement_facts(spark, sf).select(*KEYS, *[F.expr(v).alias(f"k_{k}") for k, v in KEPT.items()], *[F.expr(v).cast("double").alias(f"f_{k}") for k, v in FOUND.items()])
    due = (F.coalesce("k_revenue", F.lit(0.0)) == 0) | (F.coalesce("k_total_assets", F.lit(0.0)) == 0)
    known = F.col("k_net_profit").isNotNull() & F.col("k_total_assets").isNotNull()
    return m.select(*KEYS, *[d.filled(k, F.col(f"k_{k}"), F.col(f"f_{k}"), ~due | known if k == "revenue" else ~due).alias(k) for k in KEPT])


# --- sessions, landing files, texts ---------------------------------------------------------------------------------


@query(f"{WITH_FACTS} SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY fy, CASE cls WHEN 'Q1' THEN 1 WHEN 'H1' THEN 2 ELSE 3 END) AS place, period_label, CASE WHEN revenue IS NULL THEN 'error' ELSE 'ok' END AS status, revenue FROM facts")
def p10_session_periods(spark, sf):
    """The periods of a session in their order; failed ones stay, as errors. A session has few periods."""
    rank = F.when(F.col("cls") == "Q1", 1).when(F.col("cls") == "H1", 2).otherwise(3)
    row = F.struct("fy", rank.alias("r"), "period_label", F.when(F.col("revenue").isNull(), "error").otherwise("ok").alias("status"), "revenue")
    each = statement_facts(spark, sf).groupBy("entity_id").agg(F.sort_array(F.collect_list(row)).alias("p")).select("entity_id", F.posexplode("p").alias("place", "x"))
    return each.select("entity_id", (F.col("place") + 1).alias("place"), "x.period_label", "x.status", "x.revenue")


CONTENT = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('%PDF-1.7 ', coalesce(text, '')) WHEN 2 THEN text ELSE concat('%PDF-', coalesce(text, '')) END"
TYPE = "CASE doc_id % 7 WHEN 0 THEN 'text/html' WHEN 1 THEN NULL WHEN 2 THEN 'application/octet-stream' ELSE 'application/pdf' END"


@query(f"""WITH l AS (SELECT doc_id, {CONTENT} AS content, {TYPE} AS kind FROM documents) SELECT doc_id, CASE WHEN kind IS NULL OR kind NOT IN ('application/pdf', 'application/octet-stream') THEN 'unexpected_type' WHEN coalesce(strlen(content), 0) = 0 THEN 'empty' WHEN left(content, 5) <> '%PDF-' THEN 'no_pdf' WHEN strlen(content) > {d.LANDING_BYTES} THEN 'too_large' ELSE 'accepted' END AS verdict FROM l""")
def s13_landing_check(spark, sf):
    return read(spark, sf, "documents").select("doc_id", d.landing_verdict(F.expr(CONTENT), F.expr(TYPE)).alias("verdict"))


REPORT = "CASE doc_id % 3 WHEN 0 THEN concat(text, chr(10), 'Notes to the Financial statements ', text) WHEN 1 THEN concat('Notes to the financial ', text, ' Пояснительная записка', chr(10), text) ELSE text END"
AT = "coalesce(" + ", ".join(f"nullif(strpos(lower(t), '{h}'), 0)" for h in d.NARRATIVE_HEADINGS) + ", 1)"


@query(rf"WITH r AS (SELECT doc_id, {REPORT} AS t FROM documents), n AS (SELECT doc_id, regexp_replace(substring(t, {AT}, 8000), '^\s+|\s+$', '', 'g') AS n FROM r) SELECT doc_id, length(n) AS n_chars, sha256(n) AS text_sha256 FROM n")
def t15_narrative_window(spark, sf):
    text = d.narrative(F.expr(REPORT.replace("chr(10)", "'\\n'")))
    return read(spark, sf, "documents").select("doc_id", text.alias("n")).select("doc_id", F.char_length("n").cast("long").alias("n_chars"), F.sha2("n", 256).alias("text_sha256"))
