"""Decisions about candidates, metadata and methodology; each is an expression over its row and needs no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.numbers import let

# --- fixed values ---------------------------------------------------------------------------------------------------

#: Old metadata sources: source, match, mode, reason, override. Every other source is a derived one.
V1_SOURCES = {
    "table_exact": ("table", "exact", "direct", None, False),
    "table_partial": ("table", "not_applicable", "direct", "legacy_table_partial_unresolved", False),
    "text_regex": ("text", "not_applicable", "direct", "legacy_text_regex_unresolved", False),
    "issuer_fallback": ("issuer_fallback", "not_applicable", "policy_override", "issuer_repo_override", True),
}
V1_OTHER = ("derived", "not_applicable", "derived", None, False)
#: Priorities of the reasons that a final state may have.
REASON_PRIORITY = {
    "issuer_repo_override": 500,
    "llm_extraction": 120,
    "gross_profit_to_ebitda_approximation": 110,
    "legacy_table_partial_unresolved": 20,
    "legacy_text_regex_unresolved": 20,
    "guardrail_current_assets_gt_total_assets": 400,
    "guardrail_liabilities_gt_total_assets": 400,
    "guardrail_equity_gt_total_assets": 400,
    "guardrail_short_term_liabilities_gt_total_assets": 400,
    "guardrail_component_gt_current_assets": 400,
    "guardrail_short_term_liabilities_gt_liabilities": 400,
    "guardrail_current_assets_candidate_lt_component_replaced": 200,
    "sanity_pnl_replaced_revenue_with_code": 300,
    "sanity_pnl_replaced_net_profit_with_code": 300,
}
#: Part, whole and reason of the result guardrails, in their order.
GUARDRAILS = [
    ("current_assets", "total_assets", "guardrail_current_assets_gt_total_assets"),
    ("liabilities", "total_assets", "guardrail_liabilities_gt_total_assets"),
    ("equity", "total_assets", "guardrail_equity_gt_total_assets"),
    ("short_term_liabilities", "total_assets", "guardrail_short_term_liabilities_gt_total_assets"),
    ("cash_and_equivalents", "current_assets", "guardrail_component_gt_current_assets"),
    ("inventory", "current_assets", "guardrail_component_gt_current_assets"),
    ("accounts_receivable", "current_assets", "guardrail_component_gt_current_assets"),
    ("short_term_liabilities", "liabilities", "guardrail_short_term_liabilities_gt_liabilities"),
]
#: What a label may and may not contain, by metric: rejected words, words of totals, quality of a total.
LABEL_RULES = {
    "current_assets": (["внеоборотн", "non-current", "прочие", "прочая", "other"], ["итого оборотных активов", "итого оборотные активы", "оборотные активы всего", "итого по разделу ii", "итого по разделу п", "total current assets", "current assets total"], 90),
    "short_term_liabilities": (["по аренде", "аренд", "lease", "прочие", "прочая", "other current liabilities", "кредиторск"], ["итого краткосрочных обязательств", "итого краткосрочные обязательства", "краткосрочные обязательства всего", "итого по разделу v", "итого по разделу у", "total current liabilities", "current liabilities total"], 90),
    "short_term_borrowings": (["аренд", "lease"], ["краткосрочные кредиты и займы", "краткосрочные заемные средства", "short-term borrowings", "current borrowings"], 88),
    "long_term_borrowings": (["аренд", "lease"], ["долгосрочные кредиты и займы", "долгосрочные заемные средства", "long-term borrowings", "non-current borrowings"], 88),
    "short_term_lease_liabilities": ([], ["краткосрочные обязательства по аренде", "short-term lease liabilities", "current lease liabilities"], 88),
    "long_term_lease_liabilities": ([], ["долгосрочные обязательства по аренде", "long-term lease liabilities", "non-current lease liabilities"], 88),
    "liabilities": ([], ["итого обязательств", "итого обязательства", "обязательства всего", "total liabilities", "liabilities total"], 90),
}
LANDING_TYPES = ["application/pdf", "application/octet-stream"]
LANDING_BYTES = 50 * 1024 * 1024
NARRATIVE_HEADINGS = ["пояснительная записка", "пояснительная записка к бухгалтерской", "пояснения к бухгалтерской", "notes to the financial"]
PERIOD_BASES = ["reported", "annualized_q1", "annualized_h1"]
PROFILES = ["generic", "retail_demo"]
#: Old names of input reasons.
OLD_INPUT_REASONS = {
    "input_not_numeric": "MATH_INPUT_NOT_NUMERIC",
    "unexpected_unit": "MATH_INPUT_UNEXPECTED_UNIT",
    "input_non_finite": "MATH_INPUT_NON_FINITE",
    "unexpected_negative_input": "MATH_INPUT_UNEXPECTED_NEGATIVE",
}
MONETARY = "revenue net_profit total_assets liabilities equity current_assets short_term_liabilities accounts_receivable inventory cash_and_equivalents".split()


def first_of(checks: list[tuple[Column, str]]) -> Column:
    """The name of the first condition that holds, or null."""
    return reduce(lambda c, x: c.when(x[0], F.lit(x[1])), checks[1:], F.when(checks[0][0], F.lit(checks[0][1])))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


# --- metadata -------------------------------------------------------------------------------------------------------


def evidence(values: tuple) -> Column:
    source, match, mode, reason, override = values
    return F.struct(F.lit(source).alias("source"), F.lit(match).alias("match"), F.lit(mode).alias("mode"), F.lit(reason).cast("string").alias("reason"), F.lit(override).alias("override"))


def normalised_v1(source: Column) -> Column:
    """Today's evidence fields for the source of an old metadata row."""
    return reduce(lambda c, x: c.when(source == x[0], evidence(x[1])), list(V1_SOURCES.items())[1:], F.when(source == "table_exact", evidence(V1_SOURCES["table_exact"]))).otherwise(evidence(V1_OTHER))


def legacy_profile(match_type: Column, is_exact: Column) -> Column:
    """Source, match and mode of a candidate that names only how it was matched."""
    table = F.when(is_exact, F.lit("table/exact/direct")).otherwise("table/keyword_match/direct")
    return F.when(match_type == "table", table).when(match_type == "text_regex", "text/keyword_match/direct").otherwise("derived/not_applicable/derived")


def metadata_violation(version: str = "version", source: str = "source", match: str = "match", mode: str = "mode", state: str = "state", reason: str = "reason", flags: str = "flags", override: str = "override") -> Column:
    """The first rule that a metadata row breaks, or null."""
    c = F.col
    policy, guarded, none = c(mode) == "policy_override", c(state) == "guardrail_adjusted", F.coalesce(c(reason), F.lit("")) == ""
    return first_of([
        (policy & (c(source) != "issuer_fallback"), "override_source"), (policy & (c(match) != "not_applicable"), "override_match"), (policy & ~c(override), "override_not_authoritative"), (policy & none, "override_reason"),
        ((c(mode) == "derived") & (c(source) != "derived"), "derived_mode_source"), ((c(source) == "derived") & (c(mode) != "derived"), "derived_source_mode"),
        ((c(match) == "not_applicable") & ~c(source).isin("derived", "issuer_fallback") & (c(version) != "v1"), "match_missing"),
        (guarded & none, "guardrail_reason"), (guarded & ~F.exists(c(flags), lambda f: f.startswith("pp:")), "guardrail_flag"), (c(override) & ~policy, "authoritative_without_override"),
    ])


def preferred_reason(reasons: Column) -> Column:
    """Of several reasons the one of the highest priority that a final state may have, the first of equals."""
    priority = F.create_map(*[F.lit(x) for pair in REASON_PRIORITY.items() for x in pair])
    ranked = F.transform(reasons, lambda r, i: F.struct(priority[r].alias("priority"), (-i).alias("place"), r.alias("reason")))
    return F.array_max(F.filter(ranked, lambda x: x["priority"].isNotNull()))["reason"]


def guarded(facts: DataFrame, rules: list[tuple[str, str, str]] = GUARDRAILS) -> DataFrame:
    """facts with parts above their totals set to null, in the order of the rules, and events (part, reason, before)."""
    out = facts.withColumn("events", F.array().cast("array<struct<part:string,reason:string,before:double>>"))
    for part, whole, reason in rules:
        bad = F.coalesce(F.col(part) > F.col(whole), F.lit(False))
        event = F.struct(F.lit(part).alias("part"), F.lit(reason).alias("reason"), F.col(part).alias("before"))
        out = out.withColumns({"events": F.when(bad, F.array_append("events", event)).otherwise(F.col("events")), part: F.when(~bad, F.col(part))})
    return out


def label_quality(metric: Column, label: Column) -> Column:
    """The quality of a candidate by its metric and label; null where the label must not give one."""
    # Within lambdas: the label is put in lower case once, and the many tests do not make one method too long to be compiled.
    return let(F.trim(F.regexp_replace(F.lower(label), r"\s+", " ")), lambda low: quality_of(metric, low))


def quality_of(metric: Column, low: Column) -> Column:
    """label_quality for a label in lower case with single blanks."""
    rules = [F.when(metric == m, F.when(~contains_any(low, rejected) & contains_any(low, totals), quality)) for m, (rejected, totals, quality) in LABEL_RULES.items()]
    owed = F.when(~contains_any(low, ["долгосрочн", "long-term", "non-current"]), F.when(contains_any(low, ["торговая и прочая дебиторская задолженность", "trade receivables"]), 88).when(contains_any(low, ["дебиторск", "receivable"]), 70))
    whole = (low.contains("совокупный финансовый результат периода") & ~contains_any(low, ["чистая прибыль", "2400"])) | (low.contains("total comprehensive income") & ~contains_any(low, ["net profit", "net income", "2400"]))
    known = [*LABEL_RULES, "accounts_receivable", "net_profit"]
    return F.coalesce(*rules, F.when(metric == "accounts_receivable", owed), F.when((metric == "net_profit") & ~whole, 50), F.when(~metric.isin(known), 50))


# --- the engine's inputs --------------------------------------------------------------------------------------------


def average_eligibility(opening: Column, closing: Column, same_unit: Column) -> Column:
    """Reasons (joined) why an average balance may not be used, or null; states are ready, missing, invalid or null."""
    return first_of([
        (opening.isNull() | (opening == "missing"), "COMPARATIVE_MISSING_OPENING_BALANCE,COMPARATIVE_FORBIDDEN_APPROXIMATION"), (opening != "ready", "COMPARATIVE_INCOMPATIBLE_OPENING_BASIS"),
        (closing.isNull() | (closing == "missing"), "COMPARATIVE_MISSING_CLOSING_BALANCE"), (closing != "ready", "COMPARATIVE_INCOMPATIBLE_CLOSING_BASIS"), (~same_unit, "COMPARATIVE_INCOMPATIBLE_OPENING_BASIS"),
    ])


def coverage_gate(coverage: Column, kind: Column, approximate: Column) -> Column:
    """Validity and reason of a metric by its coverage class, the kind of the selected candidate (null: none) and whether
    approximation is meant."""
    blocked = first_of([
        ((coverage == "reported_only") & (kind != "reported"), "INVALID:MATH_COVERAGE_REPORTED_CANDIDATE_REQUIRED"), ((coverage == "derived_formula") & (kind == "reported"), "INVALID:MATH_COVERAGE_REPORTED_CANDIDATE_REQUIRED"),
        ((coverage == "approximate_only") & ~approximate, "INVALID:MATH_COVERAGE_APPROXIMATION_SEMANTICS_REQUIRED"), (coverage == "intentionally_suppressed", "SUPPRESSED:MATH_COVERAGE_INTENTIONALLY_SUPPRESSED"),
        (coverage == "out_of_scope", "NOT_APPLICABLE:MATH_COVERAGE_OUT_OF_SCOPE"),
    ])
    return F.coalesce(blocked, F.lit("VALID:"))


def outward_reasons(reasons: Column, declared: list[str]) -> Column:
    """Input reasons by their present names, each once, those that are declared only."""
    names = F.create_map(*[F.lit(x) for pair in OLD_INPUT_REASONS.items() for x in pair])
    return F.filter(F.array_distinct(F.transform(reasons, lambda r: F.coalesce(names[r], r))), lambda r: r.isin(declared))


# --- methodology ----------------------------------------------------------------------------------------------------


def profile(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit("auto"))))
    return F.when(low.isin(PROFILES), low).otherwise("generic")


def leverage(profile: Column, total: Column, debt_only: Column) -> Column:
    """basis and active leverage: debt only for the retail profile where it is known."""
    use = F.coalesce((profile == "retail_demo") & debt_only.isNotNull(), F.lit(False))
    return F.struct(F.when(use, "debt_only").otherwise("total_liabilities").alias("basis"), F.when(use, debt_only).otherwise(total).alias("leverage"))


def one_of(value: Column, allowed: list[str]) -> Column:
    """The value in lower case if it is allowed, else the first allowed one."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(allowed), low).otherwise(allowed[0])


# --- merging --------------------------------------------------------------------------------------------------------


def rejection(value: Column, confidence: Column, strong: Column, fallback: Column, authoritative: Column, replaceable: Column, threshold: float) -> Column:
    """Why a model's value was not taken, or null."""
    ratio = F.greatest(F.abs(fallback), F.abs(value)) / F.greatest(F.least(F.abs(fallback), F.abs(value)), F.lit(1e-9))
    late = F.when(replaceable, None).when((fallback == 0) | (value == 0) | (fallback * value < 0) | (ratio >= 10), "llm_rejected_same_sign_ratio").otherwise("llm_rejected_strong_direct_fallback")
    weak = ~F.coalesce(confidence >= threshold, F.lit(False)) | ~strong
    return F.when(value.isNull(), None).when(weak, "llm_rejected_below_threshold").when(fallback.isNull(), None).when(authoritative, "llm_rejected_authoritative_override").otherwise(late)


def overridden(metrics: DataFrame, overrides: DataFrame, keys: list[str], limit: float = 0.10) -> DataFrame:
    """keys, metric_key, original, value, discrepancy_pct: for the entities whose context (lower case) names an issuer, a
    year and a period of overrides (metric_key, override, issuers, year, periods), the metrics that are missing or differ
    by more than the limit. The overrides are few rows; they meet the metrics by an equality of metric_key."""
    both = metrics.join(overrides, "metric_key").where(F.exists("issuers", lambda m: F.col("context").contains(m)) & F.col("context").contains(F.col("year")) & F.exists("periods", lambda m: F.col("context").contains(m)))
    gap = F.when(F.coalesce("value", F.lit(0.0)) == 0, 1.0).otherwise(F.abs(F.col("value") - F.col("override")) / F.greatest(F.abs("override"), F.lit(1.0)))
    return both.withColumn("gap", gap).where(F.col("value").isNull() | (F.col("gap") > limit)).select(*keys, "metric_key", F.col("value").alias("original"), F.col("override").alias("value"), (F.col("gap") * 100.0).alias("discrepancy_pct"))


def filled(key: str, value: Column, found: Column, blocked: Column) -> Column:
    """A missing metric from a pattern match; small amounts are no money."""
    enough = F.abs(found) >= 1000.0 if key in MONETARY else F.lit(True)
    return F.coalesce(value, F.when(~blocked & enough, found))


# --- landing files and texts ----------------------------------------------------------------------------------------


def landing_verdict(content: Column, content_type: Column, most_bytes: int = LANDING_BYTES) -> Column:
    size = F.octet_length(content)
    return F.coalesce(first_of([(~F.coalesce(content_type.isin(LANDING_TYPES), F.lit(False)), "unexpected_type"), (F.coalesce(size, F.lit(0)) == 0, "empty"), (F.substring(content, 1, 5) != "%PDF-", "no_pdf"), (size > most_bytes, "too_large")]), F.lit("accepted"))


def narrative(text: Column, most: int = 8000) -> Column:
    """The text from the first listed heading that it has, or its head."""
    low = F.lower(text)
    start = F.coalesce(*[F.when(low.contains(h), F.instr(low, h)) for h in NARRATIVE_HEADINGS], F.lit(1))
    return F.regexp_replace(F.substring(text, start, F.lit(most)), r"^\s+|\s+$", "")
