"""Calibration suites: JSON files of cases with expectations, checked against their contract and compared with outcomes.

A suite is one row (file, text), or several: parts of a bounded size, each with the suite's own fields and some of its
cases, so that no task holds a suite whole. Cases are exploded once by a fixed schema; contract breaks are rows of a table of their
own, so that a bad suite stops nothing and hides nothing. Outcomes are one row for each case (threshold and merge) or each
expectation (parse), with what was expected and what came.

Defined cases: text that is no JSON object is one violation and gives no cases; a suite without cases gives none; repeated
case ids are violations, and each of the cases is kept; null fields are as absent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators import audit
from statloom.operators.extraction import prefer_model

#: What a case may name.
TIERS = ["fast", "gated"]
SURFACES = ["threshold_boundary", "winner_selection", "merge_replacement", "expected_absent", "threshold_survival", "authoritative_override", "approximation_separation"]
RISK_TAGS = ["historically_flaky", "ocr_fragile", "low_confidence", "source_sensitive", "replacement_path", "false_positive_trap", "boundary_near_0_5", "weak_keyword", "weak_ocr_direct"]
MODES = ["text_only", "tables+text", "force_ocr"]
KINDS = ["candidate_threshold", "parse", "merge"]

CANDIDATE = "struct<value: double, match_type: string, is_exact: boolean, candidate_quality: int, source: string, conflict_count: int, structural: boolean, guarded: boolean>"
EXPECTED = "struct<survives: boolean, value: double, tolerance: double, expected_source: string, source_strictness: string, winner: string, authoritative_override: boolean, reason_code: string>"
METADATA = "struct<value: double, confidence: double, source: string, reason_code: string, authoritative_override: boolean>"
CASE = (
    "struct<case_id: string, kind: string, suite_id: string, suite_tier: string, decision_surface: string, risk_tags: array<string>, anchor: boolean, fixture_ref: string, pipeline_mode: string, "
    f"metric_key: string, candidate: {CANDIDATE}, expected: {EXPECTED}, expectations: map<string, {EXPECTED}>, llm_metadata: {METADATA}, fallback_candidate: {CANDIDATE}, fallback_metadata: {METADATA}>"
)
SUITE = f"struct<version: int, suite_id: string, suite_tier: string, threshold: double, cases: array<{CASE}>>"


def read_suites(texts: DataFrame) -> DataFrame:
    """file, suite (null if the text is no JSON object)."""
    object_ = F.col("text").rlike(r"(?s)^\s*\{.*\}\s*$")
    return texts.select("file", F.when(object_, F.from_json("text", SUITE)).alias("suite"))


def cases(suites: DataFrame) -> DataFrame:
    """file, suite_id, suite_tier, version, threshold and the case's fields, a row for each case."""
    # The suite's own fields are taken out first, or each case would carry its whole suite along; an outer generator, since
    # for others the optimizer adds a filter that reads the text once more.
    flat = suites.select("file", "suite.suite_id", "suite.suite_tier", "suite.version", F.coalesce("suite.threshold", F.lit(0.5)).alias("threshold"), "suite.cases")
    each = flat.select("file", "suite_id", "suite_tier", "version", "threshold", F.posexplode_outer("cases").alias("at", "case")).where("at IS NOT NULL").drop("at")
    return each


def violations(suites: DataFrame) -> DataFrame:
    """file, case_id, violation: every rule that a file or a case breaks."""
    # Parts of one file break its rules once.
    whole = suites.groupBy().agg(F.count_distinct("suite.version").alias("n_versions"), F.count_distinct(F.coalesce("suite.threshold", F.lit(0.5))).alias("n_thresholds"))  # two numbers for all files
    files = suites.crossJoin(F.broadcast(whole)).select(
        "file", F.lit(None).cast("string").alias("case_id"),
        F.explode(F.array_compact(F.array(
            F.when(F.col("suite").isNull(), F.lit("no_object")), F.when(~F.col("suite.suite_tier").isin(TIERS), F.lit("suite_tier")), F.when(F.col("suite").isNotNull() & F.col("suite.suite_tier").isNull(), F.lit("suite_tier")),
            F.when(F.col("suite").isNotNull() & (F.col("n_versions") > 1), F.lit("versions_differ")), F.when(F.col("suite").isNotNull() & (F.col("n_thresholds") > 1), F.lit("thresholds_differ")),
        ))).alias("violation"),
    ).distinct()
    c = lambda name: F.col(f"case.{name}")
    odd = F.size(F.array_except(F.coalesce(c("risk_tags"), F.array().cast("array<string>")), F.array(*map(F.lit, RISK_TAGS)))) > 0
    rules = [
        (~F.coalesce(c("decision_surface"), F.lit("")).isin(SURFACES), "decision_surface"), (odd, "risk_tags"), (~c("pipeline_mode").isin(MODES), "pipeline_mode"),
        (c("suite_id") != F.col("suite_id"), "suite_id"), (c("suite_tier") != F.col("suite_tier"), "case_tier"), (~F.coalesce(c("kind"), F.lit("")).isin(KINDS), "kind"),
        ((c("kind") == "parse") & (F.coalesce(F.size(F.map_keys(c("expectations"))), F.lit(0)) <= 0), "no_expectation"),
        ((c("kind") == "merge") & c("fallback_candidate").isNull() & c("fallback_metadata").isNull(), "no_fallback"),
    ]
    all_cases = cases(suites)
    broken = all_cases.select("file", c("case_id").alias("case_id"), F.explode(F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for rule, name in rules]))).alias("violation"))
    twice = all_cases.groupBy(c("case_id").alias("case_id")).agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n > 1").select("file", "case_id", F.lit("case_id_repeated").alias("violation"))
    return files.unionByName(broken).unionByName(twice)


def candidate_confidence(candidate: Column) -> Column:
    """The confidence that the policy gives a candidate."""
    profile = F.concat_ws("_", candidate["match_type"], F.when(F.coalesce(candidate["is_exact"], F.lit(False)), "exact").otherwise("keyword"))
    flag = lambda name: F.coalesce(candidate[name], F.lit(False))
    return audit.confidence(profile, F.coalesce(candidate["candidate_quality"], F.lit(50)), flag("structural"), F.coalesce(candidate["conflict_count"], F.lit(0)), flag("guarded"))


def judged(rows: DataFrame) -> DataFrame:
    """Adds survived, source_mismatch, correct, outcome, expected_outcome, false_accept and false_reject to rows of (value,
    confidence, source, expected, threshold)."""
    e = F.col("expected")
    survived = F.col("value").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= F.col("threshold"))
    source = F.when(F.col("value").isNotNull(), F.col("source"))
    mismatch = survived & F.coalesce(e["expected_source"].isNotNull() & ~source.eqNullSafe(e["expected_source"]), F.lit(False))
    wanted = F.coalesce(e["survives"], F.lit(False))
    near = e["value"].isNull() | ~survived | (F.abs(F.col("value") - e["value"]) <= F.coalesce(e["tolerance"], F.lit(0.0)))
    critical = (F.coalesce(e["source_strictness"], F.lit("unspecified")) == "critical") & mismatch
    return rows.withColumns({
        "survived": survived, "source_mismatch": mismatch, "correct": (survived == wanted) & near & ~critical,
        "outcome": F.when(survived & source.isNotNull(), F.concat(F.lit("survive:"), source)).otherwise("absent"),
        "expected_outcome": F.when(wanted & e["expected_source"].isNotNull(), F.concat(F.lit("survive:"), e["expected_source"])).when(wanted, "survive").otherwise("absent"),
        "false_accept": ~wanted & survived, "false_reject": wanted & ~survived,
    })


OUTCOME = ["suite_id", "case_id", "metric_key", "confidence", "survived", "source_mismatch", "correct", "outcome", "expected_outcome", "false_accept", "false_reject"]


def threshold_outcomes(all_cases: DataFrame) -> DataFrame:
    """The outcome of each candidate case: its candidate goes through the confidence policy and the threshold."""
    c = all_cases.where("case.kind = 'candidate_threshold'").select("suite_id", "threshold", "case.case_id", "case.metric_key", "case.candidate", "case.expected")
    rows = c.select("suite_id", "threshold", "case_id", "metric_key", "expected", F.col("candidate.value").alias("value"), candidate_confidence(F.col("candidate")).alias("confidence"), F.coalesce("candidate.source", "candidate.match_type").alias("source"))
    return judged(rows).select(*OUTCOME)


def parse_outcomes(all_cases: DataFrame, extracted: DataFrame) -> DataFrame:
    """The outcome of each expectation of each parse case, against extracted (case_id, metric_key, value, confidence, source)."""
    e = all_cases.where("case.kind = 'parse'").select("suite_id", "threshold", "case.case_id", F.explode("case.expectations").alias("metric_key", "expected"))
    return judged(e.join(extracted, ["case_id", "metric_key"], "left")).select(*OUTCOME)


def merge_outcomes(all_cases: DataFrame) -> DataFrame:
    """The outcome of each merge case: which of a model's value and the fallback wins, and whether its source, override and
    reason are the expected ones."""
    c = lambda name: F.col(f"case.{name}")
    of_candidate = F.struct(c("fallback_candidate.value").alias("value"), candidate_confidence(c("fallback_candidate")).alias("confidence"), F.coalesce(c("fallback_candidate.source"), c("fallback_candidate.match_type")).alias("source"), F.lit(None).cast("string").alias("reason_code"), F.lit(False).alias("authoritative_override"))
    fallback = F.when(c("fallback_candidate").isNotNull(), of_candidate).otherwise(c("fallback_metadata"))
    m = all_cases.where("case.kind = 'merge'").select("suite_id", "threshold", c("case_id").alias("case_id"), c("metric_key").alias("metric_key"), c("expected").alias("expected"), c("llm_metadata").alias("llm"), fallback.alias("fallback"))
    override = F.coalesce(F.col("fallback.authoritative_override"), F.lit(False))
    weak = F.col("fallback.value").isNull() | (F.coalesce(F.col("fallback.confidence"), F.lit(0.0)) < F.col("threshold")) | (F.col("fallback.source") == "derived")
    sure = F.col("llm.value").isNotNull() & (F.col("llm.confidence") >= F.greatest(F.col("threshold"), F.lit(0.7)))
    wins = F.coalesce(sure & ~override & (weak | prefer_model(F.col("llm.value"), F.col("llm.confidence"), F.col("fallback.value"))), F.lit(False))
    out = m.withColumn("winner", F.when(wins, "llm").otherwise("fallback")).withColumn("chosen", F.when(wins, F.col("llm")).otherwise(F.col("fallback")))
    e = F.col("expected")
    differs = lambda want, got: F.coalesce(want.isNotNull() & ~got.eqNullSafe(want), F.lit(False))
    source, flag, reason = differs(e["expected_source"], F.col("chosen.source")), differs(e["authoritative_override"], F.col("chosen.authoritative_override")), differs(e["reason_code"], F.col("chosen.reason_code"))
    text = lambda first, s, o, r: F.concat_ws("|", first, s, F.concat(F.lit("authoritative_override="), F.initcap(o.cast("string"))), F.concat(F.lit("reason_code="), r))
    return out.select(
        "suite_id", "case_id", "metric_key", F.col("chosen.confidence").alias("confidence"), "winner", (~(source | flag | reason) & (F.col("winner") == e["winner"])).alias("correct"),
        text(F.col("winner"), F.col("chosen.source"), F.col("chosen.authoritative_override"), F.col("chosen.reason_code")).alias("outcome"),
        text(e["winner"], e["expected_source"], e["authoritative_override"], e["reason_code"]).alias("expected_outcome"), source.alias("source_mismatch"), flag.alias("override_mismatch"), reason.alias("reason_mismatch"),
    )
