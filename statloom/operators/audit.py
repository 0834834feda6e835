"""Confidence, provenance and reports: why a value was taken, and how sure it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the calibrated policy: baseline by kind of evidence, bonus by quality, penalties.
BASELINE = {
    "table_exact": 0.92, "table_code": 0.88, "table_section": 0.80, "text_code": 0.74, "text_exact": 0.68, "text_section": 0.66, "ocr_exact": 0.56, "ocr_code": 0.60,
    "ocr_section": 0.58, "table_keyword": 0.60, "text_keyword": 0.56, "derived": 0.35, "approximation": 0.20, "policy_override": 0.95,
}
BANDS = [(110, 0.05), (90, 0.03), (75, 0.0), (60, -0.06)]
LOWEST_BAND, STRUCTURE, GUARDRAIL, CONFLICT, CONFLICT_CAP = -0.10, 0.02, -0.10, -0.05, -0.15


def confidence(profile: Column, quality: Column, structural: Column, conflicts: Column, guarded: Column) -> Column:
    """Baseline and quality band, with a bonus for structure and penalties, from 0 to 1 with 6 digits."""
    base = F.element_at(F.create_map(*[F.lit(x) for pair in BASELINE.items() for x in pair]), profile)
    band = F.lit(LOWEST_BAND)
    for least, delta in reversed(BANDS):
        band = F.when(quality >= least, F.lit(delta)).otherwise(band)
    total = base + band + F.when(structural, STRUCTURE).otherwise(0.0) + F.greatest(F.lit(CONFLICT_CAP), conflicts * CONFLICT) + F.when(guarded, GUARDRAIL).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6)


def candidate_id(*parts: Column, value: Column) -> Column:
    return F.concat_ws("::", *parts, F.left(F.sha2(value.cast("string"), 256), F.lit(8)))


def outcomes(candidates: DataFrame, winners: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """candidates with outcome: winner, filtered_out (below the threshold) or loser."""
    best = winners.select(*keys, F.col("seq").alias("w_seq"))
    won = F.col("seq") == F.col("w_seq")
    return candidates.join(best, keys, "left").withColumn("outcome", F.when(won, "winner").when(F.col("confidence") < threshold, "filtered_out").otherwise("loser")).drop("w_seq")


def final_states(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, path: whether a metric was found, and the outcomes of its candidates in order."""
    has = F.max((F.col("outcome") == "winner").cast("int"))
    steps = F.array_sort(F.collect_list(F.struct("seq", "outcome")))
    return outcomes.groupBy(*keys).agg(F.when(has == 1, "resolved").otherwise("missing").alias("state"), F.array_join(F.transform(steps, lambda x: F.concat_ws(":", x["seq"].cast("string"), x["outcome"])), ">").alias("path"))


def complete(inputs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A row for every key and metric; what is missing is null, with confidence 0 and source derived."""
    every = inputs.select(*keys).distinct().withColumn("metric_key", F.explode(F.array(*map(F.lit, metrics))))
    out = every.join(inputs, [*keys, "metric_key"], "left")
    return out.select(*keys, "metric_key", "value", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("value").isNull(), "derived").otherwise("reported").alias("source"))


def slices(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_no, chunk: overlapping slices; the last one ends the text."""
    step = max(size - min(overlap, size - 1), 1)
    last = F.greatest(F.ceil((F.length("text") - size) / step), F.lit(0)).cast("int")
    each = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return each.select("doc_id", "chunk_no", F.substring("text", F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"))


def redacted(text: Column) -> Column:
    """Log text without the credentials in addresses and without values of secret fields."""
    text = F.regexp_replace(text, r"([a-z][a-z0-9+]*://)[^/@\s:]+:[^/@\s]+@", "$1***:***@")
    return F.regexp_replace(text, r"(?i)(password|token|api_key)=[^&\s]+", "$1=***")


def applied(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A stored table after a batch of changes (key, seq, status): the last change of a key wins, finished rows stay as
    they are, new keys are added. An upsert by rewriting: one join on the key."""
    last = changes.groupBy(key).agg(F.max_by("status", "seq").alias("new_status"))
    both = table.join(last, key, "full")
    frozen = F.coalesce(F.col("status").isin("completed", "failed", "cancelled"), F.lit(False))
    return both.withColumn("status", F.when(frozen, F.col("status")).otherwise(F.coalesce("new_status", "status"))).drop("new_status")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def metric_summary(metric: Column, state: Column, source: Column, match: Column, sure: Column) -> Column:
    """One sentence on how a metric came to its value."""
    chosen = F.concat(metric, F.lit(": selected from "), source, F.lit("/"), match, F.lit(" with confidence "), F.format_number(sure, 2))
    return F.when(state == "absent", F.concat(metric, F.lit(": no candidate selected"))).when(source.isNotNull(), chosen).otherwise(F.concat(metric, F.lit(": "), state))


def completeness(metadata: DataFrame, merges: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """key, is_complete, missing, summary for each document of metadata (key, metric_key, source). A trace is incomplete where
    a metric came from the model and there is no trace of the merge (merges: key, contributed, rejected as arrays)."""
    docs = metadata.groupBy(key).agg(F.bool_or(F.col("source") == "llm").alias("from_model"))
    merged = merges.groupBy(key).agg(F.sum(F.size("contributed")).alias("n_in"), F.sum(F.size("rejected")).alias("n_out"))
    over = overrides.groupBy(key).agg(F.count_distinct("metric_key").alias("n_over"))
    out = docs.join(merged, key, "left").join(over, key, "left")
    missing = F.array_compact(F.array(F.when(F.col("from_model") & F.col("n_in").isNull(), F.lit("llm_merge_trace"))))
    parts = F.array_compact(F.array(
        F.when(F.col("n_in").isNotNull(), F.concat(F.lit("LLM: "), "n_in", F.lit(" contributed, "), "n_out", F.lit(" rejected"))),
        F.when(F.col("n_over") > 0, F.concat(F.lit("Issuer overrides: "), "n_over", F.lit(" metrics"))),
    ))
    summary = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("No cross-cutting pipeline overrides applied")
    return out.select(key, (F.size(missing) == 0).alias("is_complete"), F.array_join(missing, ",").alias("missing"), summary.alias("summary"))


def shown_amount(v: Column) -> Column:
    """An amount as a context record shows it: two digits, or grouped and whole above 100."""
    return F.when(F.abs(v) > 100, F.format_number(v, 0)).otherwise(F.format_number(v, 2))


def context_record(metrics: Column, ratios: Column, risks: Column, factors: Column, most: int = 3) -> Column:
    """The context of a document as JSON: its metrics and ratios that are there, as shown, and its first risks and factors."""
    shown = lambda m: F.transform_values(F.map_filter(m, lambda _, v: v.isNotNull()), lambda _, v: shown_amount(v))
    return F.to_json(F.struct(shown(metrics).alias("metrics"), shown(ratios).alias("ratios"), F.slice(risks, 1, most).alias("risks"), F.slice(factors, 1, most).alias("key_factors")))
