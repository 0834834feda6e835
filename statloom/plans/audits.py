"""Queries over confidences, traces, reports and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import dims, words
from statloom.operators import audit, extraction, forms, periods, ratios, scoring, text
from statloom.plans import documents, operations, statements
from statloom.plans.statements import KEYS, LINKED, RATIO_ROWS, RISK, SCORED, SCORES, WIDE_SQL, WITH_FACTS, WITH_INPUTS
from statloom.sources.facts import analyses, read, statement_facts, statement_inputs

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


EVIDENCE = ["entity_id", "fy", "cls", "metric_key"]
CONFIDENCE = "c2 AS (SELECT *, CAST(round(least(1.0, greatest(0.0, CAST(CASE WHEN is_exact THEN CASE match_type WHEN 'table' THEN 0.92 ELSE 0.68 END ELSE CASE match_type WHEN 'table' THEN 0.60 ELSE 0.56 END END AS DOUBLE) + CAST(CASE WHEN quality >= 110 THEN 0.05 WHEN quality >= 90 THEN 0.03 WHEN quality >= 75 THEN 0.0 WHEN quality >= 60 THEN -0.06 ELSE -0.10 END AS DOUBLE) + CAST(CASE WHEN stage = 1 THEN 0.02 ELSE 0 END AS DOUBLE) + greatest(CAST(-0.15 AS DOUBLE), seq * CAST(-0.05 AS DOUBLE)) + CAST(CASE WHEN entity_id % 6 = 0 THEN -0.10 ELSE 0 END AS DOUBLE))), 6) AS DOUBLE) AS confidence FROM p)"


def with_confidence(spark, sf):
    c = documents.candidates(spark, sf)
    profile = F.concat_ws("_", "match_type", F.when(F.col("is_exact"), "exact").otherwise("keyword"))
    return c.withColumn("confidence", audit.confidence(profile, F.col("quality"), F.col("stage") == 1, F.col("seq"), F.col("entity_id") % 6 == 0))


@query(f"{documents.CANDIDATES}, {CONFIDENCE} SELECT entity_id, fy, cls, seq, confidence FROM c2")
def r5_confidence(spark, sf):
    return with_confidence(spark, sf).select("entity_id", "fy", "cls", "seq", "confidence")


KNOWN = [*dims.FACTS, "inventory", "ebitda", "ebit", "short_term_borrowings", "long_term_borrowings"]


@query(f"{WITH_INPUTS}, k AS (SELECT unnest([{', '.join(repr(k) for k in KNOWN)}]) AS metric_key), e AS (SELECT DISTINCT entity_id, period_label FROM facts) SELECT e.entity_id, e.period_label, k.metric_key, i.value, coalesce(i.confidence, CAST(0 AS DOUBLE)) AS confidence, CASE WHEN i.value IS NULL THEN 'derived' ELSE 'reported' END AS source FROM e CROSS JOIN k LEFT JOIN inputs i ON i.entity_id = e.entity_id AND i.period_label = e.period_label AND i.metric_key = k.metric_key")
def r6_complete_metadata(spark, sf):
    inputs = statement_inputs(statement_facts(spark, sf)).select(*KEYS, "metric_key", "value", "confidence")
    return audit.complete(inputs, KEYS, KNOWN)


#: What a row whose value is scaled may be called: the English labels, then the keywords, which name what those leave out.
SCALED = dict(words.LABELS)
for _metric, _keywords in words.KEYWORDS.items():
    for _keyword in _keywords:
        SCALED.setdefault(_keyword, _metric)
#: Every one of them with its place in the list: the first that a row's label has decides.
KEYED_LABELS = "labels_ AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(i, k.replace("'", "''"), m) for i, (k, m) in enumerate(SCALED.items())) + ") AS v(no, keyword, metric_key))"


@query(f"{documents.cells_sql()}, {KEYED_LABELS}, hit AS (SELECT doc, row_no, metric_key, v, row_number() OVER (PARTITION BY doc, row_no ORDER BY no) AS rn FROM cells JOIN labels_ ON contains(lower(label), keyword)) SELECT doc, metric_key, row_no, v * CASE WHEN CAST(right(doc, 4) AS INT) % 2 = 0 THEN 1e3 ELSE 1e6 END AS value FROM hit WHERE rn = 1 AND abs(v) >= 1000 AND NOT (v BETWEEN 1900 AND 2100)")
def r7_scaled_values(spark, sf):
    """Table values times the scale that the statement's text names. Every named row's value is scaled, of whatever quality."""
    scales = text.scale(documents.texts(spark, sf).where(F.col("doc").startswith("s")))
    hits = forms.labelled_values(documents.table_rows(spark, sf).withColumn("cells", F.slice("cells", 2, 9)), SCALED)
    return hits.join(scales, "doc").select("doc", "metric_key", "row_no", (F.col("value") * F.col("scale")).alias("value"))


@query(f"{WITH_INPUTS} SELECT entity_id, period_label, count(*) FILTER (confidence >= 0.7) AS n_reliable, count(value) AS n_found, count(*) FILTER (confidence IS NULL) AS n_unknown FROM inputs GROUP BY 1, 2")
def m9_reliability_counts(spark, sf):
    return statement_inputs(statement_facts(spark, sf)).groupBy(*KEYS).agg(F.count_if(F.col("confidence") >= 0.7).alias("n_reliable"), F.count("value").alias("n_found"), F.count_if(F.col("confidence").isNull()).alias("n_unknown"))


VALUE8 = "left(sha256(CAST(quality AS VARCHAR)), 8)"


@query(f"{documents.CANDIDATES} SELECT entity_id, fy, cls, seq, concat_ws('::', metric_key, match_type, CASE WHEN is_exact THEN 'exact' ELSE 'keyword' END, {VALUE8}) AS candidate_id FROM p")
def v1_candidate_ids(spark, sf):
    kind = F.when(F.col("is_exact"), "exact").otherwise("keyword")
    out = documents.candidates(spark, sf)
    return out.select("entity_id", "fy", "cls", "seq", audit.candidate_id(F.col("metric_key"), F.col("match_type"), kind, value=F.col("quality")).alias("candidate_id"))


OUTCOME = f"{documents.CANDIDATES}, {CONFIDENCE}, w AS (SELECT *, {documents.RANK} AS rn FROM c2), o AS (SELECT *, CASE WHEN rn = 1 THEN 'winner' WHEN confidence < 0.5 THEN 'filtered_out' ELSE 'loser' END AS outcome FROM w)"


def traced(spark, sf):
    c = with_confidence(spark, sf)
    return audit.outcomes(c, extraction.winners(c, EVIDENCE), EVIDENCE, 0.5)


@query(f"{OUTCOME} SELECT entity_id, fy, cls, seq, outcome FROM o")
def v2_candidate_outcomes(spark, sf):
    return traced(spark, sf).select("entity_id", "fy", "cls", "seq", "outcome")


@query(f"{OUTCOME} SELECT entity_id, fy, cls, metric_key, 'resolved' AS state, string_agg(seq || ':' || outcome, '>' ORDER BY seq) AS path FROM o GROUP BY 1, 2, 3, 4")
def v3_v4_final_states(spark, sf):
    return audit.final_states(traced(spark, sf), EVIDENCE)


@query(f"{LINKED}, {RATIO_ROWS}, x AS (SELECT * FROM ratios UNION ALL SELECT entity_id, period_label, metric_id, value, 'invalid', NULL, '' FROM ratios WHERE entity_id % 3 = 0), v AS (SELECT unnest(list_filter([CASE WHEN validity = 'valid' AND value IS NULL THEN 'valid_without_value' END, CASE WHEN validity <> 'valid' AND value IS NOT NULL THEN 'value_without_validity' END, CASE WHEN validity <> 'valid' AND reason IS NULL THEN 'refusal_without_reason' END, CASE WHEN validity = 'valid' AND reason IS NOT NULL THEN 'valid_with_primary_reason' END], lambda y: y IS NOT NULL)) AS violation, metric_id FROM x) SELECT metric_id, violation, count(*) AS n FROM v GROUP BY 1, 2")
def a26_emission_check(spark, sf):
    """The rules on ratios of which a third are broken on purpose."""
    out = statements.all_ratios(spark, sf, True)
    broken = out.where("entity_id % 3 = 0").withColumns({"validity": F.lit("invalid"), "reason": F.lit(None).cast("string")})
    found = ratios.emission_violations(out.unionByName(broken))
    return found.select("metric_id", F.explode("violations").alias("violation")).groupBy("metric_id", "violation").agg(F.count("*").alias("n"))


FACTOR = "CASE WHEN revenue IS NULL THEN 1.0 WHEN cls = 'Q1' THEN 4.0 WHEN cls = 'H1' THEN 2.0 ELSE 1.0 END"
ANNUAL = f"""{WITH_FACTS}, year_ AS (SELECT * REPLACE (revenue * CAST({FACTOR} AS DOUBLE) AS revenue, net_profit * CAST({FACTOR} AS DOUBLE) AS net_profit) FROM facts),
linked AS (SELECT f.*, o.total_assets AS opening_total_assets, o.equity AS opening_equity FROM year_ f LEFT JOIN facts o ON o.entity_id = f.entity_id AND o.cls = 'FY' AND o.fy = f.fy - 1)"""


@query(f"{ANNUAL}, {RATIO_ROWS}, {WIDE_SQL}, {SCORES} SELECT entity_id, period_label, score, confidence_score, {RISK.format('raw_score')} AS risk_level FROM sc")
def k13_k14_annualised_scores(spark, sf):
    """Flows of quarters and half years on a yearly basis, then ratios and score."""
    facts = statement_facts(spark, sf)
    facts = scoring.annualised(facts.withColumn("period_basis", scoring.period_basis(F.col("period_label"), F.col("revenue"))))
    wide = ratios.wide(ratios.all_ratios(periods.linked(periods.parsed(facts)), KEYS), KEYS)
    return scoring.scored(wide).select(*KEYS, "score", "confidence_score", "risk_level")


IMPACTS = ", ".join(f"CASE WHEN s_{r[0]} >= 0.65 THEN '{r[0]}' END" for r in dims.SCORING)


@query(f"{SCORED} SELECT entity_id, period_label, array_to_string(list_sort(list_filter([{IMPACTS}], lambda x: x IS NOT NULL)), ',') AS strengths FROM sc WHERE greatest({', '.join(f'coalesce(s_{r[0]}, -1)' for r in dims.SCORING)}) >= 0.65")
def k16_strengths(spark, sf):
    good = scoring.factors(ratios.wide(statements.all_ratios(spark, sf, True), KEYS), KEYS).where("impact = 'positive'")
    return good.groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_list("ratio")), ",").alias("strengths"))


@query(f"{LINKED}, {RATIO_ROWS} SELECT metric_id, CASE WHEN value >= 1 THEN 'good' WHEN value > 0 THEN 'bad' ELSE 'none' END AS class, count(*) AS n FROM ratios WHERE value IS NOT NULL AND value <> 0 GROUP BY 1, 2")
def p15_display_classes(spark, sf):
    out = statements.all_ratios(spark, sf, True).where("value IS NOT NULL AND value <> 0")
    return out.groupBy("metric_id", F.when(F.col("value") >= 1, "good").when(F.col("value") > 0, "bad").otherwise("none").alias("class")).agg(F.count("*").alias("n"))


@query(f"{documents.cells_sql()}, {documents.LABELS_SQL}, hit AS (SELECT doc, metric_key, v, 1 AS rn FROM cells JOIN labels_ ON labels_.label = cells.label), m AS (SELECT doc, max(v) AS got FROM hit WHERE rn = 1 AND metric_key = 'total_assets' AND abs(v) >= 1000 AND NOT (v BETWEEN 1900 AND 2100) GROUP BY doc), x AS (SELECT 's' || entity_id || '-' || period_label AS doc, total_assets / 1000 * CASE WHEN entity_id % 5 = 0 THEN 1.2 ELSE 1 END AS want FROM facts) SELECT x.doc, abs(got - want) <= greatest(1.0, abs(want) * 0.01) AS ok FROM x JOIN m ON m.doc = x.doc")
def e11_acceptance(spark, sf):
    """Extracted values against expected ones, of which a fifth are wrong on purpose."""
    wrong = F.when(F.col("entity_id") % 5 == 0, 1.2).otherwise(1.0)
    want = statement_facts(spark, sf).select(F.concat(F.lit("s"), "entity_id", F.lit("-"), "period_label").alias("doc"), (F.col("total_assets") / 1000 * wrong).alias("want"))
    got = forms.by_english_label(documents.table_rows(spark, sf).withColumn("cells", F.slice("cells", 2, 9))).where("metric_key = 'total_assets'").groupBy("doc").agg(F.max("value").alias("got"))
    return want.join(got, "doc").select("doc", (F.abs(F.col("got") - F.col("want")) <= F.greatest(F.lit(1.0), F.abs("want") * 0.01)).alias("ok"))


VOCABULARY = sorted({*words.LABELS.values(), *words.CODES.values()})


@query(f"{documents.cells_sql()}, {documents.CODES_SQL} SELECT unnest([{', '.join(repr(k) for k in VOCABULARY)}]) AS metric_key EXCEPT SELECT metric_key FROM cells JOIN codes ON codes.code = cells.code WHERE v >= 1000")
def e12_uncovered_metrics(spark, sf):
    """The vocabulary less what line codes find in the corpus."""
    found = extraction.by_code(documents.table_rows(spark, sf)).where("value >= 1000").select("metric_key")
    return spark.createDataFrame([(k,) for k in VOCABULARY], "metric_key string").exceptAll(found.distinct())


@query(f"{operations.EVENTS}, d AS (SELECT CASE status WHEN 'failed' THEN 'value' WHEN 'completed' THEN 'source' ELSE 'other' END AS kind, task_id % 3 AS suite FROM e) SELECT suite, kind, count(*) AS n FROM d GROUP BY GROUPING SETS ((suite, kind), (kind))")
def e13_diagnostics(spark, sf):
    e = operations.events(spark, sf)
    kind = F.when(F.col("status") == "failed", "value").when(F.col("status") == "completed", "source").otherwise("other")
    d = e.select(kind.alias("kind"), (F.col("task_id") % 3).alias("suite"))
    return d.groupingSets([("suite", "kind"), ("kind",)], "suite", "kind").agg(F.count("*").alias("n"))


@query(f"{operations.STORED} SELECT task_id, status = 'processing' AND task_id % 7 = 0 AS pending FROM a")
def h3_cancellation_pending(spark, sf):
    return analyses(spark, sf).select("task_id", ((F.col("status") == "processing") & (F.col("task_id") % 7 == 0)).alias("pending"))


@query("SELECT o_orderkey AS task_id, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice, 2) END, o_custkey) AS score, CASE WHEN o_orderkey % 2 = 0 THEN 'trace-' || o_orderkey ELSE 'data-' || o_orderkey END AS trace FROM orders")
def h9_h14_payload_fallbacks(spark, sf):
    """A stored scalar before the payload's value, and a trace that stands at one of two places of the payload."""
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    one = F.to_json(F.struct(F.col("o_custkey").alias("score"), F.concat(F.lit("trace-"), k).alias("decision_trace")))
    two = F.to_json(F.struct(F.col("o_custkey").alias("score"), F.struct(F.concat(F.lit("data-"), k).alias("decision_trace")).alias("data")))
    rows = o.select(k.alias("task_id"), F.when(k % 3 != 0, F.round("o_totalprice", 2)).alias("stored"), F.when(k % 2 == 0, one).otherwise(two).alias("result"))
    score = F.coalesce("stored", F.get_json_object("result", "$.score").cast("double"))
    return rows.select("task_id", score.alias("score"), F.coalesce(F.get_json_object("result", "$.decision_trace"), F.get_json_object("result", "$.data.decision_trace")).alias("trace"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'connect postgresql://***:***@db/x as ' || user_id ELSE 'call token=***&id=' || user_id END AS line FROM events")
def h10_redacted_logs(spark, sf):
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("connect postgresql://u"), "user_id", F.lit(":pw@db/x as "), "user_id")).otherwise(F.concat(F.lit("call token=t"), "event_id", F.lit("&id="), "user_id"))
    return read(spark, sf, "events").select("event_id", audit.redacted(line).alias("line"))


@query(f"{operations.STORED} SELECT task_id FROM a WHERE task_id IN (SELECT user_id FROM events)")
def h12_visible_tasks(spark, sf):
    return analyses(spark, sf).select("task_id").join(read(spark, sf, "events").select(F.col("user_id").alias("task_id")), "task_id", "left_semi")


@query(f"{operations.STORED}, c AS (SELECT user_id * 2 AS task_id, arg_max(CASE event_type {operations.CASES} END, event_id) AS new_status FROM events GROUP BY 1) SELECT coalesce(a.task_id, c.task_id) AS task_id, CASE WHEN a.status IN ('completed', 'failed', 'cancelled') THEN a.status ELSE coalesce(c.new_status, a.status) END AS status FROM a FULL JOIN c ON c.task_id = a.task_id")
def h13_applied_changes(spark, sf):
    changes = operations.events(spark, sf).select((F.col("task_id") * 2).alias("task_id"), F.col("event_id").alias("seq"), "status")
    return audit.applied(analyses(spark, sf).select("task_id", "status"), changes, "task_id")


@query("WITH d AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 1000) / 800.0), 0) AS INT) + 1)) AS chunk_no FROM documents WHERE length(text) > 0) SELECT doc_id, chunk_no, md5(substring(text, chunk_no * 800 + 1, 1000)) AS chunk FROM d")
def t16_slices(spark, sf):
    return audit.slices(read(spark, sf, "documents"), 1000, 200).withColumn("chunk", F.md5("chunk"))


@query(r"WITH p AS (SELECT page_id, split_part(url, '/', 3) AS host, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 3) SELECT host, sum(length(t)) AS n_chars, sum(length(t)) < 50 AS needs_ocr FROM f GROUP BY host")
def t5_thin_text(spark, sf):
    """Whether the first three pages of a host have so little text that they need character recognition."""
    from pyspark.sql import Window

    bare = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    p = read(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), bare.alias("t"))
    first = p.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).where("k <= 3")
    return first.groupBy("host").agg(F.sum(F.length("t")).alias("n_chars"), (F.sum(F.length("t")) < 50).alias("needs_ocr"))


PATTERN = r"(?i){0}\s+(-?[0-9][0-9,]*)"


@query(f"WITH {documents.TEXTS}, k AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in words.PRINTED.items()) + r") AS v(metric_key, label)), h AS (SELECT doc, metric_key, regexp_extract(text, '(?i)' || label || '\s+(-?[0-9][0-9,]*)', 1) AS raw FROM texts, k) SELECT doc, metric_key, CAST(replace(raw, ',', '') AS DOUBLE) AS value FROM h WHERE raw <> '' AND abs(CAST(replace(raw, ',', '') AS DOUBLE)) >= 1000")
def x10_regex_extraction(spark, sf):
    """The amount after a fact's printed name, for each of a fixed list of names within the row."""
    each = [F.struct(F.lit(k).alias("metric_key"), F.regexp_extract("text", PATTERN.format(label), 1).alias("raw")) for k, label in words.PRINTED.items()]
    found = documents.texts(spark, sf).select("doc", F.explode(F.array(*each)).alias("x")).where("x.raw <> ''")
    out = found.select("doc", "x.metric_key", F.replace("x.raw", F.lit(","), F.lit("")).cast("double").alias("value"))
    return out.where(F.abs("value") >= 1000)
