"""Queries over calibration suites, stored results, exports, traces and tables. Suites are JSON made of customers, a suite for each
nation, in parts of a bounded number of cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import words
from statloom.operators import audit, calibration, forms
from statloom.plans.documents import any_of
from statloom.plans.statements import KEYS, WITH_FACTS
from statloom.sources import stored
from statloom.sources.facts import read, statement_facts

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


# --- suites ---------------------------------------------------------------------------------------------------------

CASES = """SELECT c_nationkey AS n, c_custkey AS c, 'n' || c_nationkey AS file, 's' || c_nationkey AS suite, CASE WHEN c_nationkey % 7 = 0 THEN 'slow' WHEN c_nationkey % 2 = 0 THEN 'fast' ELSE 'gated' END AS tier, CASE WHEN c_nationkey = 3 THEN 3 ELSE 2 END AS version,
 CASE WHEN c_custkey % 19 = 0 THEN 'twin' ELSE 'c' || c_custkey END AS case_id, CASE c_custkey % 3 WHEN 0 THEN 'candidate_threshold' WHEN 1 THEN 'parse' ELSE CASE WHEN c_custkey % 10 = 0 THEN 'other' ELSE 'merge' END END AS kind,
 CASE WHEN c_custkey % 11 = 0 THEN 'nowhere' ELSE 'threshold_boundary' END AS surface, CASE WHEN c_custkey % 7 = 0 THEN 'odd' ELSE 'ocr_fragile' END AS tag, CASE WHEN c_custkey % 13 = 0 THEN 'dream' WHEN c_custkey % 2 = 0 THEN 'text_only' END AS mode, CASE WHEN c_custkey % 17 = 0 THEN 'else' END AS own,
 floor(c_acctbal * 100) + 1000000 AS v, c_custkey % 2 = 0 AS survives, CASE c_custkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'text' END AS want_source, CASE c_custkey % 5 WHEN 0 THEN 'critical' ELSE 'advisory' END AS strict, CAST(CASE c_custkey % 6 WHEN 0 THEN 120 WHEN 3 THEN 30 ELSE 60 END AS INT) AS quality,
 c_custkey % 9 = 0 AS exact, CASE WHEN c_custkey % 8 < 5 THEN 'table' ELSE 'text' END AS match, CAST(CASE WHEN c_custkey % 6 = 5 THEN 0.9 ELSE 0.6 END AS DOUBLE) AS sure, CASE WHEN c_custkey % 12 = 11 THEN NULL WHEN c_custkey % 4 = 1 THEN 1 ELSE 50 END AS times FROM {customer}"""


#: A part of a suite holds the cases of so many customer keys at most.
PART = 5_000


def suites(spark, sf):
    x = spark.sql(CASES, customer=read(spark, sf, "customer"))
    expected = F.struct(F.col("survives"), (F.col("v") + F.when(F.col("c") % 10 == 0, 5).otherwise(0)).alias("value"), F.lit(1.0).alias("tolerance"), F.col("want_source").alias("expected_source"), F.col("strict").alias("source_strictness"), F.when(F.col("kind") == "merge", F.when(F.col("c") % 4 == 1, "fallback").otherwise("llm")).alias("winner"))
    candidate = F.struct(F.col("v").alias("value"), F.col("match").alias("match_type"), F.col("exact").alias("is_exact"), F.col("quality").alias("candidate_quality"))
    metadata = lambda value, sure, source: F.struct(value.alias("value"), sure.alias("confidence"), F.lit(source).alias("source"))
    case = F.struct(
        "case_id", "kind", F.col("own").alias("suite_id"), F.col("surface").alias("decision_surface"), F.array("tag").alias("risk_tags"), F.col("mode").alias("pipeline_mode"), F.lit("revenue").alias("metric_key"),
        F.when(F.col("kind") == "candidate_threshold", candidate).alias("candidate"), F.when(F.col("kind") != "parse", expected).alias("expected"),
        F.when((F.col("kind") == "parse") & (F.col("c") % 5 != 1), F.create_map(F.lit("revenue"), expected, F.lit("equity"), expected)).alias("expectations"),
        F.when(F.col("kind") == "merge", metadata(F.col("v"), F.col("sure"), "llm")).alias("llm_metadata"), F.when((F.col("kind") == "merge") & F.col("times").isNotNull(), metadata(F.col("v") * F.col("times"), F.lit(0.8), "table")).alias("fallback_metadata"),
    )
    part = F.floor(F.col("c") / PART)
    grouped = x.groupBy("n", "file", "suite", "tier", "version", part.alias("part")).agg(F.collect_list(case).alias("cases"))
    text = F.to_json(F.struct("version", F.col("suite").alias("suite_id"), F.col("tier").alias("suite_tier"), F.when(F.col("n") == 5, 0.55).otherwise(0.5).alias("threshold"), "cases"))
    broken = F.when(F.col("n") == 9, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return calibration.read_suites(grouped.select("file", broken.alias("text")))


GOOD = f"x AS ({CASES.format(customer='customer')}), g AS (SELECT *, CASE WHEN n = 5 THEN 0.55 ELSE 0.5 END AS threshold FROM x WHERE n <> 9)"


@query(f"""WITH {GOOD}, f AS (SELECT DISTINCT file, n, tier FROM x)
SELECT file, CAST(NULL AS VARCHAR) AS case_id, 'no_object' AS violation FROM f WHERE n = 9 UNION ALL SELECT file, NULL, 'suite_tier' FROM f WHERE tier = 'slow' AND n <> 9 UNION ALL SELECT file, NULL, unnest(['versions_differ', 'thresholds_differ']) FROM f WHERE n <> 9
UNION ALL SELECT file, case_id, 'decision_surface' FROM g WHERE surface = 'nowhere' UNION ALL SELECT file, case_id, 'risk_tags' FROM g WHERE tag = 'odd' UNION ALL SELECT file, case_id, 'pipeline_mode' FROM g WHERE mode = 'dream'
UNION ALL SELECT file, case_id, 'suite_id' FROM g WHERE own = 'else' UNION ALL SELECT file, case_id, 'kind' FROM g WHERE kind = 'other' UNION ALL SELECT file, case_id, 'no_expectation' FROM g WHERE kind = 'parse' AND c % 5 = 1
UNION ALL SELECT file, case_id, 'no_fallback' FROM g WHERE kind = 'merge' AND times IS NULL UNION ALL SELECT min(file), case_id, 'case_id_repeated' FROM g GROUP BY case_id HAVING count(*) > 1""")
def s5_suite_violations(spark, sf):
    """Every rule that suites and their cases break, files that are no objects among them."""
    return calibration.violations(suites(spark, sf))


JUDGED = """j AS (SELECT *, value IS NOT NULL AND confidence >= threshold AS survived, v + CASE WHEN c % 10 = 0 THEN 5 ELSE 0 END AS want FROM r),
k AS (SELECT *, survived AND want_source IS NOT NULL AND source <> want_source AS source_mismatch FROM j)
SELECT suite AS suite_id, case_id, metric_key, confidence, survived, source_mismatch, survived = survives AND (NOT survived OR abs(value - want) <= 1) AND NOT (strict = 'critical' AND source_mismatch) AS correct,
 CASE WHEN survived THEN 'survive:' || source ELSE 'absent' END AS outcome, CASE WHEN survives AND want_source IS NOT NULL THEN 'survive:' || want_source WHEN survives THEN 'survive' ELSE 'absent' END AS expected_outcome, NOT survives AND survived AS false_accept, survives AND NOT survived AS false_reject FROM k"""


@query(f"""WITH {GOOD}, r AS (SELECT *, 'revenue' AS metric_key, v AS value, match AS source, CAST(round(CASE WHEN match = 'table' THEN CASE WHEN exact THEN 0.92 ELSE 0.6 END ELSE CASE WHEN exact THEN 0.68 ELSE 0.56 END END + CASE quality WHEN 120 THEN 0.05 WHEN 60 THEN -0.06 ELSE -0.1 END, 6) AS DOUBLE) AS confidence FROM g WHERE kind = 'candidate_threshold'), {JUDGED}""")
def e1_threshold_outcomes(spark, sf):
    return calibration.threshold_outcomes(calibration.cases(suites(spark, sf)))


@query(f"""WITH {GOOD}, r AS (SELECT g.*, m.metric_key, CASE WHEN m.metric_key = 'revenue' THEN CAST(v AS DOUBLE) WHEN c % 4 = 0 THEN v + 10 END AS value, CASE WHEN m.metric_key = 'revenue' OR c % 4 = 0 THEN CASE WHEN c % 3 = 1 AND c % 8 = 4 THEN 0.4 ELSE 0.8 END END AS confidence, CASE WHEN m.metric_key = 'revenue' THEN 'table' WHEN c % 4 = 0 THEN 'text' END AS source
 FROM g, (VALUES ('revenue'), ('equity')) AS m(metric_key) WHERE kind = 'parse' AND c % 5 <> 1 AND case_id <> 'twin'), {JUDGED}""")
def e2_parse_outcomes(spark, sf):
    """Expectations of parse cases against extracted metrics: revenue for every case, equity for every fourth."""
    x = spark.sql(CASES, customer=read(spark, sf, "customer")).where("case_id <> 'twin'")
    low = F.when(F.col("c") % 8 == 4, 0.4).otherwise(0.8)
    row = lambda m, v, s: x.select("case_id", F.lit(m).alias("metric_key"), v.cast("double").alias("value"), low.alias("confidence"), F.lit(s).alias("source"), "c")
    extracted = row("revenue", F.col("v"), "table").unionByName(row("equity", F.col("v") + 10, "text").where("c % 4 = 0")).drop("c")
    return calibration.parse_outcomes(calibration.cases(suites(spark, sf)).where("case.case_id <> 'twin'"), extracted)


@query(f"""WITH {GOOD}, w AS (SELECT *, sure >= 0.7 AND (times IS NULL OR times < 10) AS wins, CASE WHEN c % 4 = 1 THEN 'fallback' ELSE 'llm' END AS want FROM g WHERE kind = 'merge'),
h AS (SELECT *, CASE WHEN wins THEN 'llm' WHEN times IS NOT NULL THEN 'table' END AS source, CASE WHEN wins THEN 'llm' ELSE 'fallback' END AS winner FROM w), s AS (SELECT *, want_source IS NOT NULL AND source IS DISTINCT FROM want_source AS source_mismatch FROM h)
SELECT suite AS suite_id, case_id, 'revenue' AS metric_key, CAST(CASE WHEN wins THEN sure WHEN times IS NOT NULL THEN 0.8 END AS DOUBLE) AS confidence, winner, winner = want AND NOT source_mismatch AS correct, concat_ws('|', winner, source) AS outcome, concat_ws('|', want, want_source) AS expected_outcome, source_mismatch, false AS override_mismatch, false AS reason_mismatch FROM s""")
def e3_merge_outcomes(spark, sf):
    """Merge cases: sure and unsure model values against missing, near and far fallbacks."""
    return calibration.merge_outcomes(calibration.cases(suites(spark, sf)))


# --- stored results and exports -------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'completed' ELSE 'processing' END AS status, 'f' || o_orderkey || '.pdf' AS filename, 5000 AS n_chars, 10 AS n_tables, CAST(floor(o_totalprice) AS BIGINT) AS revenue FROM orders""")
def s6_stored_results(spark, sf):
    """Results written by key: all orders, then every third again, twice; a run that is repeated leaves the same rows."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    path = stored.folder(spark, "results")

    def batch(version, status):
        made = o.select(
            F.col("o_orderkey").alias("task_id"), F.lit(version).alias("version"), F.lit(status).alias("status"), F.concat(F.lit("f"), "o_orderkey", F.lit(".pdf")).alias("filename"), F.lit(False).alias("scanned"), F.repeat(F.lit("x"), F.lit(6000)).alias("text"),
            F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("tables"), F.struct(F.floor("o_totalprice").alias("revenue")).alias("metrics"), F.lit(None).cast("map<string,double>").alias("ratios"), F.lit(1.5).alias("score"),
        )
        return made.select("task_id", "version", "status", stored.payload().alias("result"))

    stored.upsert(spark, batch(1, "processing"), path, "task_id", "version")
    for _ in range(2):
        stored.upsert(spark, batch(2, "completed").where("task_id % 3 = 0"), path, "task_id", "version")
    held = F.from_json("result", "filename string, data struct<text: string, tables: array<string>, metrics: struct<revenue: bigint>>")  # read once
    rows = spark.read.parquet(path).select("task_id", "version", "status", held.alias("held"))
    return rows.select("task_id", "version", "status", "held.filename", F.length("held.data.text").alias("n_chars"), F.size("held.data.tables").alias("n_tables"), F.col("held.data.metrics.revenue").alias("revenue"))


@query("SELECT row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_custkey, o_orderkey) - 1 AS place, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS section_no, o_custkey, o_orderkey, 'order ' || o_orderkey AS body FROM orders")
def s12_ordered_export(spark, sf):
    """A report in sections, written as JSON by ranges and read back in its order."""
    no = F.expr("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END")
    rows = read(spark, sf, "orders").select(no.alias("section_no"), "o_custkey", "o_orderkey", F.concat(F.lit("order "), "o_orderkey").alias("body"))
    path = stored.folder(spark, "export")
    stored.export(rows, path, ["o_custkey", "o_orderkey"])
    return stored.read_export(spark, path, "section_no int, o_custkey long, o_orderkey long, body string").select("place", "section_no", "o_custkey", "o_orderkey", "body")


# --- traces and contexts --------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'llm' ELSE 'table' END AS source FROM orders), d AS (SELECT doc, bool_or(source = 'llm') AS m FROM o GROUP BY doc),
g AS (SELECT doc, count(*) FILTER (k % 2 = 0) AS a, count(*) FILTER (k % 2 = 1) AS b FROM o WHERE doc % 3 = 0 GROUP BY doc), v AS (SELECT doc, count(DISTINCT k % 4) AS n FROM o WHERE doc % 4 = 0 GROUP BY doc)
SELECT d.doc, NOT (m AND a IS NULL) AS is_complete, CASE WHEN m AND a IS NULL THEN 'llm_merge_trace' ELSE '' END AS missing, coalesce(nullif(concat_ws('; ', 'LLM: ' || a || ' contributed, ' || b || ' rejected', 'Issuer overrides: ' || n || ' metrics'), ''), 'No cross-cutting pipeline overrides applied') AS summary FROM d LEFT JOIN g USING (doc) LEFT JOIN v USING (doc)""")
def v5_trace_completeness(spark, sf):
    """Whether traces are complete, and what went over the whole document, in words."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "llm").otherwise("table").alias("source"))
    one = F.array(F.col("k").cast("string"))
    none = F.array().cast("array<string>")
    merges = o.where("doc % 3 = 0").select("doc", F.when(F.col("k") % 2 == 0, one).otherwise(none).alias("contributed"), F.when(F.col("k") % 2 == 1, one).otherwise(none).alias("rejected"))
    overrides = o.where("doc % 4 = 0").select("doc", (F.col("k") % 4).alias("metric_key"))
    return audit.completeness(o.select("doc", F.col("k").alias("metric_key"), "source"), merges, overrides, "doc")


@query("SELECT o_orderkey AS doc, CASE o_orderkey % 3 WHEN 0 THEN 'm' || o_orderkey || ': no candidate selected' WHEN 1 THEN 'm' || o_orderkey || ': selected from table/exact with confidence ' || format('{:.2f}', CAST(o_orderkey % 100 AS DOUBLE) / 100) ELSE 'm' || o_orderkey || ': invalidated' END AS summary FROM orders")
def v5_metric_summaries(spark, sf):
    k = F.col("o_orderkey") % 3
    state = F.when(k == 0, "absent").when(k == 1, "selected").otherwise("invalidated")
    source, match = F.when(k == 1, "table"), F.when(k == 1, "exact")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), audit.metric_summary(F.concat(F.lit("m"), "o_orderkey"), state, source, match, F.col("o_orderkey") % 100 / 100).alias("summary"))


SHOWN = "CASE WHEN abs({0}) > 100 THEN format('{{:,.0f}}', {0}) ELSE format('{{:.2f}}', {0}) END"


@query(f"{WITH_FACTS}, r AS (SELECT *, total_assets / 3 AS small, equity / nullif(total_assets, 0) AS share FROM facts) SELECT entity_id, period_label, {SHOWN.format('small')} AS assets, CASE WHEN revenue IS NOT NULL THEN {SHOWN.format('CAST(floor(revenue) AS DOUBLE)')} END AS revenue, {SHOWN.format('share')} AS share, '[\"a\",\"b\",\"' || period_label || '\"]' AS risks, '[]' AS factors FROM r")
def t18_context_records(spark, sf):
    """Context records of statements: amounts as shown, nulls left out, the first three risks."""
    f = statement_facts(spark, sf)
    metrics = F.create_map(F.lit("assets"), F.col("total_assets") / 3, F.lit("revenue"), F.floor("revenue").cast("double"))
    ratios = F.create_map(F.lit("share"), F.col("equity") / F.nullif(F.col("total_assets"), F.lit(0.0)))
    made = f.select(*KEYS, audit.context_record(metrics, ratios, F.array(F.lit("a"), F.lit("b"), "period_label", F.lit("d")), F.array().cast("array<string>")).alias("x"))
    at = lambda p: F.get_json_object("x", p)
    return made.select(*KEYS, at("$.metrics.assets").alias("assets"), at("$.metrics.revenue").alias("revenue"), at("$.ratios.share").alias("share"), at("$.risks").alias("risks"), at("$.key_factors").alias("factors"))


# --- tables ---------------------------------------------------------------------------------------------------------

TABLE = """CAST(o_custkey AS BIGINT) AS doc, o_orderkey AS table_no, CASE o_orderkey % 5 WHEN 0 THEN 'Содержание' WHEN 1 THEN 'Balance' WHEN 2 THEN 'Notes to equity' ELSE 'List' END AS title, CASE o_orderkey % 4 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'Total assets' WHEN 2 THEN 'Something' ELSE 'Net income' END AS label,
 CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) + 100000 AS STRING) END AS amount, CAST(o_orderkey % 7 AS INT) AS more"""


def order_tables(spark, sf):
    """A title, a row with an amount, and rows of large numbers for each order; a customer's orders are a document's tables."""
    rows = spark.sql(f"SELECT {TABLE} FROM {{orders}}", orders=read(spark, sf, "orders"))
    cells = F.concat(F.array(F.array("title"), F.array(F.col("label"), F.lit("12"), F.col("amount"))), F.slice(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.array(F.lit("x"), F.concat(i.cast("string"), F.lit("00 000")))), F.lit(1), F.col("more")))
    return rows.select("doc", "table_no", F.posexplode(cells).alias("row_no", "cells"))


SIGNALS = f"""WITH t AS (SELECT {TABLE} FROM orders), w AS (SELECT *, lower(title) AS a, lower(label || ' 12 ' || amount) AS b FROM t),
s AS (SELECT doc, table_no, more + 2 AS n_rows, len(list_filter([{', '.join(f"'{x}'" for x in words.TABLE_WORDS)}], lambda p: contains(a, p) OR contains(b, p))) AS n, more + CASE WHEN amount <> '-' THEN 1 ELSE 0 END AS n_large,
 CASE WHEN label IN ('Revenue', 'Total assets', 'Net income') AND amount <> '-' THEN 1 ELSE 0 END AS statement_rows, CASE WHEN label IN ('Revenue', 'Total assets', 'Net income') THEN 1 ELSE 0 END - CASE WHEN {any_of('a', words.TABLE_NOISE)} THEN 1 ELSE 0 END AS keyword_rows, more + CASE WHEN amount <> '-' THEN 1 ELSE 0 END AS numeric_rows FROM w)"""


@query(f"{SIGNALS} SELECT doc, table_no, n_rows, n >= 1 OR n_large >= 5 AS financial, statement_rows, keyword_rows, numeric_rows FROM s")
def s3_table_signals(spark, sf):
    return forms.table_signals(order_tables(spark, sf))


@query(f"{SIGNALS}, r AS (SELECT *, count(*) OVER (PARTITION BY doc) AS of, row_number() OVER (PARTITION BY doc ORDER BY statement_rows DESC, keyword_rows DESC, numeric_rows DESC, n_rows DESC, table_no) AS place FROM s) SELECT doc, table_no, statement_rows, keyword_rows, numeric_rows FROM r WHERE of <= 20 OR place <= 10")
def s4_ten_best_tables(spark, sf):
    """Of more than twenty tables the ten best by what is in their rows."""
    return forms.best_tables(forms.table_signals(order_tables(spark, sf))).select("doc", "table_no", "statement_rows", "keyword_rows", "numeric_rows")
