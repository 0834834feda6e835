"""Queries over the bases of ratios, and tables and lists that come as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import dims
from statloom.operators import basis, extraction, periods, ratios
from statloom.plans import documents
from statloom.plans.statements import KEYS, LINKED, WITH_FACTS
from statloom.sources.facts import read, statement_facts

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


@query(f"{LINKED}, c AS (SELECT entity_id, period_label, 'opening' AS kind, opening_total_assets AS value FROM linked UNION ALL SELECT entity_id, period_label, 'closing', total_assets FROM linked UNION ALL SELECT entity_id, period_label, 'synthetic', (opening_total_assets + total_assets) / 2 FROM linked) SELECT *, CASE WHEN value IS NULL THEN 'missing' ELSE 'ready' END AS state FROM c")
def a6_average_candidates(spark, sf):
    return basis.average_candidates(periods.linked(periods.parsed(statement_facts(spark, sf))), KEYS, "total_assets")


LEASE, BORROWED, OWED = "CASE WHEN entity_id % 5 = 0 THEN 1.0 END", "CASE WHEN entity_id % 2 = 0 THEN liabilities END", "CASE WHEN fy % 2 = 0 THEN liabilities END"


@query(f"{WITH_FACTS}, b AS (SELECT entity_id, period_label, {LEASE} AS lease, {BORROWED} AS debt, {OWED} AS owed FROM facts) SELECT entity_id, period_label, CASE WHEN lease IS NOT NULL THEN 'MATH_DEBT_LEASE_LIABILITY_MIXING_FORBIDDEN' WHEN debt IS NOT NULL AND owed IS NOT NULL THEN 'MATH_DEBT_MIXED_BASIS' WHEN debt IS NOT NULL THEN 'resolved' WHEN owed IS NOT NULL THEN 'MATH_INVALID_BASIS' ELSE 'MATH_RESOLVER_NO_CANDIDATE' END AS debt_only FROM b")
def a9_debt_basis(spark, sf):
    return statement_facts(spark, sf).select(*KEYS, basis.debt_basis(F.expr(LEASE), F.expr(BORROWED), F.expr(OWED), "debt_only").alias("debt_only"))


@query(f"{WITH_FACTS} SELECT entity_id, period_label, CASE WHEN short_term_liabilities <> 0 THEN round_even(net_profit / nullif(short_term_liabilities, 0), 4) END AS value, CASE WHEN short_term_liabilities IS NULL THEN 'MATH_DENOMINATOR_INPUT_MISSING' WHEN short_term_liabilities = 0 THEN 'MATH_DENOMINATOR_POLICY_REFUSED' END AS reason FROM facts")
def a21_any_non_zero(spark, sf):
    """The ratio whose denominator may be negative."""
    n, d = F.col("net_profit"), F.col("short_term_liabilities")
    reason = ratios.denominator_reason(d, "any_non_zero")
    return statement_facts(spark, sf).select(*KEYS, ratios.canonical(F.when(reason.isNull(), ratios.guarded_ratio(n, d)[0])).alias("value"), reason.alias("reason"))


@query(f"{WITH_FACTS}, p AS (SELECT *, liabilities * 0.4 AS l, liabilities * CASE WHEN entity_id % 3 = 0 THEN 0.1 ELSE 0.6 END AS s FROM facts) SELECT entity_id, period_label, CASE WHEN l + s >= 0.02 * total_assets AND abs(l + s - (total_assets - equity)) <= greatest(1000.0, 0.05 * abs(total_assets - equity)) THEN round(l + s, 2) END AS liabilities FROM p")
def d1_liabilities_from_parts(spark, sf):
    owed = F.col("liabilities")
    total = basis.liabilities_from_parts(owed * 0.4, owed * F.when(F.col("entity_id") % 3 == 0, 0.1).otherwise(0.6), F.col("total_assets"), F.col("equity"))
    return statement_facts(spark, sf).select(*KEYS, F.round(total, 2).alias("liabilities"))


@query(f"{WITH_FACTS}, p AS (SELECT entity_id, period_label, current_assets * CASE WHEN fy % 3 = 0 THEN 0.01 ELSE 1 END AS c, accounts_receivable AS a, cash_and_equivalents AS k FROM facts) SELECT entity_id, period_label, CASE WHEN coalesce(c >= greatest(a, k), true) THEN c END AS current_assets FROM p")
def d5_dropped_totals(spark, sf):
    c = F.col("current_assets") * F.when(F.col("fy") % 3 == 0, 0.01).otherwise(1.0)
    return statement_facts(spark, sf).select(*KEYS, basis.without_small_totals(c, F.col("accounts_receivable"), F.col("cash_and_equivalents")).alias("current_assets"))


def json_tables(spark, sf):
    """doc, tables: for each customer the orders, one table each, as JSON."""
    o = read(spark, sf, "orders")
    row = F.array(F.lit("1600"), F.lit("Total assets"), F.floor("o_totalprice").cast("string"))
    table = F.struct(F.lit("lattice").alias("flavor"), F.array(F.array(F.lit("head")), row).alias("rows"), F.col("o_orderkey").alias("k"))
    return o.groupBy(F.col("o_custkey").alias("doc")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), table.alias("t")))), lambda x: x["t"])).alias("tables"))


@query("WITH t AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS table_no, o_totalprice FROM orders) SELECT doc, table_no, r AS row_no, CASE r WHEN 0 THEN 'head' ELSE '1600|Total assets|' || CAST(floor(o_totalprice) AS BIGINT) END AS cells FROM t, (VALUES (0), (1)) AS v(r)")
def s2_table_rows(spark, sf):
    return basis.rows_of(json_tables(spark, sf)).select("doc", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query("WITH t AS (SELECT o_custkey AS doc, o_orderkey AS table_no, CAST(floor(o_totalprice / 50000) AS INT) AS signal, CAST(o_orderkey % 7 AS INT) AS n_rows, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey % 7 DESC, o_orderkey) AS r FROM orders) SELECT doc, table_no, signal, n_rows FROM t WHERE n <= 12 OR r <= 5")
def s4_best_tables(spark, sf):
    o = read(spark, sf, "orders")
    tables = o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("table_no"), F.floor(F.col("o_totalprice") / 50000).cast("int").alias("signal"), (F.col("o_orderkey") % 7).cast("int").alias("n_rows"))
    return basis.best_tables(tables, 12, 5)


@query(f"{documents.cells_sql()} SELECT doc, row_no, CASE WHEN abs(v) >= 1000 AND NOT (v BETWEEN 1900 AND 2100) THEN v END AS value FROM cells")
def n4_first_number(spark, sf):
    rows = documents.table_rows(spark, sf)
    value = extraction.first_number(F.slice("cells", 3, F.greatest(F.size("cells"), F.lit(1))))
    return rows.select("doc", "row_no", F.when(F.abs(value) >= 1000, value).alias("value"))


@query("SELECT doc_id, 'risk ' || lang || '|source ' || source AS items FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def m10_list_responses(spark, sf):
    """Lists of a model, every second in a fence, with blank and repeated items."""
    d = read(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    body = F.concat(F.lit('[" risk '), "lang", F.lit('", "source '), "source", F.lit('", "", "risk '), "lang", F.lit('"]'))
    response = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Risks:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return d.select("doc_id", F.array_join(basis.list_items(response), "|").alias("items"))


@query(f"{WITH_FACTS} SELECT entity_id, period_label, concat_ws(',', CASE WHEN interest_expense < 0 THEN 'interest_sign' END, CASE WHEN entity_id % 4 = 0 THEN 'lease' END, CASE WHEN currency = 'USD' THEN 'currency_USD' END) AS tags FROM facts")
def k9_adjustment_tags(spark, sf):
    tags = ratios.array_of((F.col("interest_expense") < 0, "interest_sign"), (F.col("entity_id") % 4 == 0, "lease"), (F.col("currency") == "USD", "currency_USD"))
    return statement_facts(spark, sf).select(*KEYS, F.array_join(tags, ",").alias("tags"))


@query(f"{WITH_FACTS} SELECT cls, count(*) AS n_statements, " + ", ".join(f"count({k}) AS {k}" for k in dims.FACTS) + " FROM facts GROUP BY cls")
def v5_completeness(spark, sf):
    """How many statements of each period class have each fact."""
    return statement_facts(spark, sf).groupBy("cls").agg(F.count("*").alias("n_statements"), *[F.count(k).alias(k) for k in dims.FACTS])
