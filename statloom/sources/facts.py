"""Statement facts: one row for each entity and reporting period, from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.dims import FACTS

#: Runs in Spark and in DuckDB; in Spark the tables are named arguments.
FACTS_SQL = """
WITH o AS (
  SELECT c.c_nationkey AS entity_id, year(o.o_orderdate) AS fy, quarter(o.o_orderdate) AS q, o.o_orderkey,
         o.o_orderstatus AS st, o.o_orderpriority AS pr, CAST(o.o_totalprice AS DECIMAL(18,2)) AS tp
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey),
per AS (SELECT * FROM (VALUES ('FY',4),('Q1',1),('H1',2)) AS p(cls,maxq)),
bal AS (
  SELECT entity_id, fy, cls, sum(tp) AS total_assets,
         sum(CASE WHEN st IN ('O','P') THEN tp END) AS current_assets,
         sum(CASE WHEN st = 'P' THEN tp END) AS short_term_liabilities,
         sum(CASE WHEN st = 'O' THEN tp END) AS accounts_receivable,
         sum(CASE WHEN pr IN ('1-URGENT','2-HIGH') THEN tp END) AS liabilities
  FROM o JOIN per ON o.q <= per.maxq GROUP BY entity_id, fy, cls),
pnl AS (
  SELECT entity_id, fy, cls,
         sum(CAST(l.l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS revenue,
         sum(CAST(l.l_quantity AS DECIMAL(8,2)) * CAST(p.p_retailprice AS DECIMAL(10,2))) AS cost_of_goods_sold,
         sum(CAST(l.l_extendedprice AS DECIMAL(14,2)) * CAST(l.l_tax AS DECIMAL(4,2))) AS interest_expense
  FROM o JOIN per ON o.q <= per.maxq
  JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey
  GROUP BY entity_id, fy, cls),
cash AS (SELECT c_nationkey AS entity_id, sum(CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(14,2)) ELSE 0 END) AS cash
         FROM {customer} GROUP BY c_nationkey)
SELECT b.entity_id, b.fy, b.cls,
       CASE b.cls WHEN 'FY' THEN CAST(b.fy AS STRING) ELSE concat(b.cls, '/', CAST(b.fy AS STRING)) END AS period_label,
       CASE WHEN (b.entity_id + b.fy) % 11 = 0 THEN NULL ELSE CAST(n.revenue AS DOUBLE) END AS revenue,
       CAST(n.revenue AS DOUBLE) - CAST(n.cost_of_goods_sold AS DOUBLE) - CAST(n.interest_expense AS DOUBLE) AS net_profit,
       CAST(n.cost_of_goods_sold AS DOUBLE) AS cost_of_goods_sold,
       CAST(n.interest_expense AS DOUBLE) AS interest_expense,
       CAST(b.total_assets AS DOUBLE) AS total_assets,
       CAST(b.total_assets AS DOUBLE) - CAST(b.liabilities AS DOUBLE) AS equity,
       CAST(b.liabilities AS DOUBLE) AS liabilities,
       CAST(b.current_assets AS DOUBLE) AS current_assets,
       CASE WHEN (b.entity_id + b.fy) % 13 = 0 THEN 0.0
            WHEN (b.entity_id + b.fy) % 17 = 0 THEN -CAST(b.short_term_liabilities AS DOUBLE)
            ELSE CAST(b.short_term_liabilities AS DOUBLE) END AS short_term_liabilities,
       CAST(b.accounts_receivable AS DOUBLE) AS accounts_receivable,
       CAST(k.cash AS DOUBLE) AS cash_and_equivalents,
       CASE WHEN (b.entity_id * 7 + b.fy) % 19 = 0 THEN 'USD' ELSE 'RUB' END AS currency
FROM bal b JOIN pnl n ON b.entity_id = n.entity_id AND b.fy = n.fy AND b.cls = n.cls
JOIN cash k ON k.entity_id = b.entity_id
"""
#: The same for DuckDB, whose tables have these names.
FACTS_DUCK = FACTS_SQL.format(orders="orders", customer="customer", lineitem="lineitem", part="part")


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows that become much work each, dealt to all cores where their files are too few for that."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 2 * cores else rows.repartition(4 * cores)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def statement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FACTS_SQL, **{t: read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "part")})


def statement_inputs(facts: DataFrame) -> DataFrame:
    """The long form: entity_id, fy, cls, period_label, metric_key, value, confidence, unit."""
    pairs = ", ".join(f"'{k}', {k}" for k in FACTS)
    long = facts.selectExpr("entity_id", "fy", "cls", "period_label", f"stack({len(FACTS)}, {pairs}) AS (metric_key, value)")
    confidence = F.when(~F.col("metric_key").isin("accounts_receivable"), F.round(0.50 + (F.col("entity_id") % 6) * 0.08, 2))
    unit = F.when((F.col("entity_id") + F.col("fy")) % 23 == 0, "kg").otherwise("currency")
    return long.withColumns({"confidence": confidence, "unit": unit})


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored analyses: task_id, status, created_at, heartbeat_at, score, filename, cost."""
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    beat = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").cast("timestamp").alias("first_ship"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
    return orders.join(beat, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("task_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("first_ship")).alias("heartbeat_at"),
        F.when(F.col("o_orderstatus") == "F", F.round(F.col("o_totalprice") / 5000, 2)).alias("score"),
        F.concat(F.lit("report-"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("filename"),
    )


ANALYSES_DUCK = """
SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
       CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderkey % 5 <> 0 THEN b.first_ship END AS heartbeat_at,
       CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice / 5000, 2) END AS score, 'report-' || o_custkey || '.pdf' AS filename
FROM orders LEFT JOIN (SELECT l_orderkey, CAST(min(l_shipdate) AS TIMESTAMP) AS first_ship FROM lineitem GROUP BY 1) b ON b.l_orderkey = o_orderkey
"""
STATUS_OF = {"signup": "uploading", "view": "processing", "click": "heartbeat", "purchase": "completed", "error": "failed"}
