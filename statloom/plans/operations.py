"""Queries over outcomes, stored analyses and status events."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import evaluation, history
from statloom.sources.facts import ANALYSES_DUCK, STATUS_OF, analyses, read

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


OUTCOMES = "WITH o AS (SELECT l.doc_id AS case_id, source AS suite, CASE toxic WHEN 1 THEN 'guard' ELSE 'open' END AS surface, least(1.0, CAST(n_chars AS DOUBLE) / 20000) AS confidence, quality = 1 AS correct FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def outcomes(spark, sf):
    both = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return both.select(F.col("doc_id").alias("case_id"), F.col("source").alias("suite"), F.when(F.col("toxic") == 1, "guard").otherwise("open").alias("surface"), F.least(F.lit(1.0), F.col("n_chars").cast("double") / 20000).alias("confidence"), (F.col("quality") == 1).alias("correct"))


BINS = "b AS (SELECT CAST(least(floor(confidence * 5), 4) AS INT) AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(correct AS INT)) AS a FROM o GROUP BY 1)"


@query(f"{OUTCOMES}, {BINS} SELECT CAST(r.bin AS INT) AS bin, coalesce(n, 0) AS count, round(coalesce(c, 0), 9) AS mean_confidence, round(coalesce(a, 0), 9) AS accuracy FROM range(5) r(bin) LEFT JOIN b ON b.bin = r.bin")
def e4_reliability_bins(spark, sf):
    out = evaluation.reliability_bins(outcomes(spark, sf))
    return out.select("bin", "count", F.round("mean_confidence", 9).alias("mean_confidence"), F.round("accuracy", 9).alias("accuracy"))


@query(f"{OUTCOMES}, {BINS} SELECT count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy, round(avg(CAST(confidence >= 0.5 AS INT)), 6) AS acceptance, round(avg(CAST(abs(confidence - 0.5) <= 0.05 AS INT)), 6) AS boundary, round(avg(confidence), 6) AS mean_confidence, round(avg((confidence - CAST(correct AS INT)) * (confidence - CAST(correct AS INT))), 6) AS brier, (SELECT round(sum(n * abs(a - c)) / sum(n), 6) FROM b) AS ece FROM o")
def e5_summary(spark, sf):
    out = evaluation.summary(outcomes(spark, sf))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "acceptance", "boundary", "mean_confidence", "brier", "ece")])


STEPS = [-0.10, -0.05, 0.0, 0.05, 0.10]


@query(f"{OUTCOMES}, t AS (SELECT CAST(unnest([0.4, 0.45, 0.5, 0.55, 0.6]) AS DOUBLE) AS threshold) SELECT threshold, count(*) FILTER (confidence >= threshold) AS accepted, count(*) FILTER (confidence >= threshold AND NOT correct) AS false_accepts, count(*) FILTER (confidence < threshold AND correct) AS false_rejects FROM o, t GROUP BY threshold")
def e6_threshold_sweep(spark, sf):
    return evaluation.threshold_sweep(outcomes(spark, sf), 0.5, STEPS)


@query(f"{OUTCOMES} SELECT case_id, confidence >= 0.5 AS base_accepted, confidence AS base_confidence, confidence * 1.1 >= 0.5 AS other_accepted, confidence * 1.1 AS other_confidence FROM o WHERE (confidence >= 0.5) <> (confidence * 1.1 >= 0.5)")
def e7_policy_diff(spark, sf):
    o = outcomes(spark, sf)
    base = o.withColumn("accepted", F.col("confidence") >= 0.5)
    other = o.withColumn("confidence", F.col("confidence") * 1.1).withColumn("accepted", F.col("confidence") >= 0.5)
    return evaluation.policy_diff(base, other, ["case_id"])


@query(f"{OUTCOMES}, m AS (SELECT suite AS profile, surface AS policy, avg(confidence) AS confidence, row_number() OVER (PARTITION BY surface ORDER BY suite) AS no FROM o GROUP BY 1, 2), n AS (SELECT *, lead(profile) OVER (PARTITION BY policy ORDER BY no) AS next, lead(confidence) OVER (PARTITION BY policy ORDER BY no) AS nc FROM m) SELECT policy, profile || '>' || next AS pair, confidence >= nc AS holds FROM n WHERE next IS NOT NULL")
def e8_rank_order(spark, sf):
    from pyspark.sql import Window

    mean = outcomes(spark, sf).groupBy(F.col("suite").alias("profile"), F.col("surface").alias("policy")).agg(F.avg("confidence").alias("confidence"))
    return evaluation.rank_order(mean.withColumn("no", F.row_number().over(Window.partitionBy("policy").orderBy("profile"))))


@query(f"{OUTCOMES}, s AS (SELECT DISTINCT suite FROM o UNION ALL SELECT NULL), r AS (SELECT unnest(['open', 'guard', 'merge']) AS surface), w AS (SELECT suite, surface FROM s, r), c AS (SELECT suite, surface, count(*) AS n FROM o GROUP BY 1, 2 UNION ALL SELECT NULL, surface, count(*) FROM o GROUP BY surface) SELECT w.suite, w.surface, coalesce(n, 0) AS n FROM w LEFT JOIN c ON c.suite IS NOT DISTINCT FROM w.suite AND c.surface = w.surface")
def e9_coverage(spark, sf):
    return evaluation.coverage(outcomes(spark, sf), ["open", "guard", "merge"])


@query(f"{OUTCOMES} SELECT suite, case_id FROM o WHERE NOT correct AND confidence >= 0.5")
def e10_mismatches(spark, sf):
    """A row for each mismatch, however many a suite has."""
    return outcomes(spark, sf).where("NOT correct AND confidence >= 0.5").select("suite", "case_id")


STORED = f"WITH a AS ({ANALYSES_DUCK})"


@query(f"{STORED} SELECT * FROM a ORDER BY created_at DESC, task_id DESC LIMIT 20 OFFSET 20")
def h1_history_page(spark, sf):
    return history.page(analyses(spark, sf), 2, 20)


@query(f"{STORED} SELECT status, count(*) AS n, min(created_at) AS first, max(created_at) AS last FROM a GROUP BY status")
def h1_status_counts(spark, sf):
    return analyses(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


@query(f"{STORED} SELECT * FROM a WHERE task_id = 7")
def h2_point_lookup(spark, sf):
    return analyses(spark, sf).where("task_id = 7")


CLEAN = "((status IN ('completed', 'failed', 'cancelled') AND created_at < TIMESTAMP '1997-01-01') OR (status = 'processing' AND coalesce(heartbeat_at, created_at) < TIMESTAMP '1998-06-01'))"


@query(f"{STORED} SELECT task_id, status, created_at FROM a WHERE {CLEAN} ORDER BY created_at, task_id LIMIT 100")
def h4_cleanup_candidates(spark, sf):
    return history.cleanup_candidates(analyses(spark, sf), "1997-01-01", "1998-06-01").orderBy("created_at", "task_id").limit(100).select("task_id", "status", "created_at")


@query(f"{STORED} SELECT status, count(*) AS n FROM a WHERE NOT coalesce({CLEAN}, false) GROUP BY status")
def h5_after_cleanup(spark, sf):
    a = analyses(spark, sf)
    return history.after_cleanup(a, history.cleanup_candidates(a, "1997-01-01", "1998-06-01")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{STORED}, s AS (SELECT *, status = 'processing' AND coalesce(heartbeat_at, created_at) < TIMESTAMP '1998-06-01' AS hit FROM a) SELECT task_id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN 'runtime_stale' END AS error FROM s")
def h6_h7_recovered(spark, sf):
    return history.recovered(analyses(spark, sf), "1998-06-01").select("task_id", "status", "error")


@query(f"{STORED} SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'new' WHEN task_id % 2 = 0 THEN status END AS status, CASE WHEN task_id % 2 = 0 THEN filename END AS filename, CASE WHEN task_id % 3 = 0 THEN 'v2' END AS version FROM a WHERE task_id % 2 = 0 OR task_id % 3 = 0")
def s7_merged_payloads(spark, sf):
    a = analyses(spark, sf)
    old = a.where("task_id % 2 = 0").select("task_id", F.create_map(F.lit("status"), "status", F.lit("filename"), "filename").alias("payload"))
    new = a.where("task_id % 3 = 0").select("task_id", F.create_map(F.lit("status"), F.lit("new"), F.lit("version"), F.lit("v2")).alias("payload"))
    out = history.merged_payloads(old, new, "task_id")
    return out.select("task_id", *[F.try_element_at("payload", F.lit(k)).alias(k) for k in ("status", "filename", "version")])


@query("SELECT o_orderkey AS task_id, CASE WHEN round(o_totalprice / 3000, 2) <= 100 THEN round(o_totalprice / 3000, 2) END AS score, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(round(o_orderkey % 12 / 10.0, 1) AS DOUBLE) END * CASE WHEN o_orderkey % 12 <= 10 THEN 1 END AS confidence_score, CASE WHEN o_orderkey % 5 <> 0 THEN 'high' END AS risk_level FROM orders")
def s8_s9_summary_columns(spark, sf):
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    body = F.struct(F.round(F.col("o_totalprice") / 3000, 2).alias("value"), F.when(k % 4 != 0, F.round(k % 12 / 10.0, 1).cast("string")).otherwise("unknown").alias("confidence"), F.when(k % 5 != 0, "high").otherwise("odd").alias("risk_level"))
    return history.summary_columns(o.select(k.alias("task_id"), F.to_json(F.struct(body.alias("score"))).alias("result")))


@query(f"{STORED}, v AS (SELECT task_id, concat_ws(',', CASE WHEN score NOT BETWEEN 0 AND 100 THEN 'score' END, CASE WHEN status = 'completed' AND score IS NULL THEN 'completed_without_score' END) AS violations FROM a) SELECT * FROM v WHERE violations <> ''")
def s10_violations(spark, sf):
    return history.violations(analyses(spark, sf)).select("task_id", F.array_join("violations", ",").alias("violations"))


CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STATUS_OF.items())
EVENTS = f"WITH e AS (SELECT event_id, ts, user_id AS task_id, CASE event_type {CASES} END AS status, CAST(json_extract(props, '$.k') AS INT) AS progress, value FROM events)"


def events(spark, sf):
    status = F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair]), F.col("event_type"))
    return read(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("task_id"), status.alias("status"), F.get_json_object("props", "$.k").cast("int").alias("progress"), "value")


@query(f"{EVENTS} SELECT task_id, status, progress, ts AS at FROM e QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) = 1")
def q2_latest_status(spark, sf):
    return history.latest_status(events(spark, sf))


@query(f"{EVENTS} SELECT task_id, max(progress) AS progress, count(*) AS n FROM e GROUP BY task_id")
def q3_progress(spark, sf):
    return events(spark, sf).groupBy("task_id").agg(F.max("progress").alias("progress"), F.count("*").alias("n"))


@query(f"""{EVENTS}, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS k FROM g) SELECT task_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY task_id, k""")
def q4_sessions(spark, sf):
    return history.sessions(events(spark, sf), "6 hours")


@query(f"{EVENTS}, l AS (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS before FROM e) SELECT task_id, before, status, count(*) AS n FROM l WHERE before IN ('completed', 'failed', 'cancelled') AND status <> before GROUP BY 1, 2, 3")
def q5_illegal_steps(spark, sf):
    return history.illegal_steps(events(spark, sf))


@query(f"{EVENTS} SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, status, count(*) AS n FROM e GROUP BY 1, 2")
def q6_event_rates(spark, sf):
    return history.event_rates(events(spark, sf), "10 minutes")


@query(f"{EVENTS}, x AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS start, status FROM e, (VALUES (0), (1)) AS v(i)) SELECT start, status, count(*) AS n FROM x GROUP BY 1, 2")
def q6_sliding_rates(spark, sf):
    return history.event_rates(events(spark, sf), "1 hour", "30 minutes")


@query(f"{EVENTS} SELECT DISTINCT task_id, status FROM e")
def q7_without_repeats(spark, sf):
    return events(spark, sf).dropDuplicates(["task_id", "status"]).select("task_id", "status")


@query(f"{EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY ts DESC, event_id DESC) AS rn FROM e) SELECT status, count(*) AS n, count(*) FILTER (rn <= 1000) AS n_recent, round(avg(value) FILTER (rn <= 1000), 6) AS mean_value FROM r GROUP BY status")
def h11_task_metrics(spark, sf):
    return history.task_metrics(events(spark, sf)).select("status", "n", "n_recent", F.round("mean_value", 6).alias("mean_value"))
