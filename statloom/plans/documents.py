"""Queries over document texts and the rows of their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import dims, numbers, words
from statloom.operators import extraction, forms, text
from statloom.sources.facts import FACTS_DUCK, read, spread, statement_facts

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def any_of(column, parts):
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def n_of(column, parts):
    return "(" + " + ".join(f"CAST(contains({column}, '{p}') AS INT)" for p in parts) + ")"


PRINTED_SQL = ", ".join(f"'{label} ' || format('{{:,}}', CAST(floor({key} / 1000) AS BIGINT))" for key, label in words.PRINTED.items())
TEXTS = f"""facts AS ({FACTS_DUCK}), texts AS (SELECT 's' || entity_id || '-' || period_label AS doc, concat_ws(chr(10), 'Balance sheet', CASE WHEN fy % 2 = 0 THEN 'in thousands' ELSE 'all amounts in millions of rubles' END, {PRINTED_SQL}, 'page 1 of 2', '1999', 'Revenue   of the year: growth and risk') AS text FROM facts
 UNION ALL SELECT 'd' || doc_id, text FROM documents WHERE text IS NOT NULL)"""
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
LINES = rf"""WITH {TEXTS}, cut AS (SELECT doc, string_split(regexp_replace(text, '{CONTROL}', '', 'g'), chr(10)) AS l FROM texts), lines AS (SELECT doc, unnest(range(0, len(l))) AS line_no, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS line FROM cut)"""
NOISE = r"(line = '' OR regexp_matches(line, '^[0-9]{4}$') OR regexp_matches(line, '(?i)^(страница\s+[0-9]+(\s+из\s+[0-9]+)?|page\s+[0-9]+(\s+of\s+[0-9]+)?)$') OR regexp_matches(line, '^[0-9]+\s*/\s*[0-9]+$') OR length(regexp_replace(line, '[\p{L}\p{N}\s]', '', 'g')) / length(line) > 0.35)"
GROUPS = "len(regexp_extract_all(line, '[0-9]{3,}'))"
KEY = r"lower(trim(regexp_replace(line, '\s+', ' ', 'g')))"
SCORE = rf"({n_of('lower(line)', words.FINANCIAL)} * 4 + {GROUPS} * 2 + 2 * len(regexp_extract_all(' ' || lower(line) || ' ', '[^\p{{L}}\p{{N}}_](руб|тыс|млн|млрд)\b')) + CASE WHEN contains(line, ':') OR contains(line, '|') OR contains(line, chr(9)) THEN 2 ELSE 0 END)"


def texts(spark, sf, dealt=False):
    """Statements printed as text, and the documents; dealt to all cores for work on each line, as a file may be one task."""
    facts = statement_facts(spark, sf)
    rows = [F.concat(F.lit(f"{label} "), F.format_number(F.floor(F.col(key) / 1000).cast("bigint"), 0)) for key, label in words.PRINTED.items()]
    unit = F.when(F.col("fy") % 2 == 0, "in thousands").otherwise("all amounts in millions of rubles")
    printed = facts.select(F.concat(F.lit("s"), "entity_id", F.lit("-"), "period_label").alias("doc"), F.concat_ws("\n", F.lit("Balance sheet"), unit, *rows, F.lit("page 1 of 2"), F.lit("1999"), F.lit("Revenue   of the year: growth and risk")).alias("text"))
    documents = read(spark, sf, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d"), "doc_id"), "text")
    return printed.union(spread(documents) if dealt else documents)


@query(f"WITH {TEXTS} SELECT doc, length(text) AS n_chars FROM texts")
def s1_scan_texts(spark, sf):
    return texts(spark, sf).select("doc", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {TEXTS} SELECT doc, md5(translate(text, '’‘“”', '''''\"\"')) AS plain FROM texts")
def t1_plain_quotes(spark, sf):
    return texts(spark, sf).select("doc", F.md5(text.plain_quotes(F.col("text"))).alias("plain"))


@query(f"WITH {TEXTS}, l AS (SELECT doc, lower(text) AS t FROM texts) SELECT doc, contains(t, 'balance sheet') OR contains(t, 'бухгалтерский баланс') AS has_balance, contains(t, 'revenue') OR contains(t, 'отчет о финансовых результатах') AS has_results FROM l")
def t2_signals(spark, sf):
    low = F.lower("text")
    return texts(spark, sf).select("doc", text.contains_any(low, ["balance sheet", "бухгалтерский баланс"]).alias("has_balance"), text.contains_any(low, ["revenue", "отчет о финансовых результатах"]).alias("has_results"))


def scale_case(t):
    return f"CASE WHEN {any_of(t, words.BILLIONS)} THEN 1e9 WHEN {any_of(t, words.MILLIONS)} THEN 1e6 WHEN {any_of(t, words.THOUSANDS)} THEN 1e3 END"


@query(rf"""WITH {TEXTS}, c AS (SELECT doc, list_filter(list_transform(string_split(lower(text), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM texts),
e AS (SELECT doc, unnest(range(0, len(l))) AS n, unnest(l) AS line FROM c),
w AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN 1 PRECEDING AND 5 FOLLOWING) AS region FROM e),
t AS (SELECT doc, n, {scale_case('region')} AS s FROM w WHERE {" OR ".join(f"(contains(line, '{t}') AND length(line) <= {len(t) + 80})" for t in words.TITLES)}),
g AS (SELECT doc, arg_min(s, n) FILTER (s IS NOT NULL) AS s FROM t GROUP BY doc)
SELECT texts.doc, CAST(coalesce(CASE WHEN g.doc IS NOT NULL THEN g.s ELSE {scale_case('lower(text)[1:1500]')} END, 1.0) AS DOUBLE) AS scale FROM texts LEFT JOIN g ON g.doc = texts.doc""")
def t3_scale(spark, sf):
    return text.scale(texts(spark, sf, dealt=True))


@query(rf"WITH {TEXTS}, k AS (SELECT doc, text, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS w FROM texts) SELECT doc, coalesce(length(text) >= 20 AND len(list_filter(w, lambda t: regexp_matches(t, '^/[0-9]+$'))) / nullif(len(w), 0) > 0.3, false) AS glyphs, length(text) >= 100 AND {any_of('lower(text)', words.FINANCIAL)} AS readable FROM k")
def t4_t6_text_tests(spark, sf):
    return texts(spark, sf).select("doc", text.glyph_encoded(F.col("text")).alias("glyphs"), text.readable(F.col("text")).alias("readable"))


@query(f"{LINES} SELECT doc, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) FILTER ({NOISE}) AS n_noise FROM lines GROUP BY doc")
def t8_t9_lines(spark, sf):
    each = text.lines(texts(spark, sf, dealt=True))
    return each.groupBy("doc").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.count_if(text.noise(F.col("line"))).alias("n_noise"))


@query(f"{LINES} SELECT doc, count(DISTINCT {KEY}) AS n_kept, count(*) AS n_lines FROM lines GROUP BY doc")
def t10_line_dedup(spark, sf):
    each = text.lines(texts(spark, sf, dealt=True))
    kept = text.first_of_each(each).groupBy("doc").agg(F.count("*").alias("n_kept"))
    return kept.join(each.groupBy("doc").agg(F.count("*").alias("n_lines")), "doc")


METRICS = [k.replace("'", "''") for k in sorted({k for ks in words.KEYWORDS.values() for k in ks})]


@query(f"{LINES} SELECT doc, line_no, {SCORE} AS narrative, {n_of('lower(line)', METRICS)} * 6 + {n_of('lower(line)', words.TOTALS)} * 3 + {n_of('lower(line)', words.UNITS)} * 2 + {GROUPS} * 2 + CASE WHEN {GROUPS} >= 2 THEN 3 ELSE 0 END AS extraction FROM lines")
def t11_t13_line_scores(spark, sf):
    each = text.lines(texts(spark, sf, dealt=True))
    return each.select("doc", "line_no", text.narrative_score(F.col("line")).alias("narrative"), text.extraction_score(F.col("line")).alias("extraction"))


COMPACT = rf"""{LINES}, fit AS (SELECT * FROM lines WHERE length(line) >= 5 AND NOT {NOISE} AND ({any_of('lower(line)', words.FINANCIAL)} OR regexp_matches(line, '[0-9]{{3}}'))),
one AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY doc, {KEY} ORDER BY line_no) = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY {SCORE} DESC, line_no) AS r FROM one) WHERE r <= 120),
cum AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY line_no) AS c, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS k FROM best),
kept AS (SELECT * FROM (SELECT *, max(CASE WHEN c > 4000 AND k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS over FROM cum) WHERE over = 0)"""


@query(f"{COMPACT} SELECT doc, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS compact FROM kept GROUP BY doc")
def t12_compacted(spark, sf):
    return text.compacted(texts(spark, sf, dealt=True), 4000, 120)


@query("SELECT source, lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(length(regexp_replace(text, '[0-9]', '', 'g'))) AS BIGINT) AS n_other FROM documents GROUP BY source, lang")
def t17_corpus_statistics(spark, sf):
    other = F.length(F.regexp_replace("text", "[0-9]", ""))
    return read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.sum(other).alias("n_other"))


RAW = f"""facts AS ({FACTS_DUCK}), a AS (SELECT entity_id, period_label, CAST(floor(total_assets / 1000) AS BIGINT) AS v, (entity_id + fy) % 6 AS k FROM facts)"""


@query(f"""WITH {RAW} SELECT entity_id, period_label, CAST(CASE k WHEN 0 THEN v WHEN 1 THEN -v WHEN 2 THEN -v WHEN 3 THEN v WHEN 4 THEN v + 0.5 ELSE NULL END AS DOUBLE) AS n1 FROM a""")
def n1_parse_amount(spark, sf):
    v = F.floor(F.col("total_assets") / 1000).cast("bigint")
    text_ = F.format_number(v, 0)
    k = (F.col("entity_id") + F.col("fy")) % 6
    raw = (
        F.when(k == 0, text_).when(k == 1, F.concat(F.lit("("), F.translate(text_, ",", " "), F.lit(")"))).when(k == 2, F.concat(F.lit("−"), F.translate(text_, ",", ".")))
        .when(k == 3, F.concat(F.translate(text_, ",", " "), F.lit(" руб."))).when(k == 4, F.concat(F.translate(text_, ",", " "), F.lit(",5"))).otherwise(F.lit("no amount"))
    )
    return statement_facts(spark, sf).select("entity_id", "period_label", numbers.parse_amount(raw).alias("n1"))


@query(f"""WITH {RAW} SELECT entity_id, period_label, CAST(CASE k WHEN 0 THEN v * 1000 WHEN 1 THEN v * 1000000 WHEN 2 THEN v WHEN 3 THEN v + 0.25 WHEN 4 THEN v * 1e9 ELSE NULL END AS DOUBLE) AS n2 FROM a""")
def n2_parse_scaled(spark, sf):
    v = F.floor(F.col("total_assets") / 1000).cast("bigint")
    text_, plain = F.format_number(v, 0), v.cast("string")
    k = (F.col("entity_id") + F.col("fy")) % 6
    raw = (
        F.when(k == 0, F.concat(plain, F.lit(" тыс"))).when(k == 1, F.concat(F.translate(text_, ",", " "), F.lit(" млн руб"))).when(k == 2, F.concat(F.lit("$"), plain))
        .when(k == 3, F.concat(plain, F.lit(",25"))).when(k == 4, F.concat(plain, F.lit(" МЛРД."))).otherwise(F.lit("-"))
    )
    return statement_facts(spark, sf).select("entity_id", "period_label", numbers.parse_scaled(raw).alias("n2"))


# --- table rows -----------------------------------------------------------------------------------------------------

CODE_OF = {}
for _code, _metric in words.CODES.items():
    CODE_OF.setdefault(_metric, _code)


def table_rows(spark, sf):
    """doc, row_no, cells: a row for each fact of a statement, with a code where the form has one, and decoys."""
    cells = [F.array(F.lit(CODE_OF.get(k, "")), F.lit(label), F.lit("2023"), F.format_number(F.floor(F.col(k) / 1000).cast("bigint"), 0)) for k, label in words.PRINTED.items()]
    decoys = [F.array(F.lit(""), F.lit("Revenue"), F.lit("12")), F.array(F.lit("1250"), F.lit("Note"), F.lit("7")), F.array(F.lit(""), F.lit("Inventories"), F.lit("2023"), F.lit("845"))]
    facts = statement_facts(spark, sf)
    return facts.select(F.concat(F.lit("s"), "entity_id", F.lit("-"), "period_label").alias("doc"), F.posexplode(F.array(*cells, *decoys)).alias("row_no", "cells"))


def cells_sql():
    rows = [f"(SELECT 's' || entity_id || '-' || period_label AS doc, {i} AS row_no, '{CODE_OF.get(k, '')}' AS code, '{label}' AS label, CAST(floor({k} / 1000) AS DOUBLE) AS v FROM facts)" for i, (k, label) in enumerate(words.PRINTED.items())]
    n = len(rows)
    rows += [f"(SELECT 's' || entity_id || '-' || period_label, {n}, '', 'Revenue', 12 FROM facts)", f"(SELECT 's' || entity_id || '-' || period_label, {n + 1}, '1250', 'Note', NULL FROM facts)", f"(SELECT 's' || entity_id || '-' || period_label, {n + 2}, '', 'Inventories', 845 FROM facts)"]
    return f"WITH facts AS ({FACTS_DUCK}), cells AS ({' UNION ALL '.join(rows)})"


CODES_SQL = "codes AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{m}')" for c, m in words.CODES.items()) + ") AS v(code, metric_key))"
SHORT = "(v IS NULL OR abs(v) < 1000)"  # codes and notes of one to three digits are no amounts


@query(f"{cells_sql()}, {CODES_SQL} SELECT doc, row_no, metric_key, v AS value, 120 AS quality FROM cells JOIN codes ON codes.code = cells.code WHERE v IS NOT NULL AND NOT (v BETWEEN 0 AND 999) AND v <> 0 AND NOT (v BETWEEN 1900 AND 2100)")
def c1_code_candidates(spark, sf):
    return extraction.by_code(table_rows(spark, sf))


#: Metric and quality of the printed labels, as written down by hand; those of no label are not there.
LABEL_ROWS = {
    "Revenue": ("revenue", 50), "Net profit": ("net_profit", 50), "Interest expense": ("interest_expense", 50), "Total assets": ("total_assets", 50), "Total equity": ("equity", 50), "Total liabilities": ("liabilities", 90),
    "Total current assets": ("current_assets", 90), "Trade receivables": ("accounts_receivable", 88), "Cash and cash equivalents": ("cash_and_equivalents", 50), "Inventories": ("inventory", 50),
}
LABELS_SQL = "labels_ AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{m}', {q})" for k, (m, q) in LABEL_ROWS.items()) + ") AS v(label, metric_key, quality))"


@query(f"{cells_sql()}, {LABELS_SQL} SELECT doc, row_no, metric_key, v AS value, quality FROM cells JOIN labels_ ON labels_.label = cells.label WHERE abs(v) >= 1000 AND NOT (v BETWEEN 1900 AND 2100)")
def c3_c7_label_candidates(spark, sf):
    return forms.by_english_label(table_rows(spark, sf).withColumn("cells", F.slice("cells", 2, 9)))


@query(f"{cells_sql()} SELECT doc, count(*) AS n_rows, count(*) FILTER (abs(v) >= 100000) AS n_large, true AS financial FROM cells GROUP BY doc")
def s3_financial_tables(spark, sf):
    return extraction.financial_tables(table_rows(spark, sf))


# --- ranking --------------------------------------------------------------------------------------------------------

CANDIDATES = f"""WITH facts AS ({FACTS_DUCK}), c AS (
 SELECT entity_id, fy, cls, 'total_assets' AS metric_key, 1 AS seq, 1 AS stage, 'table' AS match_type, entity_id % 2 = 0 AS is_exact, 60 + entity_id % 7 * 10 AS quality, total_assets AS value FROM facts
 UNION ALL SELECT entity_id, fy, cls, 'total_assets', 2, 2, 'text', false, 70, total_assets * 1.05 FROM facts WHERE fy % 3 <> 0
 UNION ALL SELECT entity_id, fy, cls, 'total_assets', 3, 1, 'table', true, 60 + fy % 5 * 10, total_assets * 1.001 FROM facts
 UNION ALL SELECT entity_id, fy, cls, 'total_assets', 4, 3, 'text', false, 90, liabilities FROM facts WHERE entity_id % 4 = 0), p AS (SELECT *, CASE WHEN is_exact THEN CASE match_type WHEN 'table' THEN 3 ELSE 2 END ELSE CASE match_type WHEN 'text' THEN 2 WHEN 'table' THEN 1 ELSE 0 END END AS priority FROM c)"""


def candidates(spark, sf):
    facts = statement_facts(spark, sf)

    def row(where, seq, stage, match, exact, quality, value):
        return facts.where(where).select("entity_id", "fy", "cls", F.lit("total_assets").alias("metric_key"), F.lit(seq).alias("seq"), F.lit(stage).alias("stage"), F.lit(match).alias("match_type"), exact.alias("is_exact"), quality.alias("quality"), value.alias("value"))

    total = F.col("total_assets")
    return (
        row("true", 1, 1, "table", F.col("entity_id") % 2 == 0, 60 + F.col("entity_id") % 7 * 10, total).union(row("fy % 3 <> 0", 2, 2, "text", F.lit(False), F.lit(70), total * 1.05))
        .union(row("true", 3, 1, "table", F.lit(True), 60 + F.col("fy") % 5 * 10, total * 1.001)).union(row("entity_id % 4 = 0", 4, 3, "text", F.lit(False), F.lit(90), F.col("liabilities")))
    )


RANK = "row_number() OVER (PARTITION BY entity_id, fy, cls, metric_key ORDER BY priority DESC, quality DESC, seq)"


@query(f"{CANDIDATES} SELECT entity_id, fy, cls, metric_key, seq, priority, quality, value FROM p QUALIFY {RANK} = 1")
def r1_winners(spark, sf):
    out = extraction.winners(candidates(spark, sf), ["entity_id", "fy", "cls", "metric_key"])
    return out.select("entity_id", "fy", "cls", "metric_key", "seq", "priority", "quality", "value")


@query(f"{CANDIDATES}, w AS (SELECT * FROM p QUALIFY {RANK} = 1) SELECT w.entity_id, w.fy, w.cls, w.metric_key, count(p.seq) AS n_conflicts FROM w LEFT JOIN p ON p.entity_id = w.entity_id AND p.fy = w.fy AND p.cls = w.cls AND p.metric_key = w.metric_key AND p.seq > w.seq AND p.quality >= 60 AND abs(p.value - w.value) > greatest(1000.0, 0.01 * greatest(abs(p.value), abs(w.value))) GROUP BY 1, 2, 3, 4")
def r2_conflicts(spark, sf):
    return extraction.conflicts(candidates(spark, sf), ["entity_id", "fy", "cls", "metric_key"])


@query(f"{CANDIDATES}, r AS (SELECT *, coalesce(max(priority) FILTER (stage < 3) OVER (PARTITION BY entity_id, fy, cls, metric_key), 0) AS before FROM p) SELECT entity_id, fy, cls, seq FROM r WHERE stage < 3 OR before < 2")
def r3_stage_gate(spark, sf):
    return extraction.gated(candidates(spark, sf), ["entity_id", "fy", "cls", "metric_key"], 3).select("entity_id", "fy", "cls", "seq")


@query(f"{CANDIDATES}, k AS (SELECT *, CAST(0.5 AS DOUBLE) + quality / 400.0 AS confidence FROM p) SELECT entity_id, fy, cls, seq, CASE WHEN confidence >= 0.7 THEN value END AS value, CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM k")
def r8_m11_confidence_filter(spark, sf):
    c = candidates(spark, sf).withColumn("confidence", F.lit(0.5) + F.col("quality") / 400.0)
    return c.select("entity_id", "fy", "cls", "seq", extraction.kept_value(F.col("value"), F.col("confidence"), 0.7).alias("value"), extraction.level(F.col("confidence")).alias("level"))


HOLES = f"""WITH facts AS ({FACTS_DUCK}), h AS (SELECT entity_id, period_label, total_assets, CASE WHEN entity_id % 6 <> 5 THEN equity END AS equity, CASE WHEN entity_id % 3 <> 0 THEN liabilities END AS liabilities, CASE WHEN entity_id % 4 <> 0 THEN current_assets END AS current_assets, CASE WHEN entity_id % 5 <> 0 THEN accounts_receivable END AS accounts_receivable, cash_and_equivalents, liabilities * 0.4 AS long_term_liabilities FROM facts)"""


@query(f"""{HOLES}, l AS (SELECT *, coalesce(liabilities, CASE WHEN (total_assets - equity) / nullif(total_assets, 0) >= 0.02 THEN total_assets - equity END) AS liab FROM h),
s AS (SELECT *, CASE WHEN liab - long_term_liabilities >= 0 THEN liab - long_term_liabilities END AS st FROM l)
SELECT entity_id, period_label, liab AS liabilities, st AS short_term_liabilities, coalesce(current_assets, accounts_receivable + cash_and_equivalents, CASE WHEN total_assets - equity - liab > 0 THEN total_assets - equity - liab END) AS current_assets FROM s""")
def d2_d4_derived(spark, sf):
    facts = statement_facts(spark, sf)
    e = F.col("entity_id")
    holes = facts.select("entity_id", "period_label", "total_assets", F.when(e % 6 != 5, F.col("equity")).alias("equity"), F.when(e % 3 != 0, F.col("liabilities")).alias("liabilities"), F.when(e % 4 != 0, F.col("current_assets")).alias("current_assets"), F.when(e % 5 != 0, F.col("accounts_receivable")).alias("accounts_receivable"), "cash_and_equivalents", (F.col("liabilities") * 0.4).alias("long_term_liabilities"))
    return extraction.derived(holes).select("entity_id", "period_label", "liabilities", "short_term_liabilities", "current_assets")


@query(f"""WITH facts AS ({FACTS_DUCK}), g AS (SELECT *, CASE WHEN fy % 4 = 0 THEN total_assets * 1.5 ELSE current_assets END AS ca FROM facts)
SELECT entity_id, period_label, CASE WHEN ca > total_assets THEN NULL ELSE ca END AS current_assets, CASE WHEN accounts_receivable > CASE WHEN ca > total_assets THEN NULL ELSE ca END THEN NULL ELSE accounts_receivable END AS accounts_receivable,
concat_ws(',', CASE WHEN ca > total_assets THEN 'current_assets>total_assets' END, CASE WHEN accounts_receivable > CASE WHEN ca > total_assets THEN NULL ELSE ca END THEN 'accounts_receivable>current_assets' END) AS events FROM g""")
def g2_g3_guardrails(spark, sf):
    facts = statement_facts(spark, sf).withColumn("current_assets", F.when(F.col("fy") % 4 == 0, F.col("total_assets") * 1.5).otherwise(F.col("current_assets")))
    out = extraction.guarded(facts, [("current_assets", "total_assets"), ("accounts_receivable", "current_assets")])
    return out.select("entity_id", "period_label", "current_assets", "accounts_receivable", F.array_join("events", ",").alias("events"))


# --- model responses ------------------------------------------------------------------------------------------------

RESPONSES = f"""WITH facts AS ({FACTS_DUCK}), r AS (SELECT entity_id, period_label, fy, unnest([1, 2]) AS chunk_no, liabilities, current_assets FROM facts),
written AS (SELECT entity_id, period_label, chunk_no, 'liabilities' AS metric_key, CAST(floor(liabilities) AS DOUBLE) AS value, CAST(0.6 + (entity_id + chunk_no) % 3 * 0.1 AS DOUBLE) AS confidence FROM r
 UNION ALL SELECT entity_id, period_label, chunk_no, 'current_assets', CAST(floor(current_assets) AS DOUBLE), 0.5 FROM r WHERE (entity_id + fy) % 4 <> 0),
i AS (SELECT * FROM written WHERE value IS NOT NULL)"""


def responses(spark, sf):
    """Responses of a model: JSON, every fifth in a fence, every fourth cut off inside its last item."""
    facts = statement_facts(spark, sf).withColumn("chunk_no", F.explode(F.array(F.lit(1), F.lit(2))))
    item = lambda k, c: F.concat(F.lit('{"metric": "%s", "value": ' % k), F.coalesce(F.floor(k).cast("string"), F.lit("null")), F.lit(', "confidence_score": '), c, F.lit("}"))
    first = item("liabilities", F.element_at(F.array(F.lit("0.6"), F.lit("0.7"), F.lit("0.8")), ((F.col("entity_id") + F.col("chunk_no")) % 3 + 1).cast("int")))
    second = item("current_assets", F.lit("0.5"))
    cut = (F.col("entity_id") + F.col("fy")) % 4 == 0
    body = F.concat(F.lit('{"metrics": ['), first, F.lit(", "), F.when(cut, F.left(second, F.lit(30))).otherwise(F.concat(second, F.lit("]}"))))
    fenced = F.when((F.col("entity_id") % 5 == 0) & ~cut, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return facts.select("entity_id", "period_label", "chunk_no", fenced.alias("response"))


@query(f"{RESPONSES} SELECT * FROM i")
def m1_m2_parse_responses(spark, sf):
    return extraction.model_items(responses(spark, sf), ["entity_id", "period_label", "chunk_no"])


@query(f"{RESPONSES} SELECT entity_id, period_label, metric_key, arg_max(value, confidence * 10 - chunk_no * 0.001) AS value, max(confidence) AS confidence FROM i GROUP BY 1, 2, 3")
def m4_merge_chunks(spark, sf):
    return extraction.merged(extraction.model_items(responses(spark, sf), ["entity_id", "period_label", "chunk_no"]), ["entity_id", "period_label", "metric_key"])


@query(f"{RESPONSES} SELECT entity_id, period_label, chunk_no, metric_key, CASE WHEN value < 50000 THEN least(confidence, CAST(0.3 AS DOUBLE)) ELSE confidence END AS confidence FROM i")
def m3_anomaly_check(spark, sf):
    items = extraction.model_items(responses(spark, sf), ["entity_id", "period_label", "chunk_no"])
    return extraction.anomaly_checked(items, {"liabilities": (50000.0, None), "current_assets": (50000.0, None)}).drop("value")


@query(f"""{RESPONSES}, m AS (SELECT entity_id, period_label, metric_key, max(value) AS value, max(confidence) AS confidence FROM i GROUP BY 1, 2, 3), f AS (SELECT entity_id, period_label, 'liabilities' AS metric_key, CASE WHEN fy % 3 = 0 THEN NULL WHEN fy % 3 = 1 THEN liabilities * 20 ELSE liabilities * 1.1 END AS fallback FROM facts)
SELECT f.entity_id, f.period_label, m.confidence >= 0.7 AND (fallback IS NULL OR (sign(fallback) = sign(m.value) AND greatest(abs(fallback), abs(m.value)) / least(abs(fallback), abs(m.value)) < 10)) AS prefer_model, CASE WHEN m.confidence >= 0.7 AND (fallback IS NULL OR (sign(fallback) = sign(m.value) AND greatest(abs(fallback), abs(m.value)) / least(abs(fallback), abs(m.value)) < 10)) THEN m.value ELSE fallback END AS value FROM f JOIN m ON m.entity_id = f.entity_id AND m.period_label = f.period_label AND m.metric_key = f.metric_key""")
def m5_prefer_model(spark, sf):
    best = extraction.merged(extraction.model_items(responses(spark, sf), ["entity_id", "period_label", "chunk_no"]), ["entity_id", "period_label", "metric_key"]).where("metric_key = 'liabilities'")
    k = F.col("fy") % 3
    fallback = statement_facts(spark, sf).select("entity_id", "period_label", F.when(k == 1, F.col("liabilities") * 20).when(k == 2, F.col("liabilities") * 1.1).alias("fallback"))
    both = fallback.join(best, ["entity_id", "period_label"])
    prefer = extraction.prefer_model(F.col("value"), F.col("confidence"), F.col("fallback"))
    return both.select("entity_id", "period_label", prefer.alias("prefer_model"), F.when(prefer, F.col("value")).otherwise(F.col("fallback")).alias("value"))
