"""Queries that read values from lines, windows and rows; each with SQL that parses the same texts in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import numbers, words
from statloom.operators import reading, text
from statloom.plans import documents
from statloom.plans.decisions import pick, quality_case
from statloom.plans.documents import any_of
from statloom.plans.statements import KEYS, WITH_FACTS
from statloom.sources.facts import read, spread, statement_facts

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


# --- texts of orders, the same in both dialects ---------------------------------------------------------------------

V = "CAST(floor(o_totalprice) AS BIGINT)"
THOUSANDS, REST = f"CAST(floor({V} / 1000) AS BIGINT)", f"lpad(CAST({V} % 1000 AS STRING), 3, '0')"
BLANK, COMMA = (f"CASE WHEN {V} < 1000 THEN CAST({V} AS STRING) ELSE CAST({THOUSANDS} AS STRING) || '{sep}' || {REST} END" for sep in (" ", ","))
#: A line by the order's number: references, years, two periods, brackets, percentages, sentences, form numbers.
LINES = {
    "'Consolidated statements of income 2023 2022'": 1,
    f"'Revenue ' || {BLANK} || ' ' || {BLANK}": 1,
    f"'Revenue 14 ' || {COMMA} || ' ' || {COMMA}": 3,
    f"'Total revenue increase of 12% to $' || {COMMA} || ' in the future'": 2,
    f"'Net profit (' || {COMMA} || ')'": 2,
    f"'NET  INCOME   $ ' || {COMMA} || '.50'": 5,
    f"'Total current assets 2023 ' || {COMMA}": 1,
    f"'Other current assets 0710001 ' || {BLANK}": 4,
    f"'Total liabilities and stockholders’ equity ' || {COMMA}": 2,
    f"'Total liabilities 0710002 17 ' || {COMMA}": 3,
    f"'Of the trade receivables, a customer accounted for 7 and ' || CAST({V} AS STRING) || ',75'": 2,
    f"'Operating profit 123 456 123 456; inventories: 12'": 6,
    "'Cash and cash equivalents 2021'": 3,
}
LEDGER = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN o_orderkey % {n} = 0 THEN {line} END" for line, n in LINES.items()) + ")"
TEXTS = f"WITH texts AS (SELECT o_orderkey AS doc, {LEDGER} AS text FROM orders)"


def ledgers(spark, sf):
    """doc, text: a page of statement lines for each order."""
    return spread(read(spark, sf, "orders").select("o_orderkey", "o_totalprice")).select(F.col("o_orderkey").alias("doc"), F.expr(LEDGER).alias("text"))


def found_sql(window: str) -> str:
    """The numbers of a window as a list of (d: digits, v: amount), years left out. As in the texts' amounts, a single comma
    or dot behind a currency sign is decimal."""
    groups = "regexp_extract_all(r, '[0-9]+')"
    two = f"CASE WHEN len({groups}) = 4 AND NOT contains(r, '.') THEN {groups}[1] || ' ' || {groups}[2] ELSE r END"
    grouped = "regexp_matches(x, '^[-(]?([0-9]{1,3}([ ,.][0-9]{3})+|[$][0-9]{1,3}( [0-9]{3}|[,.][0-9]{3}[,.][0-9]{3})+)[)]?$')"
    plain = f"CAST(CASE WHEN {grouped} THEN regexp_replace(x, '[^0-9]', '', 'g') WHEN contains(x, ',') AND contains(x, '.') THEN regexp_replace(x, '[^0-9.]', '', 'g') ELSE regexp_replace(replace(x, ',', '.'), '[^0-9.]', '', 'g') END AS DOUBLE)"
    signed = f"{plain} * CASE WHEN starts_with(x, '-') OR (contains(x, '(') AND contains(x, ')')) THEN -1 ELSE 1 END"
    each = f"list_transform(list_transform(regexp_extract_all({window}, '{numbers.NUMBER}'), lambda r: {two}), lambda x: {{'d': regexp_replace(x, '[^0-9]', '', 'g'), 'v': {signed}}})"
    return f"list_filter({each}, lambda y: NOT (y.v = floor(y.v) AND y.v BETWEEN 1900 AND 2100))"


#: Of such a list c the preferred amount.
PREFERRED = "coalesce(list_filter(c, lambda y: NOT (length(y.d) <= 3 AND len(c) > 1) AND NOT (starts_with(y.d, '07') AND length(y.d) >= 6))[1].v, c[-1].v)"
KEYWORDS_SQL = "kw AS (SELECT * FROM (VALUES " + ", ".join("('{}', {}, '{}')".format(m, i, k.replace("'", "''")) for m, ks in reading.KEYWORDS.items() for i, k in enumerate(ks)) + ") AS v(metric_key, no, keyword))"
LINES_SQL = rf"{TEXTS}, {KEYWORDS_SQL}, cut AS (SELECT doc, string_split(text, chr(10)) AS l FROM texts), lines AS (SELECT doc, unnest(range(0, len(l))) AS line_no, replace(trim(regexp_replace(unnest(l), '\s+', ' ', 'g')), '’', '''') AS line FROM cut)"


@query(f"{LINES_SQL}, n AS (SELECT doc, line_no, {found_sql('line')} AS c FROM lines) SELECT doc, line_no, {PREFERRED} AS value FROM n")
def n5_preferred_numbers(spark, sf):
    return text.lines(ledgers(spark, sf)).select("doc", "line_no", numbers.preferred_amount("line").alias("value"))


COUNT = f"len(regexp_extract_all(line, '{numbers.NUMBER}'))"
SCORE = f"""least(4, len(string_split(keyword, ' ')) - 1) + CASE WHEN a = 0 THEN 5 WHEN a < 12 THEN 3 WHEN a < 32 THEN 1 ELSE -1 END + CASE WHEN contains(line, '$') THEN 2 ELSE 0 END
 + CASE WHEN {COUNT} BETWEEN 2 AND 4 THEN 2 WHEN {COUNT} = 1 THEN 1 WHEN {COUNT} > 6 THEN -2 ELSE 0 END + CASE WHEN length(line) <= 120 THEN 1 WHEN length(line) > 220 THEN -2 ELSE 0 END
 - CASE WHEN contains(line, '%') THEN 3 ELSE 0 END - CASE WHEN {any_of('lower(line)', words.NARRATIVE)} THEN 5 ELSE 0 END
 - CASE WHEN keyword = 'total liabilities' AND (contains(lower(line), 'stockholders'' equity') OR contains(lower(line), 'shareholders'' equity')) THEN 4 ELSE 0 END"""
NAMED = f"{LINES_SQL}, named AS (SELECT *, position(keyword IN lower(line)) - 1 AS a FROM lines JOIN kw ON contains(lower(line), keyword) QUALIFY row_number() OVER (PARTITION BY doc, line_no, metric_key ORDER BY length(keyword) DESC, no) = 1)"


@query(f"{NAMED} SELECT doc, line_no, metric_key, keyword, {SCORE} AS score FROM named")
def x4_line_scores(spark, sf):
    each = text.lines(ledgers(spark, sf)).select("doc", "line_no", text.plain_quotes(text.squeezed(F.col("line"))).alias("line"))
    named = each.select("*", F.explode(reading.longest_keywords(F.lower("line"))).alias("x"))
    return named.select("doc", "line_no", "x.metric_key", "x.keyword", reading.line_score(F.col("line"), F.col("x.keyword")).alias("score"))


@query(f"""{NAMED}, n AS (SELECT *, lower(line) AS l, {found_sql('substring(line, a + length(keyword) + 1)')} AS c FROM named),
v AS (SELECT doc, line_no, metric_key, {PREFERRED} AS value, {quality_case()} AS quality, {SCORE} AS own FROM n)
SELECT doc, metric_key, value, quality, own + quality // 20 AS score FROM v WHERE value IS NOT NULL AND quality IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY doc, metric_key ORDER BY own + quality // 20 DESC, abs(value) DESC, line_no) = 1""")
def x3_best_lines(spark, sf):
    return reading.by_line(ledgers(spark, sf))


@query(f"""{TEXTS}, {KEYWORDS_SQL}, place AS (SELECT doc, lower(text) AS t, metric_key, no, keyword, unnest(range(1, length(text) + 1)) AS i FROM texts JOIN kw ON contains(lower(text), keyword)),
w AS (SELECT doc, metric_key, no, i, substring(t, i + length(keyword), 60) AS w FROM place WHERE substring(t, i, length(keyword)) = keyword), n AS (SELECT *, {found_sql('w')} AS c FROM w),
v AS (SELECT doc, metric_key, no, i, {PREFERRED} AS value FROM n)
SELECT doc, metric_key, value FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, metric_key ORDER BY no, i) = 1""")
def x9_near_keywords(spark, sf):
    return reading.near_keyword(ledgers(spark, sf))


# --- rows -----------------------------------------------------------------------------------------------------------


@query(f"""{documents.cells_sql()}, {KEYWORDS_SQL}, hit AS (SELECT DISTINCT doc, row_no, metric_key, lower(label) AS l, v FROM cells JOIN kw ON contains(lower(label), keyword)),
q AS (SELECT doc, row_no, metric_key, v AS value, {quality_case()} AS quality, l IN (SELECT keyword FROM kw WHERE kw.metric_key = hit.metric_key) AS is_exact, starts_with(l, 'total ') AS is_total FROM hit WHERE v IS NOT NULL AND v <> 0 AND NOT (v BETWEEN 1900 AND 2100))
SELECT * FROM q WHERE quality IS NOT NULL""")
def c6_any_cell_candidates(spark, sf):
    return reading.by_any_cell(documents.table_rows(spark, sf))


# --- pages and views ------------------------------------------------------------------------------------------------

PAGES = pick(["Balance sheet: 1600 and 1200, Current liabilities", "Statement of income: 2110, 2400", "1250 Выручка 1400", "Notes", "Total liabilities, чистая прибыль 1500"], "l_partkey + l_linenumber")


@query(f"""WITH pages AS (SELECT l_orderkey AS doc, l_linenumber AS page, lower({PAGES}) AS text FROM lineitem), prefix AS (SELECT a.doc, a.page, string_agg(b.text, chr(10) ORDER BY b.page) AS t FROM pages a JOIN pages b ON b.doc = a.doc AND b.page <= a.page GROUP BY 1, 2),
e AS (SELECT doc, page, page >= 5 AND {any_of('t', words.BALANCE_MARKS)} AND {any_of('t', words.RESULT_MARKS)} AND {documents.n_of('t', words.ROW_MARKS)} >= 5
 AND (contains(t, '1700') OR (contains(t, '1400') AND contains(t, '1500')) OR (contains(t, 'total liabilities') AND contains(t, 'current liabilities'))) AS enough FROM prefix)
SELECT doc, min(page) FILTER (enough) AS enough_at FROM e GROUP BY doc""")
def t7_enough_pages(spark, sf):
    return reading.enough_pages(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.expr(PAGES).alias("text")))


def masked_sql(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 'X' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || regexp_replace(format('{{:,}}', CAST(round_even(abs({x}), 0) AS BIGINT)), '[0-9]', 'X', 'g') END"


@query(f"""{WITH_FACTS}, m AS (SELECT *, entity_id % 2 = 0 AS demo, floor(total_assets) AS assets, floor(equity - 1000000) AS own, floor(fy) AS ratio FROM facts)
SELECT entity_id, period_label, CASE WHEN demo THEN {masked_sql('assets')} ELSE CAST(CAST(assets AS BIGINT) AS VARCHAR) END AS assets, CASE WHEN demo THEN {masked_sql('own')} ELSE CAST(CAST(own AS BIGINT) AS VARCHAR) END AS own, CASE WHEN demo THEN {masked_sql('ratio')} ELSE CAST(CAST(ratio AS BIGINT) AS VARCHAR) END AS ratio,
 CASE WHEN demo THEN '{words.HIDDEN_TEXT}' ELSE currency END AS text, fy AS score FROM m""")
def h8_demo_view(spark, sf):
    whole = lambda c: F.floor(c).cast("bigint")
    stored = statement_facts(spark, sf).select(
        *KEYS, F.create_map(F.lit("assets"), whole(F.col("total_assets")), F.lit("own"), whole(F.col("equity") - 1000000)).alias("metrics"),
        F.create_map(F.lit("turnover"), whole(F.col("fy"))).alias("ratios"), F.col("currency").alias("text"), F.col("fy").alias("score"),
    )
    shown = reading.demo_view(stored, F.col("entity_id") % 2 == 0)
    return shown.select(*KEYS, F.col("metrics")["assets"].alias("assets"), F.col("metrics")["own"].alias("own"), F.col("ratios")["turnover"].alias("ratio"), "text", "score")
