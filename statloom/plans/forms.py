"""Queries over national forms and tables of their rows. The texts are made of orders, in the same words in both dialects; the SQL does
not read them, but says from the order's number what has to come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import numbers
from statloom.operators import forms
from statloom.plans import documents
from statloom.sources.facts import read, spread

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


#: Two amounts of six digits for each order, and how forms print them.
A, B = ("CAST(100000 + CAST(floor(o_totalprice) AS BIGINT) % 900000 AS BIGINT)", "CAST(100000 + CAST(floor(o_totalprice) * 3 AS BIGINT) % 900000 AS BIGINT)")
H = {x: f"CAST(CAST(floor({y} / 1000) AS BIGINT) AS STRING)" for x, y in (("a", A), ("b", B))}
L = {x: f"lpad(CAST({y} % 1000 AS STRING), 3, '0')" for x, y in (("a", A), ("b", B))}
AP, BP = (f"({H[x]} || ' ' || {L[x]})" for x in "ab")
BASE = f"o AS (SELECT o_orderkey AS doc, {A} AS a, {B} AS b, o_orderkey % 2 AS m2, o_orderkey % 3 AS m3, o_orderkey % 5 AS m5, o_orderkey % 7 AS m7, CAST(o_orderkey % 8 AS INT) AS k FROM orders)"
NL = "chr(10)"


def orders(spark, sf, text: str, tables: str = "false"):
    """doc, text, has_tables of each order."""
    return spread(read(spark, sf, "orders").select("o_orderkey", "o_totalprice")).select(F.col("o_orderkey").alias("doc"), F.expr(text).alias("text"), F.expr(tables).alias("has_tables"))


def case(*parts: str, key: str = "o_orderkey % 8") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts)) + " END"


# --- numbers --------------------------------------------------------------------------------------------------------

SCANNED = case(
    f"{AP} || ' ' || {BP}", f"'3211 - - - ' || {AP} || ' ' || {BP}", f"'(' || {AP} || ')'", f"'1' || {AP} || ' 1' || {BP}", f"'12 ' || {AP}", "'2023'",
    f"{AP} || ' 000 ' || {BP} || ' 000'", f"'0710001 ' || {AP}",
)


@query(f"WITH {BASE} SELECT doc, CAST({case('a', 'a', '-a', '1000000 + a', '12000000 + a', 'NULL', 'a * 1000', 'a', key='k')} AS DOUBLE) AS value FROM o")
def n6_scanned_numbers(spark, sf):
    """Amounts of scanned lines: periods run together, line codes, brackets, years, form numbers."""
    return orders(spark, sf, SCANNED).select("doc", numbers.preferred_scanned_amount("text").alias("value"))


# --- codes ----------------------------------------------------------------------------------------------------------

CODED = "concat_ws(chr(10), " + ", ".join([
    f"CASE WHEN o_orderkey % 2 = 0 THEN 'Выручка 2110 ' || {AP} || ' ' || {BP} ELSE 'Прочее (стр. 2110) ' || {AP} END",
    f"CASE o_orderkey % 3 WHEN 0 THEN 'Строка код 1210 ' || {AP} WHEN 1 THEN 'Запасы 12100 ' || {AP} ELSE '1210 ' || {BP} END",
    "CASE WHEN o_orderkey % 5 < 3 THEN 'Дебиторская задолженность (стр. 1230)' END",
    f"CASE WHEN o_orderkey % 7 = 0 THEN 'Актив 1600 - ' || {AP} WHEN o_orderkey % 7 = 1 THEN 'Пассив 1700 ' || {BP} END",
    "'Денежные средства 1250 17'",
]) + ")"


@query(f"""WITH {BASE} SELECT doc, 'revenue' AS metric_key, CAST(a AS DOUBLE) AS value, 115 AS quality FROM o WHERE m2 = 0 UNION ALL SELECT doc, 'inventory', CASE m3 WHEN 0 THEN a ELSE b END, 115 FROM o WHERE m3 <> 1
 UNION ALL SELECT doc, 'total_assets', CASE m7 WHEN 0 THEN a ELSE b END, 115 FROM o WHERE m7 < 2""")
def x1_code_lines(spark, sf):
    """Values behind form codes: with an anchor, with the code in front, inside other numbers, without a number."""
    return forms.code_candidates(orders(spark, sf, CODED)).drop("is_exact")


RESULT_CODED = f"concat_ws(chr(10), CASE WHEN o_orderkey % 3 <> 0 THEN 'Отчет о финансовых результатах' END, 'Выручка 2110 ' || {AP}, CASE WHEN o_orderkey % 2 = 0 THEN 'Net profit 2400 (' || {BP} || ')' ELSE '2400 нет' END)"


@query(f"WITH {BASE} SELECT doc, 'revenue' AS metric_key, CAST(a AS DOUBLE) AS value, 110 AS quality FROM o WHERE m3 <> 0 AND m5 <> 0 UNION ALL SELECT doc, 'net_profit', -b, 120 FROM o WHERE m3 <> 0 AND m5 <> 0 AND m2 = 0")
def x2_result_codes(spark, sf):
    """Results by code, in forms without tables only."""
    return forms.result_code_candidates(orders(spark, sf, RESULT_CODED, "o_orderkey % 5 = 0")).drop("is_exact")


# --- following lines ------------------------------------------------------------------------------------------------

GAPS, LONG_GAPS = [0, 6, 7, 8, 2], [0, 7, 8, 22, 23, 24, 1]  # lines between a name and its number
FOLLOWING = f"""'Форма 0710002' || chr(10) || 'Выручка' || chr(10) || repeat('прочее' || chr(10), {case(*map(str, GAPS), key='o_orderkey % 5')}) || {AP} || ' ' || {BP} || chr(10) || 'Чистая прибыль' || chr(10)
 || CASE WHEN o_orderkey % 2 = 0 THEN 'Совокупный финансовый результат периода' || chr(10) ELSE 'пояснение' || chr(10) END || repeat('строка 12' || chr(10) || chr(10), {case(*map(str, LONG_GAPS), key='o_orderkey % 7')}) || '(' || {BP} || ')'"""


@query(f"""WITH {BASE} SELECT doc, 'revenue' AS metric_key, CAST(a AS DOUBLE) AS value, 50 AS quality FROM o WHERE {case(*map(str, GAPS), key='m5')} < 7
 UNION ALL SELECT doc, 'net_profit', -b, 50 FROM o WHERE m2 = 1 AND {case(*map(str, LONG_GAPS), key='m7')} < 22""")
def x5_following_lines(spark, sf):
    """A metric's value on a line of numbers after its name: within 7 lines, for the net profit within 23, not past the comprehensive result."""
    return forms.multiline_candidates(orders(spark, sf, FOLLOWING)).drop("is_exact")


SECTION = f"""concat_ws(chr(10), CASE WHEN o_orderkey % 7 <> 0 THEN 'Отчет о финансовых результатах' END,
 {case(f"'Выручка ' || {AP}", f"'Revenue' || chr(10) || 'прочее' || chr(10) || {BP}", f"'2110 ' || {AP} || chr(10) || 'Выручка ' || {BP}", f"'Выручка' || chr(10) || repeat('прочее' || chr(10), 5) || {BP}", "'без неё'", key='o_orderkey % 5')},
 {case(f"'Чистая прибыль (' || {BP} || ')'", f"'Net income' || chr(10) || 'Total comprehensive income ' || {AP} || chr(10) || {BP}", f"'Чистая прибыль' || chr(10) || 'в том числе' || chr(10) || {AP}", key='o_orderkey % 3')},
 CASE WHEN o_orderkey % 2 = 0 THEN 'Руководитель' || chr(10) || 'Выручка ' || {AP} END)"""


@query(f"""WITH {BASE}, s AS (SELECT * FROM o WHERE m7 <> 0)
SELECT doc, 'revenue' AS metric_key, CAST(CASE m5 WHEN 1 THEN b ELSE a END AS DOUBLE) AS value, CASE m5 WHEN 0 THEN 108 WHEN 1 THEN 104 ELSE 110 END AS quality FROM s WHERE m5 < 3
UNION ALL SELECT doc, 'net_profit', CASE m3 WHEN 0 THEN -b ELSE a END, CASE m3 WHEN 0 THEN 110 WHEN 1 THEN 112 ELSE 106 END FROM s""")
def x8_results_section(spark, sf):
    """Revenue and net profit within the section of results: code, same line, following lines, comprehensive result."""
    return forms.result_section_candidates(orders(spark, sf, SECTION)).drop("is_exact")


# --- patterns and totals --------------------------------------------------------------------------------------------

BROAD = case(
    f"'Total revenues | ' || {AP}", f"'Net sales of the year were ' || {AP}", f"'TURNOVER 0710001 Net sales ' || {AP}", f"'Itself: total current assets, see note, ' || {AP} || '; Выручка: (' || {BP} || ')'",
    "'Net loss ' || repeat('x', 81) || '5'", f"'Net loss ' || repeat('x', 70) || {AP}", f"'Total stockholders’ equity | ' || {AP}", "'nothing'",
)


@query(f"""WITH {BASE} SELECT doc, 'revenue' AS metric_key, CAST(CASE k WHEN 3 THEN b ELSE a END AS DOUBLE) AS value, 50 AS quality FROM o WHERE k < 4 UNION ALL SELECT doc, 'current_assets', a, 90 FROM o WHERE k = 3
 UNION ALL SELECT doc, 'net_profit', a, 50 FROM o WHERE k = 5 UNION ALL SELECT doc, 'equity', a, 50 FROM o WHERE k = 6""")
def x6_broad_patterns(spark, sf):
    return forms.broad_candidates(orders(spark, sf, BROAD)).drop("is_exact")


TOTALS = case(
    f"'Итого по разделу V ' || {AP} || ' ' || {BP}", f"{AP} || chr(10) || 'прочее' || chr(10) || 'Итого по разделу V' || chr(10) || {BP}", f"{AP} || chr(10) || repeat('прочее' || chr(10), 8) || 'Итого по разделу V'",
    f"'Итого по разделу V ' || {BP} || chr(10) || 'Итого по разделу IV ' || {BP} || chr(10) || 'код 1400 1' || {AP}", f"'Итого по разделу III 100 000' || chr(10) || 'Итого по разделу IV 900 000' || chr(10) || 'код 1400 9' || {AP}", "'Итого по разделу IV' || chr(10) || '12'",
    f"'Бухгалтерский баланс' || chr(10) || 'руководитель ' || {AP} || chr(10) || 'Итого по разделу V' || chr(10) || '7'", f"'Баланс ' || {AP}",
)


def totals_sql(short: str, long: str = "") -> str:
    return f"""SELECT doc, 'short_term_liabilities' AS metric_key, CAST(CASE k WHEN 0 THEN a WHEN 3 THEN b ELSE greatest(a, b) END AS DOUBLE) AS value, 110 AS quality FROM o WHERE k IN (0, 1, 3) {short}
 UNION ALL SELECT doc, 'long_term_liabilities', CASE {long} WHEN k = 3 THEN 1000000 + a ELSE 900000 END, 105 FROM o WHERE k = 4 OR k = 3
 UNION ALL SELECT doc, 'equity', 100000, 105 FROM o WHERE k = 4 AND m5 <> 0"""


@query(f"WITH {BASE} {totals_sql('')}")
def x7_section_totals(spark, sf):
    """Totals of a balance's sections: on their line, near it, too far, as an artefact of another total, by code."""
    return forms.section_candidates(orders(spark, sf, TOTALS, "o_orderkey % 5 = 0")).drop("is_exact")


@query(f"WITH {BASE} {totals_sql('AND m7 <> 0', 'WHEN k = 3 AND m7 = 0 THEN b')}")
def x7_totals_after_earlier(spark, sf):
    """The same where every seventh document has an earlier candidate of the short-term liabilities."""
    docs = orders(spark, sf, TOTALS, "o_orderkey % 5 = 0")
    earlier = docs.where("doc % 7 = 0").select("doc", F.lit("short_term_liabilities").alias("metric_key"), F.lit(5.0).alias("value"))
    held = forms.section_candidates(docs, earlier).drop("is_exact")
    return held


# --- all stages -----------------------------------------------------------------------------------------------------

STAGES = f"""concat_ws(chr(10), CASE WHEN o_orderkey % 2 = 0 THEN 'Отчет о финансовых результатах' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Выручка 2110 ' || {AP} ELSE 'Выручка ' || {BP} END,
 CASE WHEN o_orderkey % 5 = 0 THEN 'Net loss was ' || {AP} END, CASE WHEN o_orderkey % 7 = 0 THEN 'Итого по разделу IV ' || {BP} END)"""


@query(f"""WITH {BASE} SELECT doc, 'revenue' AS metric_key, 1 AS stage, CAST(a AS DOUBLE) AS value FROM o WHERE m3 = 0 UNION ALL SELECT doc, 'revenue', 2, a FROM o WHERE m2 = 0 AND m3 = 0
 UNION ALL SELECT doc, 'revenue', CASE m2 WHEN 0 THEN 3 ELSE 4 END, b FROM o WHERE m3 <> 0 UNION ALL SELECT doc, 'net_profit', CASE m2 WHEN 0 THEN 3 ELSE 4 END, a FROM o WHERE m5 = 0
 UNION ALL SELECT doc, 'long_term_liabilities', 6, b FROM o WHERE m7 = 0 UNION ALL SELECT doc, 'revenue', 7, CASE m3 WHEN 0 THEN a ELSE b END FROM o WHERE m2 = 0""")
def r3_text_stages(spark, sf):
    """All stages over the same texts: a gated one gives a metric only where no earlier one did."""
    return forms.text_candidates(orders(spark, sf, STAGES)).select("doc", "metric_key", "stage", "value")


# --- rows -----------------------------------------------------------------------------------------------------------

AC = f"({H['a']} || ',' || {L['a']})"


def labelled(spark, sf, labels: list[str]):
    """A row of each order: label, note, amount, and the amount before."""
    cells = F.array(F.expr(case(*[f"'{x}'" for x in labels], key=f"o_orderkey % {len(labels)}")), F.lit("12"), F.expr(AC), F.lit("7"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("row_no"), cells.alias("cells"))


def label_case(*pairs: tuple[str, object]) -> str:
    """Metric and quality by the order's number, a row for each label (None: the row gives nothing)."""
    rows = ", ".join(f"({i}, '{m}', {q})" for i, (m, q) in enumerate(pairs) if m)
    return f"WITH {BASE} SELECT doc, 0 AS row_no, metric_key, CAST(a AS DOUBLE) AS value, quality FROM o JOIN (VALUES {rows}) AS v(i, metric_key, quality) ON doc % {len(pairs)} = i"


NATIONAL = ["Выручка от продаж", "Оборотные активы", "Итого оборотные активы", "хэхцэ√х ёЁхфёЄтр", "Долгосрочная дебиторская задолженность", "Дебиторская задолженность", "Итого активы", "Прочее", "Краткосрочные обязательства по аренде", "Собственный капитал"]


@query(label_case(("revenue", 50), (None, 0), ("current_assets", 90), ("cash_and_equivalents", 50), (None, 0), ("accounts_receivable", 70), ("total_assets", 50), (None, 0), (None, 0), ("equity", 50)))
def c2_national_labels(spark, sf):
    return forms.by_national_label(labelled(spark, sf, NATIONAL))


ENGLISH = ["Revenue", "Non-current assets", "Current assets", "Total current assets", "Property, plant and equipment", "Trade receivables", "Non-current borrowings", "Current lease liabilities", "Total equity and liabilities", "Non-current liabilities", "Short-term liabilities"]


@query(label_case(("revenue", 50), ("total_assets", 50), (None, 0), ("current_assets", 90), ("total_assets", 50), ("accounts_receivable", 88), ("short_term_borrowings", 88), ("short_term_lease_liabilities", 88), ("equity", 50), (None, 0), (None, 0)))
def c3_english_labels(spark, sf):
    """Every label's metric and quality as written down by hand; "non-current borrowings" has the earlier "current borrowings" in it."""
    return forms.by_english_label(labelled(spark, sf, ENGLISH))


@query(f"WITH {BASE} SELECT doc, 0 AS row_no, 'ebitda' AS metric_key, CAST(a AS DOUBLE) AS value, 75 AS quality, 'gross_profit_to_ebitda_approximation' AS reason FROM o WHERE m3 = 0")
def c4_approximate_labels(spark, sf):
    return forms.by_approximate_label(labelled(spark, sf, ["Gross profit", "Profit", "Operating profit"]))


SCANNED_CELL = case(f"'текст Выручка за год ' || {AP} || ' 5'", f"'Запасы' || repeat('.', 51) || {AP}", f"'Запасы' || repeat('.', 50) || {AP} || '; inventories ' || {BP}", "'cash 2023'", "'revenue 0'", f"'прибыль (убыток) чистая прибыль (убыток) {{}}' || {AP}", f"'Оборотные активы ' || {AP}", "'-'").replace("{}", "")


@query(f"""WITH {BASE} SELECT doc, 0 AS row_no, 'revenue' AS metric_key, CAST(a AS DOUBLE) AS value, 50 AS quality FROM o WHERE k = 0 UNION ALL SELECT doc, 0, 'inventory', a, 50 FROM o WHERE k = 2 UNION ALL SELECT doc, 0, 'net_profit', a, 50 FROM o WHERE k = 5""")
def c5_scanned_cells(spark, sf):
    """Keywords and numbers within the text of a scanned page: too far, years, zeros, labels that give nothing alone."""
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("row_no"), F.array(F.when(F.col("o_orderkey") % 8 == 7, "text").otherwise("OCR_TEXT"), F.expr(SCANNED_CELL)).alias("cells"))
    return forms.by_scanned_cell(rows)


# Rows of a table: head, fillers, total; which head, how many fillers and which total by the order's number.
FILL = [0, 3, 28, 29, 5]


def heading_rows(spark, sf):
    o = spread(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"))
    row = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    key, n = F.col("o_orderkey"), F.expr(case(*map(str, FILL), key="o_orderkey % 5"))
    head = F.when(key % 3 == 0, row("Non-current assets", "", "")).otherwise(row("Current assets", "", ""))
    stop = F.when(key % 7 == 0, F.array(row("Total assets", "", "999,999"))).otherwise(F.array().cast("array<array<string>>"))
    total = F.when(key % 2 == 0, row("", "", F.expr(AC))).otherwise(row("Total", "", F.expr(AC)))
    fillers = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i < n, row("Other", "1", "555,555")).otherwise(row("-", "", "7")))
    rows = F.concat(F.array(row("Title", "2023", "")), F.array(head), F.slice(fillers, F.lit(1), n), stop, F.array(total))
    return o.select(key.alias("doc"), (key % 4).cast("int").alias("table_no"), F.posexplode(rows).alias("row_no", "cells"))


@query(f"WITH {BASE} SELECT doc, 'current_assets' AS metric_key, CAST(a AS DOUBLE) AS value, 112 AS quality FROM o WHERE m3 <> 0 AND m7 <> 0 AND {case(*map(str, FILL), key='m5')} < 29")
def c8_heading_totals(spark, sf):
    """Totals without a label of their own: other headings, a section's end before them, 29 and 30 rows below the heading."""
    return forms.heading_totals(heading_rows(spark, sf))


# --- sanity of the results ------------------------------------------------------------------------------------------

PAIRS = """SELECT o_orderkey AS doc, floor(o_totalprice) AS r, CASE o_orderkey % 5 WHEN 0 THEN floor(o_totalprice) * 0.25 WHEN 1 THEN -floor(o_totalprice) * 0.75 ELSE floor(o_totalprice) * 2 END AS p,
 CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) * 4 END AS cr, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) * 0.5 END AS cp, o_orderkey % 7 = 0 AS standalone,
 CASE WHEN o_orderkey % 11 = 0 THEN 'table' ELSE 'text' END AS match_r, CASE WHEN o_orderkey % 4 = 0 THEN 90 ELSE 60 END AS qr, CASE WHEN o_orderkey % 3 = 1 THEN 90 ELSE 60 END AS qp FROM {orders}"""


@query(f"""WITH x AS ({PAIRS.format(orders='orders')}), w AS (SELECT *, NOT standalone AND abs(p) / r > 0.6 AS bad, match_r = 'table' AS fixed FROM x),
b AS (SELECT *, bad AND cr IS NOT NULL AND cp IS NOT NULL AS codes, bad AND NOT (cr IS NOT NULL AND cp IS NOT NULL) AND NOT fixed AS choose FROM w),
n AS (SELECT *, CASE WHEN codes THEN cr WHEN choose AND cr IS NOT NULL AND abs(p) / cr < abs(p) / r THEN cr END AS nr, CASE WHEN codes THEN cp WHEN choose AND cp IS NOT NULL AND abs(cp) < abs(p) THEN cp END AS np FROM b),
z AS (SELECT *, choose AND abs(coalesce(np, p)) / coalesce(nr, r) > 0.6 AS still, CASE WHEN nr IS NULL THEN qr ELSE 120 END AS zr, CASE WHEN np IS NULL THEN qp ELSE 120 END AS zp FROM n),
d AS (SELECT *, CASE WHEN still THEN CASE WHEN zr < zp THEN 'revenue' WHEN zp < zr THEN 'net_profit' WHEN cp IS NOT NULL AND cr IS NULL THEN 'revenue' ELSE 'net_profit' END END AS gone FROM z)
SELECT doc, CAST(CASE WHEN gone = 'revenue' THEN NULL ELSE coalesce(nr, r) END AS DOUBLE) AS revenue, CAST(CASE WHEN gone = 'net_profit' THEN NULL ELSE coalesce(np, p) END AS DOUBLE) AS net_profit,
 concat_ws(',', CASE WHEN nr IS NOT NULL THEN 'sanity_pnl_replaced_revenue_with_code' END, CASE WHEN np IS NOT NULL THEN 'sanity_pnl_replaced_net_profit_with_code' END, 'sanity_pnl_conflict_drop_' || gone) AS reasons FROM d""")
def g1_results_sanity(spark, sf):
    """Margins above 0.6: replaced by codes, by the best pair, kept beside exact tables and in standalone forms, or one of the two dropped."""
    x = spark.sql(PAIRS, orders=read(spark, sf, "orders"))
    part = lambda v, match, q: F.struct(F.col(v).cast("double").alias("value"), F.expr(match).alias("match_type"), F.lit(True).alias("is_exact"), F.col(q).alias("quality"))
    pairs = x.select("doc", part("r", "match_r", "qr").alias("revenue"), part("p", "'text'", "qp").alias("net_profit"), F.col("cr").cast("double").alias("revenue_code"), F.col("cp").cast("double").alias("profit_code"), "standalone")
    out = forms.results_sanity(pairs)
    return out.select("doc", F.col("revenue.value").alias("revenue"), F.col("net_profit.value").alias("net_profit"), F.array_join(F.transform("events", lambda e: e["reason"]), ",").alias("reasons"))


# --- compaction and chunks ------------------------------------------------------------------------------------------

FILLED = f"""concat_ws(chr(10), {case("'Выручка за год'", "'Total assets'", "'just some words'", "'itogo'", "''", "'Total'", "'page 1 of 9'", "'x' || o_orderkey")}, {AP} || ' тыс', 'prose ' || repeat('word ', 25), CASE WHEN o_orderkey % 3 = 0 THEN 'Total current assets ' || {AP} ELSE 'note 17' END,
 {AP} || ' ' || {BP}, '2023', CASE WHEN o_orderkey % 2 = 0 THEN 'total CURRENT  assets ' || {AP} END, '12 ' || {BP}, '!!! -- ##', 'net income ' || {BP}, {BP} || ' млн', {AP} || ' руб')"""
GOOD = f"""(length(line) >= 3 AND NOT {documents.NOISE} AND NOT (len(regexp_extract_all(line, '\\S+')) > 20 AND g = 0 AND NOT named) AND (named OR total OR (unit AND g > 0) OR g >= 2))"""
EXTRACT = rf"""WITH RECURSIVE f AS (SELECT o_orderkey AS doc, string_split({FILLED}, chr(10)) AS l FROM orders), c AS (SELECT doc, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM f),
m AS (SELECT *, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS key, {documents.any_of('lower(line)', documents.METRICS)} AS named, {documents.any_of('lower(line)', documents.words.TOTALS)} AS total, {documents.any_of('lower(line)', documents.words.UNITS)} AS unit, {documents.GROUPS} AS g FROM c),
e AS (SELECT doc, i, line, key, {GOOD} AS good, (named OR total) AND NOT {documents.NOISE} AS hit, NOT {documents.NOISE} AND (g > 0 OR unit) AS beside,
 {documents.n_of('lower(line)', documents.METRICS)} * 6 + {documents.n_of('lower(line)', documents.words.TOTALS)} * 3 + {documents.n_of('lower(line)', documents.words.UNITS)} * 2 + g * 2 + CASE WHEN g >= 2 THEN 3 ELSE 0 END AS score FROM m),
z AS (SELECT doc, list({{'line': line, 'key': key, 'good': good, 'hit': hit, 'beside': beside, 'score': score}} ORDER BY i) AS l FROM e GROUP BY doc),
r AS (SELECT doc, l, 0 AS i, CAST([] AS VARCHAR[]) AS seen, CAST([] AS INTEGER[]) AS took FROM z
 UNION ALL SELECT doc, l, i + 1, CASE WHEN ok THEN list_concat(list_append(seen, x.key), CASE WHEN b THEN [p.key] ELSE [] END, CASE WHEN a THEN [n.key] ELSE [] END) ELSE seen END, CASE WHEN ok THEN list_concat(list_append(took, i), CASE WHEN b THEN [i - 1] ELSE [] END, CASE WHEN a THEN [i + 1] ELSE [] END) ELSE took END
 FROM (SELECT *, ok AND x.hit AND coalesce(p.beside, false) AND i > 0 AND NOT list_contains(list_append(seen, x.key), p.key) AS b, ok AND x.hit AND coalesce(n.beside, false) AND NOT list_contains(list_append(CASE WHEN i > 0 AND p.beside AND x.hit THEN list_append(seen, p.key) ELSE seen END, x.key), n.key) AS a
  FROM (SELECT *, x.good AND NOT list_contains(seen, x.key) AS ok FROM (SELECT *, l[i + 1] AS x, CASE WHEN i > 0 THEN l[i] END AS p, l[i + 2] AS n FROM r WHERE i < len(l))))),
t AS (SELECT r.doc, unnest(took) AS i FROM r WHERE i = len(l)), s AS (SELECT e.* FROM t JOIN e USING (doc, i)), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, i) <= 6),
cum AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY i) AS n, row_number() OVER (PARTITION BY doc ORDER BY i) AS k FROM best), kept AS (SELECT *, max(CASE WHEN n > 100 AND k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) AS over FROM cum)
SELECT doc, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS compact FROM kept WHERE over = 0 GROUP BY doc"""


@query(EXTRACT)
def t14_extraction_compacted(spark, sf):
    """Lines of metrics, totals and amounts with their neighbours, at most six of them in 100 characters; the SQL goes line by line."""
    from statloom.operators import text

    return text.extraction_compacted(orders(spark, sf, FILLED), 100, 6)


@query("""WITH RECURSIVE p AS (SELECT doc_id AS doc, replace(text, '. ', '.' || chr(10) || chr(10)) AS text FROM documents WHERE text <> ''), q AS (SELECT doc, text, string_split(text, chr(10) || chr(10)) AS l FROM p),
f AS (SELECT doc, l, 1 AS i, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS now, 0 AS n FROM q WHERE length(text) > 1200
 UNION ALL SELECT doc, l, i + 1, CASE WHEN long THEN list_concat(shut, list_transform(range(0, CAST(ceil((length(x) - 1200) / 1000.0) AS INT) + 1), lambda k: substring(x, CAST(k * 1000 + 1 AS INT), 1200))) WHEN full_ THEN shut ELSE done END,
  CASE WHEN long THEN NULL WHEN full_ THEN right(now, 200) || chr(10) || chr(10) || x WHEN now IS NULL THEN x ELSE now || chr(10) || chr(10) || x END, CASE WHEN long THEN 0 WHEN full_ THEN least(length(now), 200) + length(x) + 2 ELSE n + length(x) + 2 END
 FROM (SELECT *, l[i] AS x, length(l[i]) > 1200 AS long, now IS NOT NULL AND n + length(l[i]) + 2 > 1200 AS full_, CASE WHEN now IS NULL THEN done ELSE list_append(done, now) END AS shut FROM f WHERE i <= len(l))),
c AS (SELECT doc, CASE WHEN now IS NULL THEN done ELSE list_append(done, now) END AS chunks FROM f WHERE i = len(l) + 1 UNION ALL SELECT doc, [text] FROM q WHERE length(text) <= 1200)
SELECT doc, CAST(unnest(range(0, len(chunks))) AS INT) AS chunk_no, md5(unnest(chunks)) AS chunk FROM c""")
def t16_chunks(spark, sf):
    """Paragraphs (sentences stand for them) packed into chunks of 1,200 characters with 200 of overlap, all of them."""
    from statloom.operators import text

    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return text.chunks(docs, 1200, 200, None).select("doc", "chunk_no", F.md5("chunk").alias("chunk"))
