"""Metric values from the texts of national forms and from the rows of their tables.

A document is one row; its lines, the places of its marks and the values of its lines of numbers are arrays of that row.
So nothing is joined or shuffled until candidates are picked: one scan of the texts, and rows of candidates after it.
``docs`` has doc, text and has_tables; candidates are doc, metric_key, value, quality, is_exact.

Defined cases: a null or empty text has no candidates; repeated documents repeat theirs; very long texts are read whole, in
time in proportion to their lines; further columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import words
from statloom.functions.numbers import amount_after_code, let, parse_amount, preferred_scanned_amount, valid, valid_value
from statloom.operators.decisions import label_quality
from statloom.operators.extraction import first_number
from statloom.operators.reading import by_line, given, line_score, longest_keywords, single_keywords
from statloom.operators.text import contains_any, plain_quotes, some_of

CANDIDATE = ("doc", "metric_key", "value", "quality", "is_exact")
BREAKS = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def signals(docs: DataFrame) -> DataFrame:
    """docs with form_like and balance_like: marks of the national forms, and of a balance or its sections' totals."""
    low = F.lower(plain_quotes(F.coalesce("text", F.lit(""))))
    return docs.withColumns({"form_like": some_of(low, words.FORM_MARKS), "balance_like": some_of(low, words.BALANCE_FORM_MARKS)})


def clean_lines(text: Column) -> Column:
    """The lines that are not blank, quotes plain, blanks squeezed."""
    return F.filter(F.transform(F.split(plain_quotes(text), BREAKS), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")


def after(line: Column, mark: Column | str) -> Column:
    """What stands behind the first place of a mark (lower case keeps the length of these texts' letters)."""
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return F.substring(line, F.instr(F.lower(line), mark) + F.length(mark), F.length(line))


def first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def span(array: Column, begin: Column | int, end: Column | int) -> Column:
    """The elements from begin up to before end, counted from 0 and cut to the array."""
    begin = F.greatest(F.lit(0), F.lit(begin) if isinstance(begin, int) else begin)
    return F.slice(array, begin + 1, F.greatest(F.lit(0), (F.lit(end) if isinstance(end, int) else end) - begin))


# --- codes ----------------------------------------------------------------------------------------------------------


def near_code(lines: Column, codes: list[str], anchors: list[str] | None) -> Column:
    """The value behind a line code on its line, if the line begins with the code, calls it a code, or has one of the
    anchors; an earlier code decides, then an earlier place."""

    def one(code: str) -> Column:
        low = lambda x: F.lower(x)
        row = lambda x: low(x).rlike(rf"(?U)(^|\b)код\s+{code}(?![0-9])") | F.ltrim(low(x)).startswith(code)
        fits = lambda x: F.lit(True) if anchors is None else contains_any(low(x), anchors) | row(x)
        named = F.filter(lines, lambda x: x.contains(code) & fits(x))
        tails = F.flatten(F.transform(named, lambda x: F.regexp_extract_all(x, F.lit(rf"(?<![0-9]){code}(?![0-9])(?=(.*))"), F.lit(1))))
        return first(F.filter(F.transform(tails, amount_after_code), lambda v: valid_value(v)))

    return F.coalesce(*map(one, codes))


def plain_lines(text: Column) -> Column:
    return F.split(plain_quotes(text), "\n")


def code_candidates(docs: DataFrame) -> DataFrame:
    """By the codes of the form in the text (quality 115)."""
    each = [F.struct(F.lit(m).alias("metric_key"), near_code(F.col("lines"), codes, anchors).alias("value")) for m, (codes, anchors) in words.TEXT_CODES.items()]
    found = docs.select("doc", F.filter(plain_lines(F.col("text")), lambda x: x.rlike("[0-9]{4}")).alias("lines")).select("doc", F.explode(F.filter(F.array(*each), lambda x: x["value"].isNotNull())).alias("x"))
    return found.select("doc", "x.metric_key", "x.value", F.lit(115).alias("quality"), F.lit(False).alias("is_exact"))


def result_code_candidates(docs: DataFrame) -> DataFrame:
    """Revenue and net profit by their codes, in forms without tables (qualities 110 and 120)."""
    each = [F.struct(F.lit(m).alias("metric_key"), near_code(F.col("lines"), codes, anchors).alias("value"), F.lit(q).alias("quality")) for m, (codes, anchors, q) in words.RESULT_CODES.items()]
    forms = signals(docs).where("form_like AND NOT has_tables").select("doc", F.filter(plain_lines(F.col("text")), lambda x: x.rlike("2110|2400")).alias("lines"))
    found = forms.select("doc", F.explode(F.filter(F.array(*each), lambda x: x["value"].isNotNull())).alias("x"))
    return found.select("doc", "x.metric_key", "x.value", "x.quality", F.lit(True).alias("is_exact"))


# --- values on following lines --------------------------------------------------------------------------------------


def number_line(line: Column) -> Column:
    """The value of a line of numbers and nothing else, of five digits at least; null for every other line."""
    bare = line.rlike(r'^["()\-−0-9\s.,]+$') & (F.length(F.regexp_replace(line, "[^0-9]", "")) >= 5)
    return F.when(bare, valid(preferred_scanned_amount(line)))


def number_lines(lines: Column) -> Column:
    """An array of (at, value) of the lines of numbers."""
    each = F.transform(lines, lambda x, i: F.struct(i.alias("at"), number_line(x).alias("value")))
    return F.filter(each, lambda x: x["value"].isNotNull())


def following(numbers: Column, at: Column, most: int | Column, stops: Column | None = None) -> Column:
    """The value of the first line of numbers within some lines behind a place, none behind a stop."""
    within = F.filter(numbers, lambda x: (x["at"] > at) & (x["at"] <= at + most))
    if stops is not None:
        within = F.filter(within, lambda x: ~F.exists(stops, lambda s: (s > at) & (s < x["at"])))
    return first(within)["value"]


def multiline_candidates(docs: DataFrame) -> DataFrame:
    """Of forms: for each metric the value on the line of its longest keyword or else on a following line of numbers (7
    lines, for the net profit 23, up to the comprehensive result), by the line's score; of equal scores the largest amount
    (the smallest of receivables), then the first. Forms without tables give six metrics only."""
    # No filter before the lines are there: it, and one that the optimizer adds to a generator, would make the lines again,
    # and would do so before rows are dealt out.
    lines = signals(docs).select("doc", "has_tables", F.when(F.col("form_like"), clean_lines(F.col("text"))).alias("lines"))
    stop = lambda x: F.lower(x).contains(words.COMPREHENSIVE[0]) & ~contains_any(F.lower(x), ["чистая прибыль", "2400"])
    stops = F.filter(F.transform("lines", lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull())
    marked = lines.select("doc", "has_tables", "lines", number_lines(F.col("lines")).alias("numbers"), stops.alias("stops")).select("doc", "has_tables", "numbers", "stops", F.posexplode_outer("lines").alias("at", "line")).where("at IS NOT NULL")
    low, allowed = F.lower("line"), lambda m: F.col("has_tables") | m.isin(words.FORM_METRICS)
    each = F.filter(longest_keywords(low), lambda x: allowed(x["metric_key"]))
    hit = marked.select("*", F.explode(each).alias("x")).select("doc", "at", "line", "numbers", "stops", "x.*")
    rated = hit.select("*", given(label_quality(F.col("metric_key"), F.col("line"))).alias("quality"))
    profit = F.col("metric_key") == "net_profit"
    same = valid(preferred_scanned_amount(after(F.col("line"), F.col("keyword"))))
    later = following(F.col("numbers"), F.col("at"), F.when(profit, 23).otherwise(7), F.when(profit, F.col("stops")).otherwise(F.array().cast("array<int>")))
    values = F.filter(F.array(F.struct(F.lit(0).alias("kind"), same.alias("value")), F.struct(F.lit(1).alias("kind"), later.alias("value"))), lambda x: x["value"].isNotNull())
    score = line_score(F.col("line"), F.col("keyword")) + F.greatest(F.lit(0), 6 - F.col("at")) + F.floor(F.col("quality") / 20).cast("int")
    read = rated.select("doc", "metric_key", "quality", "at", score.alias("score"), F.explode(values).alias("v"))
    size = F.when(F.col("metric_key") == "accounts_receivable", -F.abs("v.value")).otherwise(F.abs("v.value"))
    best = F.max_by(F.struct(F.col("v.value").alias("value"), "quality"), F.struct("score", size, -F.col("at"), -F.col("v.kind")))
    return read.groupBy("doc", "metric_key").agg(best.alias("b")).select("doc", "metric_key", "b.value", "b.quality", F.lit(False).alias("is_exact"))


# --- patterns -------------------------------------------------------------------------------------------------------

PATTERN_NUMBER = r"([-(]?\$?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?\)?|[-(]?\$?[0-9]{1,3}(?:[ \t\xa0][0-9]{3})+(?:[.,][0-9]+)?\)?|[-(]?\$?[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?\)?|[-(]?\$?[0-9]+(?:[.,][0-9]+)?\)?)"


def broad_candidates(docs: DataFrame) -> DataFrame:
    """By the last patterns over the whole text: of each metric the first that gives an amount. A number may stand behind a
    cell mark, or within some characters that are no digits; a form number is none. Forms without tables give six metrics only."""
    gap = lambda n: F.lit(r"\s*\|\s*" if n is None else rf"[^0-9]{{0,{n}}}").alias("gap")
    table = F.array(*[F.struct(F.lit(m).alias("metric_key"), F.lit(i).alias("no"), F.lit(p).alias("phrase"), gap(n)) for m, ps in words.BROAD.items() for i, (p, n) in enumerate(ps)])
    allowed = lambda m: F.col("has_tables") | ~F.col("form_like") | m.isin(words.FORM_METRICS)
    text = signals(docs).select("doc", "has_tables", "form_like", F.lower(plain_quotes(F.col("text"))).alias("low"))
    named = text.select("doc", "low", F.explode(F.filter(table, lambda x: F.col("low").contains(x["phrase"]) & allowed(x["metric_key"]))).alias("x"))
    raw = F.call_function("regexp_extract", F.col("low"), F.concat(F.lit(r"\Q"), "x.phrase", F.lit(r"\E"), "x.gap", F.lit(PATTERN_NUMBER)), F.lit(1))
    amount = let(raw, lambda r: F.when(~F.regexp_replace(r, "[^0-9]", "").rlike("^07[0-9]{4}"), parse_amount(r)))
    read = named.select("doc", "x.metric_key", "x.no", "x.phrase", given(amount).alias("value"))
    rated = read.select("doc", "metric_key", "no", "value", given(label_quality(F.col("metric_key"), F.col("phrase"))).alias("quality"))
    best = rated.groupBy("doc", "metric_key").agg(F.min_by(F.struct("value", "quality"), "no").alias("b"))
    return best.select("doc", "metric_key", "b.value", "b.quality", F.lit(False).alias("is_exact"))


# --- totals of a form's sections ------------------------------------------------------------------------------------


def section_total(lines: Column, marks: list[str], back: int = 8, ahead: int = 1) -> Column:
    """The largest value on a line of the section's total; else, at the first such line that has some near it, the largest
    on the lines around it (1000 at least), other totals and signatures left out."""
    low = lambda x: F.lower(x)
    own = F.array_max(F.filter(F.transform(F.filter(lines, lambda x: contains_any(low(x), marks)), preferred_scanned_amount), lambda v: valid_value(v)))
    places = F.filter(F.transform(lines, lambda x, i: F.when(contains_any(low(x), marks), i)), lambda i: i.isNotNull())
    value = lambda x: F.when(~contains_any(low(x), words.NEAR_TOTALS_NOT), preferred_scanned_amount(x))
    near = lambda i: F.array_max(F.filter(F.transform(F.concat(span(lines, i - back, i), span(lines, i + 1, i + 1 + ahead)), value), lambda v: valid_value(v) & (v >= 1000)))
    return F.coalesce(own, first(F.filter(F.transform(places, near), lambda v: v.isNotNull())))


def long_term_total(lines: Column, plain: Column, short_term: Column) -> Column:
    """Of the section's total and the value behind its code, those that differ from the short-term total: the smaller one
    where they are far apart, else the first."""
    both = F.array(section_total(lines, words.SECTION_TOTALS["long_term_liabilities"]), near_code(plain, ["1400"], ["итого по разделу iv", "долгосрочн"]))
    apart = lambda v: F.coalesce(F.abs(v - short_term) > F.greatest(F.lit(1.0), F.abs(short_term) * 0.000001), F.lit(True))
    left = F.filter(both, lambda v: valid_value(v) & apart(v))
    far = lambda x: (F.array_min(x) > 0) & (F.array_max(x) / F.array_min(x) >= 1.5)
    return let(left, lambda x: F.when(F.size(x) == 2, F.when(far(x), F.array_min(x)).otherwise(first(x))).otherwise(first(x)))


def section_candidates(docs: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Totals of the sections V, IV and III of balances (qualities 110, 105, 105), each where no earlier candidate (doc,
    metric_key, value) has the metric; equity only without tables. The short-term total decides over the long-term one."""
    base = signals(docs).where("balance_like").select("doc", "has_tables", clean_lines(F.col("text")).alias("lines"), F.filter(plain_lines(F.col("text")), lambda x: x.contains("1400")).alias("plain"))
    if earlier is None:
        had = base.withColumn("had", F.create_map().cast("map<string,double>"))
    else:
        one = earlier.where(F.col("metric_key").isin(list(words.SECTION_TOTALS))).groupBy("doc", "metric_key").agg(F.max("value").alias("value"))
        kept = one.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("metric_key", "value"))).alias("had"))
        had = base.join(kept, "doc", "left").withColumn("had", F.coalesce("had", F.create_map().cast("map<string,double>")))
    there = lambda m: F.map_contains_key("had", m)
    short = had.withColumn("short", F.when(~there("short_term_liabilities"), section_total(F.col("lines"), words.SECTION_TOTALS["short_term_liabilities"])))
    known = F.coalesce(F.col("had")["short_term_liabilities"], F.col("short"))
    out = short.select(
        "doc",
        F.array(
            F.struct(F.lit("short_term_liabilities").alias("metric_key"), F.col("short").alias("value"), F.lit(110).alias("quality")),
            F.struct(F.lit("long_term_liabilities").alias("metric_key"), F.when(~there("long_term_liabilities"), long_term_total(F.col("lines"), F.col("plain"), known)).alias("value"), F.lit(105).alias("quality")),
            F.struct(F.lit("equity").alias("metric_key"), F.when(~there("equity") & ~F.col("has_tables"), section_total(F.col("lines"), words.SECTION_TOTALS["equity"])).alias("value"), F.lit(105).alias("quality")),
        ).alias("each"),
    )
    return out.select("doc", F.explode(F.filter("each", lambda x: valid_value(x["value"]))).alias("x")).select("doc", "x.*", F.lit(True).alias("is_exact"))


# --- the section of results -----------------------------------------------------------------------------------------


def results_section(lines: Column) -> Column:
    """The lines from the first heading of the results up to the next statement, or null."""
    at = lambda lines, marks, least: F.array_min(F.filter(F.transform(lines, lambda x, i: F.when((i > least) & some_of(F.lower(x), marks), i)), lambda i: i.isNotNull()))
    section = lambda lines: let(at(lines, words.RESULTS_START, F.lit(-1)), lambda b: F.when(b.isNotNull(), span(lines, b, F.coalesce(at(lines, words.RESULTS_END, b), F.size(lines)))))
    return let(lines, section)


def behind_anchor(line: Column, anchors: list[str]) -> Column:
    return F.coalesce(*[F.when(F.lower(line).contains(a), valid(preferred_scanned_amount(after(line, a)))) for a in anchors])


def first_named(lines: Column, numbers: Column, marks: list[str], anchors: list[str], most: int, stops: Column | None, same_quality: int, later_quality: int) -> Column:
    """(value, quality) at the first line with a mark that has a value behind an anchor or on the lines after it."""

    def read(line: Column, at: Column) -> Column:
        same, later = behind_anchor(line, anchors), following(numbers, at, most, stops)
        found = F.when(same.isNotNull(), F.struct(same.alias("value"), F.lit(same_quality).alias("quality"))).when(later.isNotNull(), F.struct(later.alias("value"), F.lit(later_quality).alias("quality")))
        return F.when(contains_any(F.lower(line), marks), found)

    return first(F.filter(F.transform(lines, read), lambda x: x.isNotNull()))


def result_section_candidates(docs: DataFrame) -> DataFrame:
    """Revenue and net profit from the section of results of forms without tables: by code (110, 120), else on the line of
    a name (108, 110), else on the lines of numbers after it (104, 106); where the profit is named without a value, the
    comprehensive result (112)."""
    forms = signals(docs).select("doc", given(F.when(F.col("form_like") & ~F.col("has_tables"), results_section(clean_lines(F.col("text"))))).alias("lines"))
    whole = lambda x: contains_any(F.lower(x), words.COMPREHENSIVE)
    each = forms.select("doc", "lines", number_lines(F.col("lines")).alias("numbers"), F.filter(F.transform("lines", lambda x, i: F.when(whole(x), i)), lambda i: i.isNotNull()).alias("stops"))
    lines, numbers, stops = F.col("lines"), F.col("numbers"), F.col("stops")
    coded = lambda m, q: let(near_code(lines, words.RESULT_CODES[m][0], words.RESULT_CODES[m][1][:3]), lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(q).alias("quality"))))
    revenue = F.coalesce(coded("revenue", 110), first_named(lines, numbers, ["выручка", "revenue"], ["выручка", "revenue"], 5, None, 108, 104))
    names = ["чистая прибыль", "net profit", "net income"]
    named = F.exists(lines, lambda x: contains_any(F.lower(x), [*names, "2400"]))
    at = F.try_element_at(stops, F.lit(1))
    total = F.coalesce(valid(preferred_scanned_amount(F.get(lines, at))), following(numbers, at, 3))
    rest = F.when(named & total.isNotNull(), F.struct(total.alias("value"), F.lit(112).alias("quality")))
    profit = F.coalesce(coded("net_profit", 120), first_named(lines, numbers, [*names, "2400"], names, 6, stops, 110, 106), rest)
    both = F.array(F.struct(F.lit("revenue").alias("metric_key"), revenue.alias("x")), F.struct(F.lit("net_profit").alias("metric_key"), profit.alias("x")))
    out = each.select("doc", F.explode(F.filter(both, lambda x: x["x"].isNotNull())).alias("f"))
    return out.select("doc", "f.metric_key", "f.x.value", "f.x.quality", F.lit(True).alias("is_exact"))


# --- rows of tables -------------------------------------------------------------------------------------------------


def cells_of(rows: DataFrame) -> Column:
    return F.transform("cells", lambda c: F.trim(F.lower(c)))


def labelled_values(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """doc, row_no, metric_key, label, value: rows of three cells or more by their first cell, of whatever quality. The first
    label in order decides, even if its row then gives nothing; amounts below 1000 are page numbers."""
    label = F.lower(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    table = F.array(*[F.struct(F.lit(k.lower()).alias("label"), F.lit(m).alias("metric_key")) for k, m in labels.items()])
    metric = let(label, lambda t: F.try_element_at(F.filter(table, lambda x: t.contains(x["label"])), F.lit(1)))["metric_key"]
    hit = rows.where(F.size("cells") >= 3).select("doc", "row_no", metric.alias("metric_key"), label.alias("label"), F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))).alias("rest")).where("metric_key IS NOT NULL")
    return hit.select("doc", "row_no", "metric_key", "label", given(valid(first_number(F.col("rest")))).alias("value")).where("abs(value) >= 1000")


def by_label(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """doc, row_no, metric_key, value, quality: labelled values, less those whose label must not give its metric."""
    rated = labelled_values(rows, labels).select("doc", "row_no", "metric_key", "value", label_quality(F.col("metric_key"), F.col("label")).alias("quality"))
    return rated.where("quality IS NOT NULL")


def by_national_label(rows: DataFrame) -> DataFrame:
    return by_label(rows, words.NATIONAL_LABELS)


def by_english_label(rows: DataFrame) -> DataFrame:
    return by_label(rows, words.LABELS)


def by_approximate_label(rows: DataFrame) -> DataFrame:
    """doc, row_no, metric_key, value, quality (75), reason: rows whose label stands for another metric."""
    label = F.lower(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    to = F.coalesce(*[F.when(label.contains(k), F.struct(F.lit(m).alias("metric_key"), F.lit(r).alias("reason"))) for k, (m, r) in words.APPROXIMATE_LABELS.items()])
    hit = rows.where(F.size("cells") >= 3).select("doc", "row_no", to.alias("to"), F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))).alias("rest")).where("to IS NOT NULL")
    return hit.select("doc", "row_no", "to.metric_key", given(valid(first_number(F.col("rest")))).alias("value"), F.lit(75).alias("quality"), "to.reason").where("abs(value) >= 1000")


def by_scanned_cell(rows: DataFrame) -> DataFrame:
    """doc, row_no, metric_key, value, quality: of rows that hold a scanned text, for each metric the first keyword with a
    valid number within 50 characters that are no digits. Keywords with brackets never match there."""
    number = r"([0-9]{1,3}(?:[ \t\xa0][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)"
    scanned = rows.where((F.size("cells") >= 2) & (F.get("cells", F.lit(0)) == "OCR_TEXT")).select("doc", "row_no", F.lower(F.get("cells", F.lit(1))).alias("low"))
    named = scanned.select("doc", "row_no", "low", F.explode(F.filter(single_keywords(), lambda x: F.col("low").contains(x["keyword"]) & ~x["keyword"].contains("("))).alias("x"))
    raw = F.call_function("regexp_extract", F.col("low"), F.concat(F.lit(r"\Q"), "x.keyword", F.lit(rf"\E[^0-9]{{0,50}}{number}")), F.lit(1))
    read = named.select("doc", "row_no", "x.metric_key", "x.no", "x.keyword", given(valid(parse_amount(raw))).alias("value"))
    rated = read.select("doc", "row_no", "metric_key", "no", "value", label_quality(F.col("metric_key"), F.col("keyword")).alias("quality")).where("quality IS NOT NULL")
    best = rated.groupBy("doc", "row_no", "metric_key").agg(F.min_by(F.struct("value", "quality"), "no").alias("b"))
    return best.select("doc", "row_no", "metric_key", "b.value", "b.quality")


def heading_totals(rows: DataFrame, reach: int = 29) -> DataFrame:
    """doc, metric_key, value, quality (112): totals without a label of their own below the heading of a section.

    rows: doc, table_no, row_no, cells. A heading is carried forward over the rows of its table up to the next heading or the
    section's end. Within its reach, rows without a label or with a word for totals count: nearer ones more, those in whole
    balances more, those in restated tables less. A mark counts where it stands whole in one row.

    Marks and amounts are read where the row is; a row with neither has no part in the result and is not shuffled."""
    low = F.col("low")
    label = F.trim(F.lower(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))))
    marks = {"balance": contains_any(low, WHOLE[0]), "sources": contains_any(low, WHOLE[1]), "restated": contains_any(low, words.RESTATED), "bare": label.isin("", "-", "—", "–"), "total": contains_any(low, ["итого", "total"])}
    for metric, (headings, ends, longer) in words.SECTIONS.items():
        heads = contains_any(low, headings)
        marks |= {f"bar of {metric}": heads | contains_any(low, ends), f"own {metric}": heads & ~contains_any(low, longer)}
    bit = {name: 1 << i for i, name in enumerate(marks)}
    has = lambda *names: F.col("marks").bitwiseAND(F.lit(sum(bit[n] for n in names))) != 0
    base = rows.select("doc", "table_no", "row_no", "cells", F.lower(F.array_join("cells", " ")).alias("low"))
    marked = base.select("doc", "table_no", "row_no", "cells", reduce(lambda x, y: x + y, [F.when(mark, bit[name]).otherwise(0) for name, mark in marks.items()]).alias("marks"))
    told = marked.select("doc", "table_no", "row_no", "cells", F.explode(F.filter(F.array("marks"), lambda m: m != 0)).alias("marks"))
    amount = F.when(has("bare", "total"), valid(first_number(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))))))
    kept = F.filter(F.array(F.struct("marks", amount.alias("value"))), lambda x: x["value"].isNotNull() | (x["marks"].bitwiseAND(F.lit(~(bit["bare"] | bit["total"]))) != 0))
    narrow = told.select("doc", "table_no", "row_no", F.explode(kept).alias("x")).select("doc", "table_no", "row_no", "x.marks", "x.value")

    table = Window.partitionBy("doc", "table_no")
    before = table.orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.max(has("balance")).over(table) & F.max(has("sources")).over(table)
    bonus = F.when(whole, 15).otherwise(0) - F.when(F.max(has("restated")).over(table), 35).otherwise(0)
    last = lambda m: F.last(F.when(has(f"bar of {m}"), F.struct("row_no", has(f"own {m}").alias("own"))), ignorenulls=True).over(before)
    above = F.array(*[F.struct(F.lit(m).alias("metric_key"), F.when(~has(f"bar of {m}"), last(m)).alias("bar")) for m in words.SECTIONS])
    seen = narrow.select("table_no", "row_no", "doc", "value", has("total").alias("total"), bonus.alias("bonus"), above.alias("above"))
    below = seen.where("value IS NOT NULL").select("*", F.explode(F.filter("above", lambda x: x["bar"]["own"] & (F.col("row_no") - x["bar"]["row_no"] <= reach))).alias("x"))
    score = 100 + F.col("bonus") - (F.col("row_no") - F.col("x.bar.row_no")) - F.when(F.col("total"), 0).otherwise(4)
    best = F.max_by("value", F.struct(score.alias("score"), F.abs("value"), -F.col("table_no"), -F.col("row_no")))
    return below.groupBy("doc", F.col("x.metric_key").alias("metric_key")).agg(best.alias("value")).select("doc", "metric_key", "value", F.lit(112).alias("quality"))


WHOLE = words.WHOLE_BALANCE


def table_signals(rows: DataFrame) -> DataFrame:
    """doc, table_no, n_rows, financial, statement_rows, keyword_rows, numeric_rows of each table (doc, table_no, row_no,
    cells). Financial are tables with two words of statements (in all their rows together), or with one and a row with
    digits, or with five rows that have a cell of six digits. A row's first two cells are its label."""
    cells = F.filter(F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    base = rows.select("doc", "table_no", cells.alias("c"))
    has = some_of
    text, label = F.lower(F.array_join("c", " ")), F.lower(F.array_join(F.slice("c", 1, 2), " "))
    values = F.when(F.size("c") > 1, F.slice("c", 2, F.greatest(F.size("c"), F.lit(1)))).otherwise(F.col("c"))
    number = first_number(values)
    strong = has(label, words.STRONG_ROWS) & valid_value(first_number(F.slice("c", 2, F.greatest(F.size("c"), F.lit(1)))))
    some = F.size("c") > 0
    words_of = let(text, lambda t: F.filter(F.array(*map(F.lit, words.TABLE_WORDS)), lambda p: t.contains(p)))
    each = base.select(
        "doc", "table_no", words_of.alias("named"), (some & number.isNotNull()).alias("numeric"), (some & strong).alias("statement"), F.exists("c", lambda c: c.rlike("[0-9]")).alias("digits"),
        F.exists("c", lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")) >= 6).alias("large"), (has(text, words.STRONG_ROWS).cast("int") - has(text, words.TABLE_NOISE).cast("int")).alias("points"),
    )
    tables = each.groupBy("doc", "table_no").agg(
        F.count("*").alias("n_rows"), F.size(F.array_distinct(F.flatten(F.collect_set("named")))).alias("n_words"), F.count_if("large").alias("n_large"), F.count_if("digits").alias("n_digits"),
        F.count_if("statement").alias("statement_rows"), F.sum("points").alias("keyword_rows"), F.count_if("numeric").alias("numeric_rows"),
    )
    financial = (F.col("n_words") >= 2) | ((F.col("n_words") >= 1) & (F.col("n_digits") >= 1)) | (F.col("n_large") >= 5)
    return tables.select("doc", "table_no", "n_rows", financial.alias("financial"), "statement_rows", "keyword_rows", "numeric_rows")


def best_tables(signals: DataFrame, more_than: int = 20, keep: int = 10) -> DataFrame:
    """Of documents with more tables than that, the best by statement rows, rows with words, numeric rows and rows."""
    order = Window.partitionBy("doc").orderBy(*(F.desc(c) for c in ("statement_rows", "keyword_rows", "numeric_rows", "n_rows")), "table_no")
    ranked = signals.withColumns({"of": F.count("*").over(Window.partitionBy("doc")), "place": F.row_number().over(order)})
    return ranked.where((F.col("of") <= more_than) | (F.col("place") <= keep)).drop("of", "place")


# --- sanity of the results ------------------------------------------------------------------------------------------


def results_sanity(pairs: DataFrame, most: float = 0.6) -> DataFrame:
    """pairs with revenue and net_profit as they stay, and events (metric_key, reason, before, after).

    pairs: revenue, net_profit (each value, match_type, is_exact, quality, or null), revenue_code, profit_code, standalone.
    Where the margin is above the limit: values by code take both places if both are there; else, unless either comes from
    an exact row of a table, the pair with the lowest margin; if that is above the limit too, the less reliable one goes."""
    r, p = F.col("revenue"), F.col("net_profit")
    rank = lambda c: F.coalesce(let(c, lambda x: F.when(x.isNotNull(), priority_of(x))), F.lit(0))
    margin = lambda a, b: F.abs(b) / a
    wrong = F.coalesce((r["value"] > 0) & (margin(r["value"], p["value"]) > most) & ~F.col("standalone"), F.lit(False))
    code_r, code_p = F.col("revenue_code"), F.col("profit_code")
    both = code_r.isNotNull() & code_p.isNotNull()
    fixed = (rank(r) >= 3) | (rank(p) >= 3)
    pair = lambda a, b, n: F.struct(margin(a, b).alias("margin"), F.lit(n).alias("n"), a.alias("r"), b.alias("p"))
    usable = F.filter(F.array(pair(r["value"], p["value"], 0), pair(code_r, p["value"], 1), pair(r["value"], code_p, 2)), lambda x: x["margin"].isNotNull() & (x["r"] > 0))
    out = pairs.withColumn("_case", F.when(~wrong, "kept").when(both, "codes").when(fixed, "kept").otherwise("best")).withColumn("_best", F.array_min(usable))
    new_r = F.when(F.col("_case") == "codes", code_r).when((F.col("_case") == "best") & (F.col("_best.r") != r["value"]), F.col("_best.r"))
    new_p = F.when(F.col("_case") == "codes", code_p).when((F.col("_case") == "best") & (F.col("_best.p") != p["value"]), F.col("_best.p"))
    out = out.withColumns({"_new_r": new_r, "_new_p": new_p})
    by_code = lambda v: F.struct(v.alias("value"), F.lit("text").alias("match_type"), F.lit(True).alias("is_exact"), F.lit(120).alias("quality"))
    reliability = lambda c, new: rank(c) * 100 + F.when(new.isNotNull(), 120).otherwise(c["quality"])
    still = (F.col("_case") == "best") & (F.col("_best.margin") > most)
    rel_r, rel_p = reliability(r, F.col("_new_r")), reliability(p, F.col("_new_p"))
    loser = F.when(still, F.when(rel_r < rel_p, "revenue").when(rel_p < rel_r, "net_profit").when(code_p.isNotNull() & code_r.isNull(), "revenue").otherwise("net_profit"))
    out = out.withColumn("_loser", loser)
    kept = lambda c, new, m: F.when(F.coalesce(F.col("_loser") != m, F.lit(True)), F.when(new.isNotNull(), by_code(new)).otherwise(c))
    replaced = lambda m, c, new: F.when(new.isNotNull(), F.struct(F.lit(m).alias("metric_key"), F.lit(f"sanity_pnl_replaced_{m}_with_code").alias("reason"), c["value"].alias("before"), new.alias("after")))
    dropped = F.when(
        F.col("_loser").isNotNull(),
        F.struct(
            F.col("_loser").alias("metric_key"), F.concat(F.lit("sanity_pnl_conflict_drop_"), "_loser").alias("reason"),
            F.when(F.col("_loser") == "revenue", F.coalesce("_new_r", r["value"])).otherwise(F.coalesce(F.col("_new_p"), p["value"])).alias("before"), F.lit(None).cast("double").alias("after"),
        ),
    )
    events = F.array_compact(F.array(replaced("revenue", r, F.col("_new_r")), replaced("net_profit", p, F.col("_new_p")), dropped))
    return out.withColumns({"events": events, "revenue": kept(r, F.col("_new_r"), "revenue"), "net_profit": kept(p, F.col("_new_p"), "net_profit")}).drop("_case", "_best", "_new_r", "_new_p", "_loser")


def priority_of(x: Column) -> Column:
    """The priority of a candidate given as a struct."""
    exact = F.when(x["match_type"] == "table", 3).otherwise(2)
    return F.when(x["is_exact"], exact).when(x["match_type"] == "text", 2).when(x["match_type"] == "table", 1).otherwise(0)


# --- all of them ----------------------------------------------------------------------------------------------------


def line_candidates(docs: DataFrame) -> DataFrame:
    """By the best line with a keyword; forms without tables give six metrics only."""
    marked = signals(docs)
    bare = F.col("form_like") & ~F.col("has_tables")
    both = by_line(marked.where(~bare)).unionByName(by_line(marked.where(bare)).where(F.col("metric_key").isin(words.FORM_METRICS)))
    return both.select("doc", "metric_key", "value", "quality", F.lit(False).alias("is_exact"))


def gated(each: DataFrame, gates: list[int]) -> DataFrame:
    """Candidates of a gated stage count only where no earlier stage has the metric (values from texts have priority 2)."""
    ahead = Window.partitionBy("doc", "metric_key").orderBy("stage").rangeBetween(Window.unboundedPreceding, -1)
    return each.withColumn("n_before", F.count("*").over(ahead)).where(~F.col("stage").isin(gates) | (F.col("n_before") == 0)).drop("n_before")


def text_candidates(docs: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """All candidates of the texts with their stage: codes (1), codes of the results (2), following lines (3), lines (4),
    patterns (5), totals of sections (6), the section of results (7). Stages 1, 3, 4 and 5 give a metric only where no
    earlier stage did, nor an earlier candidate (doc, metric_key, value, priority) of priority 2; stage 6 where there is none at all."""
    stages = [code_candidates, result_code_candidates, multiline_candidates, line_candidates, broad_candidates]
    each = reduce(DataFrame.unionByName, [f(docs).select(*CANDIDATE, F.lit(i + 1).alias("stage")) for i, f in enumerate(stages)])
    if earlier is not None:
        known = earlier.where("priority >= 2").select("doc", "metric_key").distinct().withColumn("sure", F.lit(True))
        each = each.join(known, ["doc", "metric_key"], "left").where((F.col("stage") == 2) | F.col("sure").isNull()).drop("sure")
    each = gated(each, [1, 3, 4, 5])
    had = each.select("doc", "metric_key", "value") if earlier is None else each.select("doc", "metric_key", "value").unionByName(earlier.select("doc", "metric_key", "value"))
    rest = section_candidates(docs, had).select(*CANDIDATE, F.lit(6).alias("stage")).unionByName(result_section_candidates(docs).select(*CANDIDATE, F.lit(7).alias("stage")))
    return each.unionByName(rest)
