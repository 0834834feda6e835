"""Metric values read from lines, windows of text and table rows by their keywords, and what is read or shown of a document.

The keywords are a fixed list, so they are tried within the row; only candidates (no texts) are shuffled."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import words
from statloom.functions.numbers import last_amount, let, masked, numbers_in, preferred_amount, valid_value
from statloom.operators.decisions import label_quality
from statloom.operators.extraction import first_number
from statloom.operators.text import contains_any, lines, plain_quotes, squeezed

KEYWORDS = words.KEYWORDS


def given(x: Column) -> Column:
    """The rows where x is there. A generator, since a filter would evaluate x once more."""
    return F.explode(F.array_compact(F.array(x)))


def strings(parts: list[str]) -> Column:
    return F.array(*[F.lit(p) for p in parts])


def keyword_table(longest_first: bool = False) -> Column:
    """(metric_key, keywords) of all metrics as one constant: code stays small, however many keywords there are."""
    order = (lambda ks: sorted(ks, key=len, reverse=True)) if longest_first else list
    return F.array(*[F.struct(F.lit(m).alias("metric_key"), strings(order(ks)).alias("keywords")) for m, ks in KEYWORDS.items()])


def single_keywords() -> Column:
    """(metric_key, no, keyword), a place for each keyword."""
    return F.array(*[F.struct(F.lit(m).alias("metric_key"), F.lit(i).alias("no"), F.lit(k).alias("keyword")) for m, ks in KEYWORDS.items() for i, k in enumerate(ks)])


def any_keyword() -> str:
    """A pattern of all keywords by their common beginnings; of those that hold a shorter one, the shorter one."""
    tree: dict = {}
    all_ = {k for ks in KEYWORDS.values() for k in ks}
    for k in sorted(k for k in all_ if not any(o != k and o in k for o in all_)):
        node = tree
        for c in k:
            node = node.setdefault(c, {})

    def pattern(node: dict) -> str:
        parts = [re.escape(c) + pattern(below) for c, below in node.items()]
        return "".join(parts) if len(parts) < 2 else "(?:" + "|".join(parts) + ")"

    return pattern(tree)


def longest_keywords(low: Column) -> Column:
    """metric_key, keyword: the longest keyword of each metric that a text in lower case has. One pattern passes over the
    texts that have none."""
    first = lambda x, t: F.try_element_at(F.filter(x["keywords"], lambda k: t.contains(k)), F.lit(1))
    each = lambda t: F.transform(keyword_table(True), lambda x: F.struct(x["metric_key"].alias("metric_key"), first(x, t).alias("keyword")))
    found = let(low, lambda t: F.when(t.rlike(any_keyword()), each(t)))
    return F.filter(found, lambda x: x["keyword"].isNotNull())


def line_score(line: Column, keyword: Column) -> Column:
    """How much a line looks like a row of a statement rather than a sentence."""
    return let(F.struct(F.lower(line).alias("low"), F.size(numbers_in(line)).alias("n"), line.alias("line"), keyword.alias("keyword")), lambda x: score_of(x["low"], x["n"], x["line"], x["keyword"]))


def score_of(low: Column, n: Column, line: Column, keyword: Column) -> Column:
    """line_score for a line, the same in lower case, and how many numbers it has."""
    at = F.instr(low, keyword) - 1
    shared = (keyword == "total liabilities") & low.rlike("(stock|share)holders['’] equity")
    return (
        F.least(F.lit(4), F.size(F.split(keyword, " ")) - 1)
        + F.when(at == 0, 5).when(at < 12, 3).when(at < 32, 1).otherwise(-1)
        + F.when(line.contains("$"), 2).otherwise(0)
        + F.when(n.between(2, 4), 2).when(n == 1, 1).when(n > 6, -2).otherwise(0)
        + F.when(F.length(low) <= 120, 1).when(F.length(low) > 220, -2).otherwise(0)
        - F.when(line.contains("%"), 3).otherwise(0)
        - F.when(contains_any(low, words.NARRATIVE), 5).otherwise(0)
        - F.when(shared, 4).otherwise(0)
    )


def by_line(docs: DataFrame) -> DataFrame:
    """doc, metric_key, value, quality, score: for each metric the line with the best score; of equals the one with the
    largest amount, then the first."""
    each = lines(docs).select("doc", "line_no", plain_quotes(squeezed(F.col("line"))).alias("line"))
    named = each.select("*", F.explode(longest_keywords(F.lower("line"))).alias("x")).select("doc", "line_no", "line", "x.metric_key", "x.keyword")
    # After the keyword's end; lower case keeps the length of these texts' letters.
    after = F.substring(F.col("line"), F.instr(F.lower("line"), F.col("keyword")) + F.length("keyword"), F.length("line"))
    rated = named.select("*", given(label_quality(F.col("metric_key"), F.col("line"))).alias("quality"))
    read = rated.select("doc", "line_no", "metric_key", "quality", given(preferred_amount(after)).alias("value"), line_score(F.col("line"), F.col("keyword")).alias("own"))
    read = read.withColumn("score", F.col("own") + F.floor(F.col("quality") / 20).cast("int"))
    best = F.max_by(F.struct("value", "quality", "score"), F.struct("score", F.abs("value"), -F.col("line_no")))
    return read.groupBy("doc", "metric_key").agg(best.alias("b")).select("doc", "metric_key", "b.value", "b.quality", "b.score")


def near_keyword(docs: DataFrame, width: int = 60) -> DataFrame:
    """doc, metric_key, value: the first number within some characters after a metric's keyword, wherever it stands; an
    earlier keyword of the list decides, then an earlier place."""
    named = docs.select("doc", F.lower("text").alias("low")).select("doc", "low", F.explode(F.filter(single_keywords(), lambda x: F.col("low").contains(x["keyword"]))).alias("x"))
    pattern = F.concat(F.lit(r"\Q"), F.col("x.keyword"), F.lit(rf"\E(?=([\s\S]{{0,{width}}}))"))
    windows = named.select("doc", "x.metric_key", "x.no", F.regexp_extract_all("low", pattern, F.lit(1)).alias("windows"))
    amounts = F.filter(F.transform("windows", preferred_amount), lambda v: v.isNotNull())
    read = windows.select("doc", "metric_key", "no", F.explode(F.slice(amounts, 1, 1)).alias("value"))
    return read.groupBy("doc", "metric_key").agg(F.min_by("value", "no").alias("value"))


def by_any_cell(rows: DataFrame) -> DataFrame:
    """doc, row_no, metric_key, value, quality, is_exact, is_total: for each metric with a keyword in the row, the amount right
    of the first cell that has one (of the first cell, if the keyword goes over several), else the row's last number."""
    text = F.lower(F.array_join("cells", " "))
    some = lambda c, ks: F.exists(ks, lambda k: c.contains(k))
    named = F.filter(keyword_table(), lambda x: some(F.col("row"), x["keywords"]))
    hit = rows.select("doc", "row_no", "cells", text.alias("row")).select("doc", "row_no", "cells", "row", F.explode(named).alias("x")).select("*", F.transform("cells", lambda c: F.trim(F.lower(c))).alias("low"))
    places = F.filter(F.transform("low", lambda c, i: F.when(some(c, F.col("x.keywords")), i)), lambda i: i.isNotNull())
    placed = hit.withColumn("at", F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(0)))
    label = F.coalesce(F.nullif(F.get("low", F.col("at")), F.lit("")), F.col("row"))
    right = F.slice("cells", F.col("at") + 2, F.greatest(F.size("cells"), F.lit(1)))
    value = let(F.coalesce(first_number(right), last_amount(F.array_join("cells", " "))), lambda v: F.when(valid_value(v), v))
    own = F.coalesce(F.get("low", F.col("at")), F.lit(""))
    total = own.startswith("итого") | own.startswith("total ")
    out = placed.select("doc", "row_no", "x.metric_key", "x.keywords", given(value).alias("value"), label.alias("label"), own.alias("own"), total.alias("is_total"))
    read = out.select("doc", "row_no", "metric_key", "value", label_quality(F.col("metric_key"), F.col("label")).alias("quality"), F.array_contains("keywords", F.col("own")).alias("is_exact"), "is_total")
    return read.where("quality IS NOT NULL")


def enough_pages(pages: DataFrame, least: int = 5) -> DataFrame:
    """doc, enough_at: the first page (from the fifth on) by which a document has shown its balance, its results, five
    kinds of rows and its liabilities; null if none does. A mark counts where it stands whole on one page."""
    low = F.lower("text")
    w = Window.partitionBy("doc").orderBy("page")
    seen = lambda parts: F.max(contains_any(low, parts)).over(w)
    owed = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [seen(forms) for forms in parts]) for parts in words.LIABILITY_MARKS])
    n_rows = reduce(lambda a, b: a + b, [seen([m]).cast("int") for m in words.ROW_MARKS])
    enough = (F.col("page") >= least) & seen(words.BALANCE_MARKS) & seen(words.RESULT_MARKS) & (n_rows >= 5) & owed
    marked = pages.where("text IS NOT NULL AND page IS NOT NULL").select("doc", "page", enough.alias("enough"))
    return marked.groupBy("doc").agg(F.min(F.when(F.col("enough"), F.col("page"))).alias("enough_at"))


def demo_view(analyses: DataFrame, demo: Column) -> DataFrame:
    """Stored analyses as a demonstration shows them: digits of metrics and ratios (maps of amounts) masked, the text hidden,
    all else kept; where demo is false, amounts are only printed."""
    shown = lambda c: F.transform_values(c, lambda _, v: F.when(demo, masked(v)).otherwise(v.cast("string")))
    return analyses.withColumns({"metrics": shown("metrics"), "ratios": shown("ratios"), "text": F.when(demo & F.col("text").isNotNull(), words.HIDDEN_TEXT).otherwise(F.col("text"))})
