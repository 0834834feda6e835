"""What ratios are computed from: average-balance candidates, the debt basis, coverage, and tables from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLES = "array<struct<flavor:string,rows:array<array<string>>>>"


def average_candidates(linked: DataFrame, keys: list[str], base: str) -> DataFrame:
    """keys, kind, value, state: opening, closing and their mean, which is ready only if both are."""
    opening, closing = F.col(f"opening_{base}"), F.col(base)
    mean = (opening + closing) / 2
    row = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.when(v.isNull(), "missing").otherwise("ready").alias("state"))
    return linked.select(*keys, F.explode(F.array(row("opening", opening), row("closing", closing), row("synthetic", mean))).alias("c")).select(*keys, "c.*")


def debt_basis(lease: Column, borrowings: Column, liabilities: Column, wanted: str) -> Column:
    """resolved, or why a leverage has no basis: lease debt may not be mixed in, both bases are ambiguous."""
    has = lambda c: c.isNotNull()
    other = has(liabilities) if wanted == "debt_only" else has(borrowings)
    own = has(borrowings) if wanted == "debt_only" else has(liabilities)
    return (
        F.when(has(lease), "MATH_DEBT_LEASE_LIABILITY_MIXING_FORBIDDEN").when(own & other, "MATH_DEBT_MIXED_BASIS").when(own, "resolved")
        .when(other, "MATH_INVALID_BASIS").otherwise("MATH_RESOLVER_NO_CANDIDATE")
    )


def liabilities_from_parts(long: Column, short: Column, assets: Column, equity: Column) -> Column:
    """The parts' sum, if it is 2 % of assets at least and within 5 % (or 1000) of assets less equity."""
    total, gap = long + short, assets - equity
    return F.when((total >= 0.02 * assets) & (F.abs(total - gap) <= F.greatest(F.lit(1000.0), 0.05 * F.abs(gap))), total)


def without_small_totals(total: Column, *parts: Column) -> Column:
    """A total smaller than its largest part is dropped."""
    return F.when(F.coalesce(total >= F.greatest(*parts), F.lit(True)), total)


def rows_of(documents: DataFrame, json: str = "tables") -> DataFrame:
    """doc, table_no, flavor, row_no, cells: ragged table rows from JSON, by a fixed schema."""
    each = documents.select("doc", F.posexplode(F.from_json(json, TABLES)).alias("table_no", "t"))
    return each.select("doc", "table_no", "t.flavor", F.posexplode("t.rows").alias("row_no", "cells"))


def best_tables(tables: DataFrame, limit: int, keep: int) -> DataFrame:
    """Of a document with more than limit tables, the keep best by signal, then rows, then order."""
    w = Window.partitionBy("doc")
    ranked = tables.withColumns({"_n": F.count("*").over(w), "_rank": F.row_number().over(w.orderBy(F.desc("signal"), F.desc("n_rows"), "table_no"))})
    return ranked.where((F.col("_n") <= limit) | (F.col("_rank") <= keep)).drop("_n", "_rank")


def list_items(response: Column) -> Column:
    """The different items of a list response, fenced or not, trimmed, in their order."""
    body = F.regexp_extract(response, r"(?s)(\[.*\])", 1)
    return F.array_distinct(F.filter(F.transform(F.from_json(body, "array<string>"), lambda x: F.trim(x)), lambda x: x != ""))
