"""Quality rules: what lines repeat across a host's documents, and what a text repeats within itself.

A line is normalised (white space to single blanks, ends stripped, lower case, runs of digits to 0) and hashed, once for
each text; what is left to do reads the stored hashes. For each host and line the different documents (doc_id) are
counted. A line is above the limit and removed if more than ``max_docs`` documents of the host have it, or if at least
``min_docs`` and more than ``max_share`` of the host's documents do. A document is depleted, and rejected, if removal
leaves less than ``min_left`` of its words. Documents count as they come, copies too; to count copies once, run near-dedup
first. ``clean`` gives the texts without the removed lines. All of it is SQL: no code outside Spark's own functions.

A line's rows meet in one key only as counts that are summed before the shuffle; shares are taken for hosts of at most
``max_docs / max_share`` documents (for larger ones the first limit is the stricter), and their lines are salted; the way
back to the documents is a join, whose large keys Spark splits.

Defined cases: a null text has no words and fails the base rules; blank lines are no lines; a null host is a host of its
own; rows with the same doc_id are one document in counts, and each row gets a result of its own; rows with a null doc_id
count as one document; a very long text is one row's work in its task, and only hashes of its lines leave it; an empty
table gives none; columns of any name stay in ``base`` and ``clean`` and are not read by ``judged``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import fresh, store

BLANKS = r"[\\x20\\x09-\\x0D]+"
WORD = r"[^\\x20\\x09-\\x0D]+"
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SALTS = 32


@dataclass(frozen=True)
class Limits:
    max_docs: int = 100
    min_docs: int = 10
    max_share: float = 0.01
    min_left: float = 0.5
    min_words: int = 10
    max_repeat_percent: int = 20


def words(text: str) -> Column:
    return F.expr(f"filter(split(coalesce({text}, ''), '{BLANKS}', -1), w -> w <> '')")


def n_repeat_words(words: str, window: int = 5) -> Column:
    """Words inside windows that occur twice or more, from the windows' sorted hashes."""
    of = ", ".join(f"{words}[i + {k}]" for k in range(window))
    hashes = f"transform(sequence(0, size({words}) - {window}), i -> named_struct('h', xxhash64({of}), 'i', i))"
    # After sorting, a window is repeated if a neighbour has its hash.
    marked = "transform(s, (x, k) -> CASE WHEN (k > 0 AND s[k - 1].h = x.h) OR (k + 1 < size(s) AND s[k + 1].h = x.h) THEN x.i ELSE -1 END)"
    starts = f"transform(array(array_sort({hashes})), s -> array_sort(filter({marked}, i -> i >= 0)))[0]"
    covered = f"transform(array({starts}), p -> aggregate(transform(p, (i, k) -> CASE WHEN k + 1 < size(p) THEN least({window}, p[k + 1] - i) ELSE {window} END), 0L, (a, x) -> a + x))[0]"
    return F.expr(f"CASE WHEN size({words}) >= {window} THEN {covered} ELSE 0L END")


def base(docs: DataFrame) -> DataFrame:
    """The frame with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, l = fresh([*docs.columns, *FIGURES], "words_", "lines_")
    lines = F.expr("filter(split(coalesce(text, ''), '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')")
    out = docs.withColumns({w: words("text"), l: lines})
    return out.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        n_repeat_words(w).alias("n_repeat_words"),
    ).drop(w, l)


def normalised(line: str) -> str:
    return f"regexp_replace(trim(regexp_replace(lower({line}), '{BLANKS}', ' ')), '[0-9]+', '0')"


def line_hash(line: str) -> str:
    """128 bits of the normalised line."""
    return f"transform(array({normalised(line)}), z -> named_struct('a', xxhash64(z), 'b', xxhash64(1, z)))[0]"


def described(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """row, doc_id, host, lines (line's hash, n words) of docs (doc_id, text, host), with further columns of docs."""
    hashed = f"filter(transform(split(text, '\\n', -1), l -> named_struct('line', {line_hash('l')}, 'n', regexp_count(l, '{WORD}'))), x -> x.n > 0)"
    host = F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", host.alias("host"), F.expr(hashed).alias("lines"), *extra)


def above(described: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """host, line: the lines above the limit."""
    each = described.select("host", "doc_id", F.explode("lines.line").alias("line")).distinct()
    count = each.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min(limits.min_docs, limits.max_docs + 1))
    count = count.withColumn("salt", F.pmod("line.a", F.lit(SALTS)))
    hosts = described.where("lines IS NOT NULL").select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    small = hosts.where(F.col("n_host") < limits.max_docs / limits.max_share).select("host", "n_host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    often = count.where(F.col("n_docs") > limits.max_docs).select("host", "line")
    shared = count.where(F.col("n_docs").between(limits.min_docs, limits.max_docs)).join(small, ["host", "salt"]).where(F.col("n_docs") > limits.max_share * F.col("n_host"))
    return often.unionByName(shared.select("host", "line"))


def judged(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the base figures, n_removed (words on lines above the limit), base_failed, kept: a row for each document
    (doc_id, text, host)."""
    plain = docs.select("doc_id", "text", "host")
    kept = store(described(base(plain), FIGURES), "described")
    lost = kept.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.n")
    lost = lost.join(above(kept, limits), ["host", "line"]).groupBy("row").agg(F.sum("n").alias("n_removed"))
    out = kept.drop("lines", "host").join(lost, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    left = (F.col("n_words") - F.col("n_removed")) >= limits.min_left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & left).drop("row")


def clean(docs: DataFrame, limits: Limits = Limits(), host: str = "host") -> DataFrame:
    """docs, each text without its lines above the limit. Only documents that lose lines have them looked up again."""
    key, own, lost, at = fresh(docs.columns, "key", "own_host", "lost", "at_host")
    kept = store(described(docs.select("doc_id", "text", F.col(host).alias("host"))), "described")
    each = kept.select("doc_id", "host", F.explode("lines.line").alias("line")).distinct()
    gone = each.join(above(kept, limits), ["host", "line"]).groupBy("doc_id", "host").agg(F.collect_set("line").alias(lost))
    gone = gone.select(F.col("doc_id").alias(key), F.col("host").alias(at), lost)
    rows = docs.withColumn(own, F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(at)), "left")
    left = f"array_join(filter(split(text, '\\n', -1), l -> NOT array_contains({lost}, {line_hash('l')})), '\\n')"
    return rows.withColumn("text", F.expr(f"CASE WHEN {lost} IS NULL THEN text ELSE {left} END")).select(docs.columns)
