"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks of similar size. A document's signature is a Bloom filter of its terms; a term that
occurs tf times is put in at the levels 0, 1, ... up to log2(tf). A block stores the filters sliced: one bitmap of its
documents for each row of the filters, so that a term's documents are the AND of a few bitmaps. A filter never misses a
term, so presence and level are overestimates, and the sum of a query's weights times the greatest gain that each level
allows bounds every document's score from above.

A search runs in four steps over all blocks: the ten documents with the highest bounds are scored exactly, which gives
each query a score that its answers must reach; all documents whose bound reaches it are candidates; candidates are
scored exactly from their whole texts; the best of them are the answer. No document is left out unless its bound proves
that ten others are better.

Score: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its gain (10^9 tf) div (1000 tf + 8 m) with
m = 10 + (90 n N) div L. Equal scores rank by doc_id.

Queries are dealt with in packs of a bounded number of terms; a pack (terms and weights) is broadcast. Document counts of
terms are kept by 128-bit digests; scores compare the terms themselves.

Defined cases: a null or empty text, or one without terms, is no document (N does not count it); rows with one doc_id are
documents of their own, and a null doc_id ranks first among equal scores; a very long text is one signature of its
own size; queries with one item_id, or none, are answered each for itself; a query without terms, or of terms that no
document has, gets no rows; without documents or queries the result is empty; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from statloom.llm.common import raw, store

#: Every byte that belongs to no term becomes a space, A-Z becomes a-z.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F


@dataclass(frozen=True)
class Settings:
    hashes: int = 3  # rows for each term and level
    rows_a_key: int = 12  # rows of a block's filters, for each term and level of its largest document
    block_docs: int = 512
    block_bits: int = 1 << 24  # a block of large documents has fewer
    gather_docs: int = 4096  # documents that are sorted by size and cut into blocks at once
    gather_terms: int = 2_000_000
    pack_terms: int = 65_536  # of the queries that are answered together
    best: int = 10


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def digests(terms: list[bytes]) -> np.ndarray:
    """Rows of two unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms)), "<u8").reshape(-1, 2)


def filter_rows(keys: np.ndarray, level: int, rows: int, hashes: int) -> list[np.ndarray]:
    """The rows that a block's filters have for each term at a level."""
    base = (keys[:, 0] ^ np.uint64(level * STEP % 2**64)) * MIX
    step = keys[:, 1] | np.uint64(1)
    return [((base + np.uint64(i) * step) >> np.uint64(20)) % np.uint64(rows) for i in range(hashes)]


# Index ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """blocks: docs array<long>, lengths array<long>, n_rows, levels, bits; terms: lo, hi, df (to be summed)."""

    table: DataFrame
    settings: Settings

    @property
    def blocks(self) -> DataFrame:
        return self.table.where("df is null").select("docs", "lengths", "n_rows", "levels", "bits")

    @property
    def terms(self) -> DataFrame:
        return self.table.where("df is not null").select("lo", "hi", "df")


ROW = pa.schema([("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_rows", pa.int32()), ("levels", pa.int32()), ("bits", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("df", pa.int64())])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal digests added up."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def block_row(docs: list[tuple], s: Settings) -> tuple:
    """docs: doc_id, length, digests and levels (how many, for each digest) of each document."""
    n_rows = s.rows_a_key * max(int(d[3].sum()) for d in docs)
    width = -(-len(docs) // 8) * 8
    bits = np.zeros((n_rows, width), bool)
    for slot, (_, _, keys, levels) in enumerate(docs):
        for level in range(int(levels.max())):
            for r in filter_rows(keys[levels > level], level, n_rows, s.hashes):
                bits[r, slot] = True
    return [d[0] for d in docs], [d[1] for d in docs], n_rows, max(int(d[3].max()) for d in docs), np.packbits(bits, axis=1).tobytes()


def build(docs: DataFrame, settings: Settings = Settings()) -> Index:
    """The index of docs (doc_id, text), stored in the shared folder."""
    s = settings

    def cut(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda d: int(d[3].sum()))
        at = 0
        while at < len(held):
            end, most = at + 1, 0
            while end < len(held) and end - at < s.block_docs:
                most = s.rows_a_key * int(held[end][3].sum())
                if most * (end - at + 1) > s.block_bits:
                    break
                end += 1
            columns = zip(*[block_row(held[at:end], s)], strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, ROW, strict=False)), *(pa.nulls(1, pa.int64()) for _ in range(3))], schema=ROW)
            at = end

    def counted(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        signed = keys.view("<i8") if len(keys) else np.empty((0, 2), "<i8")
        for i in range(0, len(keys), 100_000):
            part = signed[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), f.type) for f in list(ROW)[:5]), pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy()), pa.array(n[i : i + 100_000])], schema=ROW)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_terms = [], 0
        df_keys, df = np.empty((0, 2), "<u8"), np.empty(0, np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), raw(batch.column(1))
            for doc_id, text in zip(ids, texts, strict=True):
                counts = Counter(terms_of(text)) if text else None
                if not counts:
                    continue
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                held.append((doc_id, int(tf.sum()), digests(list(counts)), np.frexp(tf)[1]))
                held_terms += len(tf)
                if len(held) >= s.gather_docs or held_terms >= s.gather_terms:
                    df_keys, df = summed(np.concatenate([df_keys, *(d[2] for d in held)]), np.concatenate([df, np.ones(held_terms, np.int64)]))
                    yield from cut(held)
                    held, held_terms = [], 0
                    if len(df) > 1_000_000:
                        yield from counted(df_keys, df)
                        df_keys, df = df_keys[:0], df[:0]
        if held:
            df_keys, df = summed(np.concatenate([df_keys, *(d[2] for d in held)]), np.concatenate([df, np.ones(held_terms, np.int64)]))
            yield from cut(held)
        yield from counted(df_keys, df)

    schema = "docs array<long>, lengths array<long>, n_rows int, levels int, bits binary, lo long, hi long, df long"
    return Index(store(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema), "signatures"), s)


# Queries -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pack:
    """Queries that are answered together: distinct terms, and each query's terms as a slice of places."""

    numbers: list[int]
    terms: list[bytes]
    keys: np.ndarray
    begins: np.ndarray
    places: np.ndarray
    weights: np.ndarray | None = None

    def weighted(self, df: dict[int, int], n_docs: int) -> Pack:
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64)
        return Pack(self.numbers, self.terms, self.keys, self.begins, self.places, weights)


def packed(items: list[tuple[int, list[bytes]]]) -> Pack:
    place: dict[bytes, int] = {}
    places = np.array([place.setdefault(t, len(place)) for _, terms in items for t in terms], np.int64)
    begins = np.cumsum([0, *(len(terms) for _, terms in items)])
    return Pack([n for n, _ in items], list(place), digests(list(place)), begins, places)


def packs(queries: DataFrame, most_terms: int) -> Iterator[Pack]:
    """The queries with terms, in packs; the driver holds one at a time."""
    held, n = [], 0
    for r in queries.select("number", "terms").toLocalIterator():
        terms = [bytes(t) for t in r.terms]
        if held and n + len(terms) > most_terms:
            yield packed(held)
            held, n = [], 0
        held.append((r.number, terms))
        n += len(terms)
    if held:
        yield packed(held)


def query_terms(queries: DataFrame, item: str, text: str) -> DataFrame:
    """item_id, number and the distinct terms of each query that has some."""
    rows = queries.select(F.col(item).alias("item_id"), F.col(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(dict.fromkeys(terms_of(t or b""))) for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    found = rows.mapInArrow(split, rows.select("item_id").schema.add("terms", ArrayType(BinaryType()))).where("size(terms) > 0")
    return store(found.withColumn("number", F.monotonically_increasing_id()), "queries")


# Search --------------------------------------------------------------------------------------------------------------


def bounds(block: dict, pack: Pack, n_docs: int, n_terms: int, hashes: int) -> np.ndarray:
    """For each query of the pack (rows) and document of the block (columns), a number that its score does not pass."""
    lengths = np.array(block["lengths"], np.int64)
    n_rows, n = block["n_rows"], len(lengths)
    bits = np.frombuffer(block["bits"], np.uint8).reshape(n_rows, -1)
    level = np.zeros((len(pack.keys), n), np.uint8)
    live, before = np.arange(len(pack.keys)), None
    for j in range(block["levels"]):
        at = filter_rows(pack.keys[live], j, n_rows, hashes)
        here = bits[at[0]]
        for r in at[1:]:
            here &= bits[r]
        if before is not None:
            here &= before
        some = here.any(1)
        live, before = live[some], here[some]
        if not len(live):
            break
        level[live] += np.unpackbits(before, axis=1, count=n)
    m = 10 + 90 * lengths * n_docs // n_terms
    most = np.minimum((1 << np.arange(block["levels"] + 1, dtype=np.int64))[:, None] - 1, lengths)  # of tf, by level
    gain = np.where(most > 0, 10**9 * most // np.maximum(1000 * most + 8 * m, 1), 0)
    there = np.flatnonzero(level.any(1))
    of = np.full(len(level), len(there), np.int64)
    of[there] = np.arange(len(there))
    worth = np.zeros((len(there) + 1, n), np.int64)
    worth[:-1] = gain[level[there], np.arange(n)] * pack.weights[there, None]
    out = np.zeros((len(pack.numbers), n), np.int64)
    for i, (a, b) in enumerate(zip(pack.begins[:-1], pack.begins[1:], strict=True)):
        rows = of[pack.places[a:b]]
        rows = rows[rows < len(there)]
        if len(rows):
            out[i] = worth[rows].sum(0)
    return out


def highest_bounds(index: Index, pack, stats: tuple[int, int]) -> DataFrame:
    """query, doc_id: the documents with the highest bounds of each query."""
    s = index.settings

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pack.value
        top: list[list[tuple[int, int | None]]] = [[] for _ in p.numbers]
        least = np.zeros(len(p.numbers), np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                found = bounds(block, p, *stats, s.hashes)
                for i in np.flatnonzero(found.max(1) > least).tolist():
                    at = np.argsort(-found[i], kind="stable")[: s.best]
                    at = at[found[i][at] > least[i]]
                    top[i] = heapq.nlargest(s.best, [*top[i], *((int(found[i][d]), block["docs"][d]) for d in at)], key=lambda x: x[0])
                    if len(top[i]) == s.best:
                        least[i] = top[i][-1][0]
        flat = [(i, b, d) for i, each in enumerate(top) for b, d in each]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64())], names=["query", "bound", "doc_id"])

    each = index.blocks.mapInArrow(rows, "query int, bound long, doc_id long")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "doc_id")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= s.best).select("query", "doc_id")


def candidates(index: Index, pack, stats: tuple[int, int], least: np.ndarray) -> DataFrame:
    """query, doc_id: all documents whose bound reaches the query's least score."""
    s = index.settings

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                query, doc = np.nonzero(bounds(block, pack.value, *stats, s.hashes) >= least[:, None])
                ids = pa.array(block["docs"], pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), ids], names=["query", "doc_id"])

    return index.blocks.mapInArrow(rows, "query int, doc_id long")


def scored(docs: DataFrame, found: DataFrame, pack, stats: tuple[int, int], least: np.ndarray, most: int, name: str) -> DataFrame:
    """query, doc_id, score: of the found pairs whose exact score (from the whole texts) reaches the query's least, the best
    that each task has; these hold the best of all."""
    n_docs, n_terms = stats
    null = lambda c: [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("key"), F.col(c).isNull().alias("none")]
    wanted = store(found.select(*null("doc_id"), "query").groupBy("key", "none").agg(F.collect_set("query").alias("queries")), name)
    texts = docs.select(*null("doc_id"), "text").where("text is not null")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pack.value
        known = {t: i for i, t in enumerate(p.terms)}
        top: dict[int, list[tuple[int, bool, int]]] = {}  # a task's best of each query, in the order of ranks
        for batch in batches:
            for key, none, queries, text in zip(*(batch.column(k).to_pylist() for k in range(3)), raw(batch.column(3)), strict=True):
                terms = terms_of(text)
                n = len(terms)
                if not n:
                    continue
                tf = np.zeros(len(p.terms), np.int64)
                for t, c in Counter(terms).items():
                    if (i := known.get(t)) is not None:
                        tf[i] = c
                m = 10 + 90 * n * n_docs // n_terms
                worth = p.weights * (10**9 * tf // (1000 * tf + 8 * m))
                for q in queries:
                    score = int(worth[p.places[p.begins[q] : p.begins[q + 1]]].sum())
                    if score >= least[q]:
                        each = top.setdefault(q, [])
                        each.append((-score, not none, key))
                        if len(each) >= 20 * most:
                            top[q] = heapq.nsmallest(most, each)
        out = [(q, d if there else None, -score) for q, each in top.items() for score, there, d in heapq.nsmallest(most, each)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["query", "doc_id", "score"])

    return wanted.join(texts, ["key", "none"]).select("key", "none", "queries", "text").mapInArrow(rows, "query int, doc_id long, score long")


def best(scores: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def search(index: Index, docs: DataFrame, queries: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each query. docs: those of the index."""
    spark, s = docs.sparkSession, index.settings
    asked = query_terms(queries, item, text)
    size = index.blocks.agg(F.sum(F.size("docs")).alias("n"), F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("l")).first()
    answers = spark.createDataFrame([], "number long, rank int, doc_id long, score long")
    if size.n:
        stats = (int(size.n), int(size.l))
        for pack in packs(asked, s.pack_terms):
            answers = answers.unionByName(answer(index, docs, spark, pack, stats))
    return asked.select("item_id", "number").join(answers, "number").select("item_id", "rank", "doc_id", "score")


def answer(index: Index, docs: DataFrame, spark: SparkSession, pack: Pack, stats: tuple[int, int]) -> DataFrame:
    """number, rank, doc_id, score for the queries of a pack."""
    s = index.settings
    shared = spark.sparkContext.broadcast(pack.weighted(document_counts(index, spark, pack), stats[0]))
    nothing = np.ones(len(pack.numbers), np.int64)
    first = scored(docs, highest_bounds(index, shared, stats), shared, stats, nothing, s.best, "first")
    tenth = best(first, s.best).where(F.col("rank") == s.best).select("query", "score").collect()  # a row for each query of the pack
    least = nothing.copy()
    for r in tenth:
        least[r.query] = r.score
    found = scored(docs, candidates(index, shared, stats, least), shared, stats, least, s.best, "candidates")
    numbers = spark.createDataFrame(list(enumerate(pack.numbers)), "query int, number long")
    return store(best(found, s.best).join(numbers, "query").select("number", "rank", "doc_id", "score"), "answers")


def document_counts(index: Index, spark: SparkSession, pack: Pack) -> dict[int, int]:
    """In how many documents each term of the pack occurs."""
    order = np.lexsort((pack.keys[:, 1], pack.keys[:, 0]))
    shared = spark.sparkContext.broadcast((pack.keys[order].copy(), order))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = shared.value
        for batch in batches:
            lo, hi = (batch.column(k).to_numpy().view("<u8") for k in (0, 1))
            i, end = np.searchsorted(keys[:, 0], lo), len(keys)
            at = np.full(len(lo), -1, np.int64)
            open_ = np.flatnonzero(i < end)
            while len(open_):
                open_ = open_[keys[i[open_], 0] == lo[open_]]
                hit = keys[i[open_], 1] == hi[open_]
                at[open_[hit]] = places[i[open_[hit]]]
                open_ = open_[~hit]
                i[open_] += 1
                open_ = open_[i[open_] < end]
            there = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[there].astype(np.int32)), batch.column(2).take(pa.array(there))], names=["term", "df"])

    counts = index.terms.mapInArrow(rows, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in counts.collect()}  # a row for each term of the pack
