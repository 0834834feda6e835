"""MinHash near-dedup: universal hash minima, banding, signature verification, connected components.

1. A document's set is its different word shingles as 64-bit hashes; documents with equal sets (by a 128-bit digest) form
   a class, and only the class's smallest doc_id goes on, so copies never meet as pairs.
2. Each representative has ``bands * rows`` minima; documents that agree on a whole band share a bucket.
3. A bucket's pivot is its most central member: the one with the most neighbours over all its buckets. Every member is
   paired with the pivot only, which is linear in the bucket's size. Pairs pass a signature test, then the full sets decide.
4. Connected components by alternating large-star and small-star.
5. The exact way for what stars can't see: a pivot's members that have not joined the pivot's component are compared with
   all its other members, in blocks of bounded size: their signatures first, then the texts of those members only whose
   signatures allow a link. Only links that join two components leave a block.
6. Components again with these links.

So every two documents that share a bucket are either in one component or were compared on their full sets. At a
similarity of 0.8, 32 bands of 5 miss a pair with probability 3e-6; at 0.85, 25 bands of 5 with 4e-7.

Defined cases: null, empty or blank texts have no shingles and link with nothing; a text with fewer words than a shingle
is one shingle; rows with the same doc_id but other texts are linked through their id; a row with a null doc_id links
with nothing, has a null component and is kept; a very long text is read whole, and blocks are cut by the size of their
sets, so that long texts make smaller blocks; further columns, whatever their names, are not read, and ``keep_first``
keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import cut, fresh, pair_of_longs, raw, store


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80  # documents link if 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 5
    block: int = 512  # members of a block, at most on average
    block_shingles: int = 1 << 20  # shingles of a block, at most on average
    salts: int = 256  # places to which the rows of a large class are dealt
    seed: int = 20

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Multiply-shift hashing: odd multipliers and offsets."""
        rng = np.random.default_rng(self.seed)
        n = self.bands * self.rows
        return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)

    def least_matches(self) -> int:
        """Equal minima that a linked pair has but for a chance of about 1e-6."""
        n, p = self.bands * self.rows, self.percent / 100
        return int(n * p - 5 * (n * p * (1 - p)) ** 0.5)


# --- sets and signatures --------------------------------------------------------------------------------------------


class Shingler:
    """The set of a text as sorted 64-bit hashes. Hashes of words are remembered up to a bound."""

    ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

    def __init__(self, shingle: int, remember: int = 400_000):
        self.shingle, self.remember, self.known = shingle, remember, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # of bytes: A-Z, and the six ASCII blanks
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > self.remember:
            self.known.clear()
        known, hashed = self.known, []
        for w in words:
            if (h := known.get(w)) is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            hashed.append(h)
        h = np.array(hashed, np.uint64)
        k = min(self.shingle, len(h))
        x = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            x = (x ^ h[i : len(h) - k + 1 + i]) * self.ODD[0]
            x = (x ^ (x >> np.uint64(29))) * self.ODD[1]
        return np.unique(x ^ (x >> np.uint64(32)))


def minima(x: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = hashes[0][:, None], hashes[1][:, None]
    parts = [((a * x[None, i : i + 4096] + b) >> np.uint64(32)).min(axis=1) for i in range(0, len(x), 4096)]
    return np.minimum.reduce(parts).astype(np.uint32)


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (digest of the set), minima: a row for each row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, hashes = Shingler(s.shingle), s.hashes()
        for whole in batches:
            for batch in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                n, digest, mins = [], [], []
                for text in raw(batch.column(1)):
                    x = sets(text)
                    n.append(len(x))
                    digest.append(xxhash.xxh3_128_digest(x.tobytes()))
                    mins.append(minima(x, hashes).tobytes() if len(x) else None)
                d = pair_of_longs(digest)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(mins, pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "minima"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_shingles long, s1 long, s2 long, minima binary")


def banded(reps: DataFrame, s: Settings) -> DataFrame:
    """bucket, doc_id: a row for each band of a representative."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for m in batch.column(1).to_pylist():
                width = len(m) // s.bands
                keys.extend(xxhash.xxh64_intdigest(m[i * width : (i + 1) * width], seed=i) for i in range(s.bands))
            yield pa.record_batch([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), s.bands))], names=["bucket", "doc_id"])

    return reps.select("doc_id", "minima").mapInArrow(rows, "bucket long, doc_id long")


def pivots(bands: DataFrame) -> DataFrame:
    """a, b: each member b of a bucket with the bucket's pivot a; once, however many buckets they share."""
    size = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = store(bands.join(size, "bucket"), "buckets")  # few: most buckets have one member
    central = shared.groupBy("doc_id").agg(F.sum("size").alias("neighbours"))
    best = shared.join(central, "doc_id").groupBy("bucket").agg(F.min(F.struct(-F.col("neighbours"), "doc_id")).alias("best"))
    pairs = shared.join(best.select("bucket", F.col("best.doc_id").alias("a")), "bucket")
    return pairs.select("a", F.col("doc_id").alias("b")).where("a <> b").distinct()


# --- links ----------------------------------------------------------------------------------------------------------


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def likely(pairs: DataFrame, sigs: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""
    side = lambda c: sigs.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("minima").alias(f"m_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= s.least_matches()))

    return both.select("a", "b", "m_a", "m_b").mapInArrow(rows, "a long, b long")


def texts_in(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text: the documents that stand in a pair. The corpus's texts move here once, by the same plan at every size;
    all later joins read this smaller table."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return store(docs.hint("merge").join(ids.hint("merge"), "doc_id", "left_semi"), "texts")


def confirmed(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose full sets link."""
    text = lambda c: docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, last, of_a = Shingler(s.shingle), None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), raw(batch.column(2)), raw(batch.column(3)), strict=True):
                if a != last:
                    last, of_a = a, sets(ta)
                keep.append(linked(of_a, sets(tb), s.percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(rows, "a long, b long")


def rest(pairs: DataFrame, labels: DataFrame, sigs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Links between members of one pivot that are still in different components."""
    members = pairs.select("a", "b").union(pairs.select("a", F.col("a").alias("b")).distinct())
    of = labels.select(F.col("node").alias("b"), "component")
    members = members.join(of, "b", "left").withColumn("component", F.coalesce("component", "b"))
    own = members.where("a = b").select("a", F.col("component").alias("main"))
    members = store(members.join(own, "a"), "members")  # a, b, component, main
    # Only groups with a member outside go on (with two members, the pivot and the other are compared already).
    out = F.col("component") != F.col("main")
    groups = members.groupBy("a").agg(F.count_if(out).alias("n_out"), F.count("*").alias("n")).where("n_out > 0 AND n > 2").select("a")
    members = store(members.join(groups, "a").join(sigs.select(F.col("doc_id").alias("b"), "n_shingles", "minima"), "b"), "open")
    sizes = members.groupBy("a").agg(F.count_if(out).alias("n_out"), F.sum(F.when(out, F.col("n_shingles"))).alias("s_out"), F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    members = members.join(sizes, "a")
    # Outsiders are cut into blocks by a hash, and all members into other blocks; each pair of blocks is a group.
    count = lambda n, size: F.ceil(F.greatest(F.col(n) / s.block, F.col(size) / s.block_shingles)).cast("int")
    members = members.withColumns({"n_row": count("n_out", "s_out"), "n_col": count("n", "s")})
    block = lambda n, salt: F.pmod(F.xxhash64("b", F.lit(salt)), F.col(n)).cast("int")
    kept = ["a", "b", "component", "minima"]
    as_col = members.select(*kept, F.explode(F.sequence(F.lit(0), F.col("n_row") - 1)).alias("row"), block("n_col", 1).alias("col"), F.lit(False).alias("out"))
    as_row = members.where("component <> main").select(*kept, block("n_row", 2).alias("row"), F.explode(F.sequence(F.lit(0), F.col("n_col") - 1)).alias("col"), F.lit(True).alias("out"))

    def possible(table: pa.Table) -> pa.Table:
        """The members of a pair of blocks that have a partner of another component whose signature allows a link."""
        out, comps = table["out"].to_numpy(), table["component"].to_numpy()
        hit = np.zeros(table.num_rows, bool)
        if len(np.unique(comps)) > 1 and out.any() and not out.all():
            sig = np.frombuffer(b"".join(table["minima"].to_pylist()), np.uint32).reshape(table.num_rows, -1)
            cols = np.flatnonzero(~out)
            for i in np.flatnonzero(out):
                near = cols[((sig[cols] == sig[i]).sum(axis=1) >= s.least_matches()) & (comps[cols] != comps[i])]
                hit[near], hit[i] = True, hit[i] or len(near) > 0
        return table.select(["a", "row", "col", "b", "component", "minima", "out"]).filter(pa.array(hit))

    def compare(table: pa.Table) -> pa.Table:
        sets, found = Shingler(s.shingle), []
        out, ids, comps = table["out"].to_numpy(), table["b"].to_numpy(), table["component"].to_numpy()
        sig = np.frombuffer(b"".join(table["minima"].to_pylist()), np.uint32).reshape(table.num_rows, -1)
        own = [sets(t) for t in raw(table["text"].combine_chunks())]
        cols = np.flatnonzero(~out)
        parent: dict[int, int] = {}

        def top(c: int) -> int:
            while (p := parent.get(c, c)) != c:
                c = p
            return c

        for i in np.flatnonzero(out):
            matches = (sig[cols] == sig[i]).sum(axis=1)
            for j in cols[np.argsort(-matches, kind="stable")[: int((matches >= s.least_matches()).sum())]]:
                x, y = top(int(comps[i])), top(int(comps[j]))
                if x != y and linked(own[i], own[j], s.percent):
                    parent[max(x, y)] = min(x, y)
                    found.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    group = ["a", "row", "col"]
    near = as_row.unionByName(as_col).groupBy(*group).applyInArrow(possible, "a long, row int, col int, b long, component long, minima binary, out boolean")
    near = store(near, "near")
    return near.join(docs.select(F.col("doc_id").alias("b"), "text"), "b").groupBy(*group).applyInArrow(compare, "a long, b long")


# --- components -----------------------------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that each node of an edge reaches."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    print_ = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = print_(edges)
    for _ in range(most_rounds):
        # Large star: each node's larger neighbours move to its smallest one.
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(down.union(least.select("u", F.col("m").alias("v"))).distinct())
        if (now := print_(edges)) == before:
            leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept: a row for each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = store(signatures(docs, s), "signatures")
    # A class's rows are dealt to places by their doc_id; it is known at those places only where it has rows.
    salt = F.when(F.col("n_shingles") > 0, F.pmod(F.xxhash64("doc_id"), F.lit(s.salts)).cast("int"))
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = store(full.withColumn("salt", salt).groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.collect_set("salt").alias("at")), "classes")
    # A representative is one row; where a doc_id has several texts, each text has its own row.
    chosen = full.join(classes.select("s1", "s2", F.col("rep").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi").dropDuplicates(["s1", "s2"])
    reps = chosen.select("doc_id", "n_shingles", "minima")
    pairs = store(pivots(banded(reps, s)), "pairs")
    texts = texts_in(pairs, docs)
    first = cut(confirmed(likely(pairs, reps, s), texts, s))
    # Rows of one doc_id with several texts tie these texts' classes together.
    repeated = full.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y").select("doc_id")
    ties = full.join(repeated, "doc_id", "left_semi").select("doc_id", "s1", "s2").join(classes, ["s1", "s2"])
    first = first.union(ties.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    labels = components(first)
    more = cut(rest(pairs, labels, reps, texts, s))
    if not more.isEmpty():
        labels = components(labels.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"), F.explode("at").alias("salt"))
    member = sigs.select("doc_id", "n_shingles", "s1", "s2", salt.alias("salt")).join(named, ["s1", "s2", "salt"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = member.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents, one of each component: that with the smallest doc_id."""
    (own,) = fresh(docs.columns, "gone_id")
    gone = near_duplicates(docs, s).where("NOT kept").select(F.col("doc_id").alias(own))
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")
