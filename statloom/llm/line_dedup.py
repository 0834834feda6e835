"""Line dedup: exact reference counts by line, and sharded cuckoo filters of the lines that occur too often.

A line's key is the line without white space at its ends, A-Z lower-cased. ``counts`` holds each key's exact number of
documents. ``filters`` holds, by shard of the key's hash, a cuckoo filter of the keys at or above ``min_docs``; it takes
insertions and deletions, so ``insert`` and ``delete`` of documents leave the index as if built anew from the rest: a
shard that outgrows its table is made anew from the exact table, and all are when the number of shards no longer fits.
``dedup`` sends the keys of all lines to their shard's filter, confirms the few hits in the exact table and drops the
lines. A shard's keys are dealt to as many places as its lines' occurrences need, each with the filter, and stream past
it; so no line, however common, makes a task large, and the plan is the same at every size.

Defined cases: a null text is one empty line; rows with the same doc_id are one document; a row with a null doc_id is
neither counted nor changed; a very long text or line is read whole, and only hashes of its lines leave its task; an empty
table gives an empty result; columns other than doc_id and text are never read unless ``keep_columns`` asks to carry them,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import in_parts, pair_of_longs, raw, store

WHITE = b" \t\n\x0b\x0c\r"
SLOTS = 4
KEY = ["k1", "k2"]


@dataclass(frozen=True)
class LineIndex:
    counts: DataFrame  # k1, k2, n_docs
    filters: DataFrame  # shard, n_buckets, slots, n_places
    n_shards: int
    min_docs: int
    min_chars: int
    keys_per_shard: int
    often: DataFrame  # k1, k2, n_docs of the lines at or above min_docs, stored apart


# --- keys -----------------------------------------------------------------------------------------------------------


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()  # of bytes, lower() changes A-Z only


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def keys_of(text: bytes, min_chars: int) -> set[bytes]:
    keys = {line_key(x) for x in text.split(b"\n")}
    return {xxhash.xxh3_128_digest(k) for k in keys if long_enough(k, min_chars)}


def line_keys(docs: DataFrame, min_chars: int, places: Places | None = None) -> DataFrame:
    """A row for each document and different long line: k1, k2, doc_id; with places, also the place of its filter, and
    only those whose shard has one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 1):
            digests, owner = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                if text:
                    found = keys_of(text, min_chars)
                    digests.extend(found)
                    owner.extend([doc_id] * len(found))
            k, owner = pair_of_longs(digests), np.array(owner, np.int64)
            if places is None:
                yield pa.record_batch([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(owner)], names=[*KEY, "doc_id"])
                continue
            at = places.of(k, owner)
            k, owner, at = k[at >= 0], owner[at >= 0], at[at >= 0]
            yield pa.record_batch([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(owner), pa.array(at)], names=[*KEY, "doc_id", "place"])

    schema = "k1 long, k2 long, doc_id long" + (", place long" if places else "")
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(rows, schema)


# --- cuckoo filters -------------------------------------------------------------------------------------------------


def prints(k: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and fingerprint (never 0) of each key."""
    return (k[:, 0].view(np.uint64) & np.uint64(n_buckets - 1)).astype(np.int64), ((k[:, 1].view(np.uint64) >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)


def other_bucket(bucket: np.ndarray, fp: np.ndarray, n_buckets: int) -> np.ndarray:
    spread = (fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return bucket ^ (spread & np.uint64(n_buckets - 1)).astype(np.int64)


def buckets_for(n_keys: int) -> int:
    return 1 << max(4, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.8)))))


def cuckoo_insert(table: np.ndarray, k: np.ndarray, rounds: int = 400) -> bool:
    """Puts all keys into the table [bucket, slot], many at a time; False if some found no place."""
    n = len(table)
    at, fp = prints(k, n)
    moved = np.zeros(len(at), bool)
    rng = np.random.default_rng(len(k))
    for _ in range(rounds):
        if not len(at):
            return True
        _, turn = np.unique(at, return_index=True)  # one key a bucket in each round
        free = table[at[turn]] == 0
        fits = free.any(axis=1)
        put, full = turn[fits], turn[~fits]
        table[at[put], free[fits].argmax(axis=1)] = fp[put]
        kick = full[moved[full]]
        if len(kick):  # both buckets are full: take the place of another, which moves on
            slot = rng.integers(0, SLOTS, len(kick))
            out = table[at[kick], slot].copy()
            table[at[kick], slot] = fp[kick]
            fp[kick] = out
        at[full] = other_bucket(at[full], fp[full], n)
        moved[full] = True
        left = np.ones(len(at), bool)
        left[put] = False
        at, fp, moved = at[left], fp[left], moved[left]
    return not len(at)


def cuckoo_delete(tables: list[np.ndarray], k: np.ndarray) -> None:
    """Takes one fingerprint of each key out of the tables, many at a time."""
    n = len(tables[0])
    at, fp = prints(k, n)
    left = np.arange(len(at))
    for table in tables:
        for bucket in (at, other_bucket(at, fp, n)):
            tries, gone = left, np.zeros(len(at), bool)
            while len(tries):
                _, first = np.unique(bucket[tries], return_index=True)  # one key a bucket in each round
                turn = tries[first]
                same = table[bucket[turn]] == fp[turn, None]
                found = same.any(axis=1)
                table[bucket[turn[found]], same[found].argmax(axis=1)] = 0
                gone[turn[found]] = True
                tries = np.delete(tries, first)
            left = left[~gone[left]]


def cuckoo_grow(tables: list[np.ndarray], k: np.ndarray, n_buckets: int) -> list[np.ndarray]:
    """Inserts keys; a shard that fills up gets further tables of the same shape, so that all have the same buckets."""
    tables = list(tables) or [np.zeros((n_buckets, SLOTS), np.uint16)]
    room = max(1, n_buckets * SLOTS // 2)
    for i in range(0, len(k), room):
        part, last = k[i : i + room], tables[-1].copy()
        if cuckoo_insert(last, part):
            tables[-1] = last
        else:
            tables.append(np.zeros((n_buckets, SLOTS), np.uint16))
            if not cuckoo_insert(tables[-1], part):
                raise RuntimeError("a half-empty cuckoo table took no more keys")
    return tables


def shard_of(n_shards: int):
    return F.pmod(F.shiftrightunsigned("k1", 32), F.lit(n_shards)).cast("int").alias("shard")


def pack(tables: list[np.ndarray]) -> bytes:
    return np.concatenate(tables).tobytes()


def unpack(slots: bytes, n_buckets: int) -> list[np.ndarray]:
    return list(np.frombuffer(slots, np.uint16).reshape(-1, n_buckets, SLOTS).copy())


def may_hold(k: np.ndarray, n_buckets: int, slots: bytes) -> np.ndarray:
    hit = np.zeros(len(k), bool)
    b, f = prints(k, n_buckets)
    c = other_bucket(b, f, n_buckets)
    for t in np.frombuffer(slots, np.uint16).reshape(-1, n_buckets, SLOTS):
        hit |= (t[b] == f[:, None]).any(axis=1) | (t[c] == f[:, None]).any(axis=1)
    return hit


@dataclass(frozen=True)
class Places:
    """Where the keys of a shard meet its filter: n places from first on, dealt by document; two numbers for each shard."""

    first: np.ndarray
    n: np.ndarray

    def of(self, k: np.ndarray, owner: np.ndarray) -> np.ndarray:
        shard = ((k[:, 0].view(np.uint64) >> np.uint64(32)) % np.uint64(len(self.n))).astype(np.int64)
        deal = ((owner.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        return np.where(self.n[shard] > 0, self.first[shard] + deal % np.maximum(self.n[shard], 1), -1)


FILTER = "shard int, n_buckets int, slots binary"


def build_filters(keys: DataFrame, n_shards: int) -> DataFrame:
    """A filter for each shard; a shard's keys are a bounded group, as n_shards follows their number."""

    def build(table: pa.Table) -> pa.Table:
        k = np.column_stack([table["k1"].to_numpy(), table["k2"].to_numpy()])
        n = buckets_for(len(k))
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "n_buckets": pa.array([n], pa.int32()), "slots": [pack(cuckoo_grow([], k, n))]})

    return keys.select(shard_of(n_shards), *KEY).groupBy("shard").applyInArrow(build, FILTER)


# --- the index ------------------------------------------------------------------------------------------------------


def count_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    return line_keys(docs, min_chars).groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"))


def with_places(filters: DataFrame, counts: DataFrame, n_shards: int, keys_per_place: int = 1 << 16) -> DataFrame:
    """filters with n_places: one for so many occurrences of the shard's lines."""
    n = counts.groupBy(shard_of(n_shards)).agg(F.sum("n_docs").alias("n"))
    return filters.join(n, "shard", "left").select("shard", "n_buckets", "slots", F.ceil(F.coalesce("n", F.lit(1)) / keys_per_place).cast("int").alias("n_places"))


def shards_for(often: DataFrame, keys_per_shard: int) -> int:
    return max(1, -(-often.count() // keys_per_shard))


def build(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, keys_per_shard: int = 1 << 16) -> LineIndex:
    counts = store(count_lines(docs, min_chars), "line-counts")
    often = store(counts.where(F.col("n_docs") >= min_docs), "line-often")
    n_shards = shards_for(often, keys_per_shard)
    filters = store(with_places(build_filters(often, n_shards), counts, n_shards), "line-filters")
    return LineIndex(counts, filters, n_shards, min_docs, min_chars, keys_per_shard, often)


def change(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    delta = count_lines(docs, index.min_chars).select(*KEY, (F.col("n_docs") * sign).alias("delta"))
    both = index.counts.select(*KEY, "n_docs", F.lit(0).cast("long").alias("delta")).unionByName(delta.withColumn("n_docs", F.lit(0).cast("long")))
    both = store(both.groupBy(*KEY).agg(F.sum("n_docs").alias("was"), F.sum("delta").alias("delta")), "line-changes")
    now = F.col("was") + F.col("delta")
    counts = both.select(*KEY, now.alias("n_docs")).where("n_docs > 0")
    often = store(counts.where(F.col("n_docs") >= index.min_docs), "line-often")
    needed = shards_for(often, index.keys_per_shard)
    if needed > 2 * index.n_shards:  # split all shards
        filters, n_shards = build_filters(often, needed), needed
    else:
        filters, n_shards = updated(index, both.where((F.col("was") >= index.min_docs) != (now >= index.min_docs)).select(*KEY, (now >= index.min_docs).alias("up")), often), index.n_shards
    return replace(index, counts=counts, often=often, n_shards=n_shards, filters=store(with_places(filters, counts, n_shards), "line-filters"))


def updated(index: LineIndex, crossing: DataFrame, often: DataFrame) -> DataFrame:
    """The filters after keys have crossed the limit; a shard whose table is too small for its keys is made anew."""
    shard = shard_of(index.n_shards)
    filters = index.filters.select("shard", "n_buckets", "slots")
    size = often.groupBy(shard).agg(F.count("*").alias("n"))
    anew = size.join(filters.select("shard", "n_buckets"), "shard", "left").where(F.col("n_buckets").isNull() | (F.col("n") > F.col("n_buckets") * (SLOTS * 0.8))).select("shard")
    anew = store(anew, "line-outgrown")

    def update(old: pa.Table, new: pa.Table) -> pa.Table:
        if not new.num_rows or not old.num_rows:
            return old
        n, tables = old["n_buckets"][0].as_py(), unpack(old["slots"][0].as_py(), old["n_buckets"][0].as_py())
        k, up = np.column_stack([new["k1"].to_numpy(), new["k2"].to_numpy()]), new["up"].to_numpy()
        cuckoo_delete(tables, k[~up])
        tables = cuckoo_grow(tables, k[up], n) if up.any() else tables
        return pa.table({"shard": old["shard"], "n_buckets": old["n_buckets"], "slots": [pack(tables)]})

    kept = filters.join(anew, "shard", "left_anti").groupBy("shard").cogroup(crossing.select(shard, *KEY, "up").groupBy("shard")).applyInArrow(update, FILTER)
    return kept.unionByName(build_filters(often.join(anew, shard == anew["shard"], "left_semi"), index.n_shards))


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with further documents, none of which it holds yet."""
    return change(index, docs, 1)


def delete(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index without these documents, all of which it holds."""
    return change(index, docs, -1)


# --- dropping lines -------------------------------------------------------------------------------------------------


def hits(docs: DataFrame, index: LineIndex) -> DataFrame:
    """k1, k2, doc_id of the lines that their shard's filter may hold. At each place the filter comes first, then the keys
    that are dealt to it."""
    n = np.zeros(index.n_shards, np.int64)
    for r in index.filters.select("shard", "n_places").collect():  # a number for each shard
        n[r.shard] = r.n_places
    places = Places(np.cumsum(n) - n, n)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n_buckets, slots in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for place in range(places.first[shard], places.first[shard] + places.n[shard]):
                    yield pa.record_batch([pa.array([place], pa.int64()), pa.array([n_buckets], pa.int32()), pa.array([slots], pa.binary())], names=["place", "n_buckets", "slots"])

    own = index.filters.select("shard", "n_buckets", "slots").mapInArrow(dealt, "place long, n_buckets int, slots binary")
    keys = line_keys(docs, index.min_chars, places)
    met = own.unionByName(keys, allowMissingColumns=True).select("place", *KEY, "doc_id", "n_buckets", "slots")
    met = met.repartition("place").sortWithinPartitions("place", F.col("slots").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            k = np.column_stack([batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (1, 2)])
            filters = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, bool)
            bounds = np.unique([0, *np.flatnonzero(filters), batch.num_rows])
            for lo, hi in zip(bounds, bounds[1:]):
                if filters[lo]:
                    table = (batch.column(4)[int(lo)].as_py(), batch.column(5)[int(lo)].as_py())
                    lo += 1
                if hi > lo:
                    keep[lo:hi] = may_hold(k[lo:hi], *table)
            yield batch.select([1, 2, 3]).filter(pa.array(keep))

    return met.mapInArrow(probe, "k1 long, k2 long, doc_id long")


def drop_list(docs: DataFrame, index: LineIndex) -> DataFrame:
    """doc_id, gone: the keys whose lines the document loses."""
    found = hits(docs, index).join(index.often.select(*KEY), KEY)
    keeper = found.groupBy(*KEY).agg(F.max("doc_id").alias("keeper"))
    gone = found.join(keeper, KEY).where("doc_id < keeper")
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("gone"))


def dedup(docs: DataFrame, index: LineIndex, keep_columns: bool = False) -> DataFrame:
    """A row for each document. keep_columns: the columns of docs with the new text (and n_chars after it, if there);
    otherwise doc_id, n_lines, n_dropped, kept_text."""
    # The drop list is proportional to the frequent lines only; texts move once, to meet it.
    columns = docs.columns if keep_columns else ["doc_id", "text"]
    lost, lost_id = (max(columns, key=len) + end for end in ("_lost", "_id"))  # names that no column of docs has
    gone = drop_list(docs, index).select(F.col("doc_id").alias(lost_id), F.col("gone").alias(lost))
    joined = docs.select(*columns).join(gone, F.col("doc_id") == F.col(lost_id), "left").select(*columns, lost)
    min_chars = index.min_chars

    def cut(text: bytes, gone: list[dict]) -> tuple[bytes, int, int]:
        lines = text.split(b"\n")
        if not gone:
            return text, len(lines), 0
        lost = {(g["k1"], g["k2"]) for g in gone}

        def stays(line: bytes) -> bool:
            key = line_key(line)
            return not long_enough(key, min_chars) or tuple(pair_of_longs([xxhash.xxh3_128_digest(key)])[0].tolist()) not in lost

        kept = [x for x in lines if stays(x)]
        return b"\n".join(kept), len(lines), len(lines) - len(kept)

    where = columns.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, where):
            out = [cut(t or b"", g) for t, g in zip(raw(batch.column(where)), batch.column(len(columns)).to_pylist(), strict=True)]
            text = pa.array([x[0] for x in out], pa.binary()).cast(pa.string())
            if keep_columns:
                arrays = [text if i == where else batch.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)
            else:
                yield pa.record_batch([batch.column(0), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), text], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    if not keep_columns:
        return joined.mapInArrow(rewrite, "doc_id long, n_lines long, n_dropped long, kept_text string")
    out = joined.mapInArrow(rewrite, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
