"""Benchmark decontamination on a positional inverted index that is distributed by documents.

``build_index`` cuts the corpus into segments of bounded size and stores, for each, the terms with the positions of all
their occurrences. The benchmark's windows are a table of any size: each is keyed by its rarest term in the corpus, and
meets by a join only the segments that have this term. There a window's posting lists are shifted by their terms' offsets
and intersected from the rarest on, so most windows end after one look-up. What is left when all lists are through is
where the whole phrase stands: no further check is needed. Windows stream past their segment; neither they nor the
benchmark are gathered on the driver or in a task. ``slop`` asks for proximity matches too: all different words of a
phrase in any order within its length plus slop.

Defined cases: null or word-less documents have no words and no hits; a very long text is read whole (a
segment ends with a text, so the longest text bounds what a task holds); repeated rows are matched one by one; a
benchmark item without words has no windows; rows of the same item_id are one item; an item whose item_id is null marks
words but is not listed or counted; an empty benchmark hits nothing; further columns of either table, whatever their
names, are not read, and ``decontaminate`` keeps those of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import fresh, raw, store

#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; other ASCII parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENT = "segment string, doc_ids array<long>, starts array<long>, n_words array<long>, terms binary, ends array<int>, postings binary"
MATCH = "segment string, ord int, doc_id long, n_words long, spans array<struct<s:long,e:long>>, items array<string>, near array<string>"
WINDOWS = "item_id string, phrase string"
TERMS = "term string, segment string, n int"
GAP = 64  # unused positions between documents, so that no phrase and no match by proximity spans two


NONE = np.empty(0, np.int64)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


# --- the index ------------------------------------------------------------------------------------------------------


def build_index(docs: DataFrame, segment_words: int = 1 << 20) -> DataFrame:
    """A row for each segment. Positions run through the segment's documents; starts are the documents' first."""

    def segment(name: str, ids: list, texts: list[list[bytes]]) -> dict:
        number: dict[bytes, int] = {}
        codes = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int32)
        n = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(n + GAP)[:-1]]).astype(np.int64)
        at = np.arange(len(codes)) + np.repeat(starts - (np.cumsum(n) - n), n)
        order = np.argsort(codes, kind="stable")
        return {
            "segment": name, "doc_ids": ids, "starts": starts.tolist(), "n_words": n.tolist(), "terms": zstandard.compress(b"\n".join(number), 1),
            "ends": np.cumsum(np.bincount(codes, minlength=len(number))).tolist(), "postings": zstandard.compress(np.diff(at[order], prepend=0).astype(np.int32).tobytes(), 1),
        }

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                ids.append(doc_id)
                texts.append(words_of(text))
                size += len(texts[-1]) + GAP
                if size >= segment_words:
                    yield pa.RecordBatch.from_pylist([segment(f"{part}-{made}", ids, texts)], schema)
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield pa.RecordBatch.from_pylist([segment(f"{part}-{made}", ids, texts)], schema)

    schema = pa.schema({"segment": pa.string(), "doc_ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()), "n_words": pa.list_(pa.int64()), "terms": pa.binary(), "ends": pa.list_(pa.int32()), "postings": pa.binary()})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SEGMENT)


class Postings:
    """A segment's lists."""

    def __init__(self, terms: bytes, ends: np.ndarray, postings: bytes):
        names = zstandard.decompress(terms)
        self.number = {w: i for i, w in enumerate(names.split(b"\n"))} if names else {}
        self.ends = np.concatenate([[0], ends]).astype(np.int64)
        self.at = np.cumsum(np.frombuffer(zstandard.decompress(postings), np.int32).astype(np.int64))

    def positions(self, term: int) -> np.ndarray:
        return self.at[self.ends[term] : self.ends[term + 1]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the phrase starts."""
        rarest = np.argsort(self.ends[terms + 1] - self.ends[terms], kind="stable")
        start = self.positions(terms[rarest[0]]) - rarest[0]
        for k in rarest[1:]:
            if not len(start):
                break
            start = start[among(start + k, self.positions(terms[k]))]
        return start

    def near(self, terms: np.ndarray, width: int) -> np.ndarray:
        """Positions of the rarest word, of which all other different words lie together within width words."""
        terms = np.unique(terms)
        lists = sorted((self.positions(t) for t in terms), key=len)
        keep = np.zeros(len(lists[0]), bool)
        for shift in range(width):  # the window's first position is shift before the rarest word
            left, all_in = lists[0] - shift, np.ones(len(lists[0]), bool)
            for other in lists[1:]:
                k = np.searchsorted(other, left)
                all_in &= (k < len(other)) & (other[np.minimum(k, len(other) - 1)] < left + width)
                if not all_in.any():
                    break
            keep |= all_in
        return lists[0][keep]


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    k = np.searchsorted(ordered, values)
    return (k < len(ordered)) & (ordered[np.minimum(k, len(ordered) - 1)] == values)


# --- the benchmark --------------------------------------------------------------------------------------------------


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, phrase (the words, with blanks between): a row for each different window of an item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                w = words_of(text)
                found = {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else []
                yield pa.record_batch([pa.array([item_id] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string())], names=["item_id", "phrase"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(rows, WINDOWS).distinct()


def terms_of(index: DataFrame) -> DataFrame:
    """term, segment, n: how often a segment has a term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, terms, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                names = zstandard.decompress(terms)
                names = pa.array(names.split(b"\n") if names else [], pa.binary()).cast(pa.string())
                n = np.diff(ends.values.to_numpy(), prepend=0).astype(np.int32)
                yield pa.record_batch([names, pa.array([segment] * len(names), pa.string()), pa.array(n)], names=["term", "segment", "n"])

    return index.select("segment", "terms", "ends").mapInArrow(rows, TERMS)


def candidates(index: DataFrame, windows: DataFrame) -> DataFrame:
    """segment, item_id, phrase: the windows all of whose terms the corpus has, with the segments of their rarest term."""
    each = windows.select("item_id", "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("term"))
    wanted = store(each.select("term").distinct(), "wanted")
    terms = store(terms_of(index).join(wanted, "term", "left_semi"), "terms")
    total = terms.groupBy("term").agg(F.sum("n").alias("n"))
    rarest = each.join(total, "term").groupBy("item_id", "phrase").agg(F.min(F.struct("n", "term")).alias("rare"), F.count("*").alias("met"))
    rarest = rarest.where(F.col("met") == F.size(F.array_distinct(F.split("phrase", " ")))).select("item_id", "phrase", F.col("rare.term").alias("term"))
    return rarest.join(terms.select("term", "segment"), "term").select("segment", "item_id", "phrase")


class Segment:
    """A segment while windows pass by."""

    def __init__(self, row: dict, slop: int | None):
        self.row, self.slop, self.index, self.last = row, slop, None, None
        self.starts = row["starts"].values.to_numpy()
        self.spans: list[tuple[np.ndarray, int]] = []
        self.items: list[set] = [set() for _ in self.starts]
        self.near: list[set] = [set() for _ in self.starts]

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.unique(np.searchsorted(self.starts, at, "right") - 1)

    def look_up(self, phrase: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The documents that have the phrase, and those that have its words together."""
        if self.index is None:
            self.index = Postings(self.row["terms"].as_py(), self.row["ends"].values.to_numpy(), self.row["postings"].as_py())
        terms = np.array([self.index.number.get(w, -1) for w in phrase.split()], np.int64)
        if terms.min() < 0:
            return NONE, NONE
        at = self.index.phrase(terms)
        if len(at):
            self.spans.append((at, len(terms)))
        return self.documents(at), NONE if self.slop is None else self.documents(self.index.near(terms, len(terms) + self.slop))

    def pass_by(self, item_id: str | None, phrase: bytes) -> None:
        if self.last is None or self.last[0] != phrase:  # the same window of other items comes next to it
            self.last = (phrase, *self.look_up(phrase))
        for docs, found in ((self.last[1], self.items), (self.last[2], self.near)):
            for k in docs if item_id is not None else NONE:
                found[k].add(item_id)

    def result(self) -> pa.RecordBatch:
        merged: list[list] = [[] for _ in self.starts]
        for s, e in joined(self.spans):
            k = int(np.searchsorted(self.starts, s, "right") - 1)
            merged[k].append({"s": int(s - self.starts[k]), "e": int(e - self.starts[k])})
        n = len(self.starts)
        return pa.RecordBatch.from_arrays([
            pa.array([self.row["segment"].as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), self.row["doc_ids"].values, pa.array(self.row["n_words"].values),
            pa.array(merged, pa.list_(pa.struct({"s": pa.int64(), "e": pa.int64()}))), pa.array([sorted(x) for x in self.items], pa.list_(pa.string())), pa.array([sorted(x) for x in self.near], pa.list_(pa.string())),
        ], names=["segment", "ord", "doc_id", "n_words", "spans", "items", "near"])


def match(index: DataFrame, benchmark: DataFrame, width: int = 10, slop: int | None = None) -> DataFrame:
    """segment, ord, doc_id, n_words, spans of hit words (s to e, without e), items, near: a row for each document."""
    if width + (slop or 0) > GAP:
        raise ValueError(f"windows, with their slop, may have {GAP} words at most")
    met = candidates(index, store(windows(benchmark, width), "windows"))
    both = index.unionByName(met, allowMissingColumns=True).select(*index.columns, "item_id", "phrase")
    both = both.repartition("segment").sortWithinPartitions("segment", "phrase", "item_id")  # the segment itself first

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            names = batch.schema.names
            item_ids, phrases = batch.column(names.index("item_id")).to_pylist(), raw(batch.column(names.index("phrase")))
            for i, phrase in enumerate(phrases):
                if phrase is not None:
                    here.pass_by(item_ids[i], phrase)
                    continue
                if here is not None:
                    yield here.result()
                here = Segment({name: batch.column(k)[i] for k, name in enumerate(names)}, slop)
        if here is not None:
            yield here.result()

    return both.mapInArrow(rows, MATCH)


def joined(spans: list[tuple[np.ndarray, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    if not spans:
        return []
    s = np.concatenate([at for at, _ in spans])
    e = np.concatenate([at + n for at, n in spans])
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    first = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([first[1:], [True]])
    return list(zip(s[first].tolist(), e[last].tolist(), strict=True))


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int | None = None, segment_words: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, items, near, contaminated: a row for each document."""
    found = match(store(build_index(docs, segment_words), "postings"), benchmark, width, slop)
    hit = found.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, x) -> n + x.e - x.s)"))
    return hit.select("doc_id", "n_words", "n_hit", "items", "near", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without a benchmark window; rows with a null doc_id can't be named in the report and stay."""
    (own,) = fresh(docs.columns, "bad_id")
    bad = report(docs, benchmark, width).where("contaminated").select(F.col("doc_id").alias(own))
    return docs.join(bad, F.col("doc_id") == F.col(own), "left_anti")
