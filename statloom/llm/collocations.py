"""Phrase collocations from a weighted de Bruijn graph of words, for each language.

Nodes are sequences of max_words - 1 words, edges join nodes that overlap in all but one word: an edge is a sequence of
max_words words and weighs how often it occurs. Only edges are counted over the corpus. A place where a piece ends, or
where a word follows that is too rare to be in any candidate, is an edge that ends there (its further words are 0). So
the flow out of a node, piece ends included, is the node's own count, and the counts of all shorter phrases follow from
the edges by adding up, level by level.

A node through which all flow goes from one edge into one edge is inside a unary path; such paths are compacted, by
doubling of pointers, and their inner nodes are absorbed. Other phrases are dropped where a longer candidate around them
has the given share of their occurrences. The rest is ranked: a phrase is worth the lowest score of its cuts in two,
floor(10^6 a a / (l r)) in exact decimals.

Words are 64-bit digests of language and word while they are counted; two frequent words of a language with one digest
raise. Which words are frequent is known to the tasks by a Bloom filter of fixed size: a rare word that passes it is
counted for nothing, no count depends on it. Tasks add up what they hold before it is shuffled, Spark again before and
after, so a frequent word or phrase is one row a task.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows count each; very long texts and
words are counted whole; phrases with equal score and count rank by their UTF-8 bytes; an empty table, or one without
candidates, gives no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.bpe import by_size
from statloom.llm.common import raw, store

#: A-Z become a-z, ends of pieces a new line, tabs a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
RARE, END, BLANK = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    max_words: int = 3
    least: int = 10  # occurrences of a candidate
    contained: int = 50  # per cent of a phrase's occurrences inside a longer candidate, from which it is dropped
    top: int = 2000  # phrases of a language in the report
    shares: int = 64  # of a language's candidates, each ranked by itself before the best are
    filter_bits: int = 26  # the filter of frequent words has 2 to this many bits
    hold: int = 1_500_000  # different edges that a task adds up before it passes them on


def tokens(texts: list[bytes | None]) -> list[bytes]:
    """The words of all texts, a new line at each piece's end, and empty ones between neighbouring blanks."""
    return b"\n".join(t for t in texts if t).translate(LETTERS).replace(b"\n", b" \n ").split(b" ")


def codes(lang: str, words: list[bytes]) -> np.ndarray:
    head = lang.encode()
    head = b"%d:%s" % (len(head), head)
    out = np.fromiter((xxhash.xxh3_64_intdigest(head + w) for w in words), np.uint64, len(words)).view(np.int64)
    return np.where((out >= RARE) & (out <= BLANK), out + 3, out)


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes | None]]]:
    """Language and texts, in portions of bounded size (a longer text stands alone)."""
    for batch in batches:
        for i, j in by_size(batch.column(1), 4 << 20, 20_000):
            langs, texts = batch.column(0).slice(i, j - i).to_pylist(), raw(batch.column(1).slice(i, j - i))
            each: dict[str, list] = {}
            for lang, text in zip(langs, texts, strict=True):
                each.setdefault(lang, []).append(text)
            yield from each.items()


# Words ---------------------------------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame, s: Settings) -> DataFrame:
    """lang, code, word, n of the frequent words; for each language a row with a null code and the number of all words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                for blank in (b"", b"\n"):
                    counts.pop(blank, None)
                words = list(counts)
                for i in range(0, len(words), 50_000):
                    part = words[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array(codes(lang, part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in part], pa.int64())],
                        names=["lang", "code", "word", "n"],
                    )

        held: dict[str, Counter] = {}
        for lang, texts in by_language(batches):
            held.setdefault(lang, Counter()).update(tokens(texts))
            if sum(map(len, held.values())) > 500_000:
                yield from flushed()
                held = {}
        yield from flushed()

    each = docs.mapInArrow(rows, "lang string, code long, word string, n long")
    words = each.groupBy("lang", "code").agg(F.min("word").alias("word"), F.max("word").alias("last"), F.sum("n").alias("n"))
    clash = F.raise_error(F.concat(F.lit("two words with one digest: "), "word", F.lit(" "), "last")).cast("string")
    own = F.when(F.col("n") >= s.least, F.struct("code", F.when(F.col("word") == F.col("last"), F.col("word")).otherwise(clash).alias("word"), "n"))
    whole = F.struct(F.lit(None).cast("long").alias("code"), F.lit(None).cast("string").alias("word"), "n")
    # In one pass: the frequent words as they are, and a row for all words of the language, added up again.
    both = words.select("lang", F.explode(F.array_compact(F.array(own, whole))).alias("x")).select("lang", "x.code", "x.word", "x.n")
    return store(both.groupBy("lang", "code", "word").agg(F.sum("n").alias("n")), "words")


def filter_of(words: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the frequent words' codes as 64-bit numbers: of one size, whatever the vocabulary."""
    mask = (1 << bits) - 1
    place = F.explode(F.array(F.shiftrightunsigned("code", 64 - bits), F.col("code").bitwiseAND(F.lit(mask))))
    found = words.where("code is not null").select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def passes(code: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    u = code.view(np.uint64)
    hit = np.ones(len(u), bool)
    for p in (u >> np.uint64(64 - bits), u & np.uint64((1 << bits) - 1)):
        hit &= (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return hit


# Graph ---------------------------------------------------------------------------------------------------------------


def names(k: int, first: int = 1) -> list[str]:
    return [f"w{i}" for i in range(first, first + k)]


def added(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Equal edges put together: words, and counts as the last column. Digests order the edges; those that share one are
    told apart by their words (an edge may then have two rows, which are added later)."""
    mix = functools.reduce(lambda h, c: (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), columns[:-1], np.zeros(len(columns[0]), np.uint64))
    order = np.argsort(mix)
    sorted_ = [c[order] for c in columns]
    new = functools.reduce(operator.or_, (c[1:] != c[:-1] for c in sorted_[:-1]))
    first = np.flatnonzero(np.append(True, new)) if len(mix) else np.empty(0, np.int64)
    return [*(c[first] for c in sorted_[:-1]), np.add.reduceat(sorted_[-1], first) if len(first) else sorted_[-1]]


def edges_of(code: np.ndarray, k: int) -> list[np.ndarray]:
    """The edge that begins at each frequent word: its words up to the piece's end or a rare word, then zeros."""
    columns = [np.where(code == END, RARE, code)]
    for i in range(1, k):
        follows = np.append(code[i:], np.full(min(i, len(code)), END, np.int64))
        columns.append(np.where((columns[-1] != RARE) & (follows != END), follows, RARE))
    there = columns[0] != RARE
    return [c[there] for c in columns]


def edges(docs: DataFrame, words: DataFrame, s: Settings) -> DataFrame:
    """w1, w2, ..., n: the edges of the graph, those that end early included."""
    table = docs.sparkSession.sparkContext.broadcast(filter_of(words, s.filter_bits))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = table.value
        known: dict[str, dict[bytes, int]] = {}
        held: list[list[np.ndarray]] = []
        size = 0

        def emitted(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 200_000]) for c in columns], names=[*names(s.max_words), "n"])

        for lang, texts in by_language(batches):
            code = known.setdefault(lang, {b"": BLANK, b"\n": END})
            if sum(map(len, known.values())) > 400_000:
                known = {}
                code = known.setdefault(lang, {b"": BLANK, b"\n": END})
            found = tokens(texts)
            new = [w for w in set(found) if w not in code]
            if new:
                c = codes(lang, new)
                code.update(zip(new, np.where(passes(c, frequent, s.filter_bits), c, RARE).tolist(), strict=True))
            line = np.fromiter(map(code.__getitem__, found), np.int64, len(found))
            columns = edges_of(line[line != BLANK], s.max_words)
            held.append(added([*columns, np.ones(len(columns[0]), np.int64)]))
            size += len(held[-1][0])
            if size > s.hold:
                held = [added([np.concatenate(c) for c in zip(*held, strict=True)])]
                size = len(held[0][0])
                if size > s.hold // 2:
                    yield from emitted(held[0])
                    held, size = [], 0
        if held:
            yield from emitted(added([np.concatenate(c) for c in zip(*held, strict=True)]))

    schema = ", ".join(f"{w} long" for w in [*names(s.max_words), "n"])
    # Dealt by their first node, so that its flow is added up where its edges are; tasks have put equal edges together before.
    dealt = docs.mapInArrow(rows, schema).repartition(*names(s.max_words - 1))
    return dealt.groupBy(*names(s.max_words)).agg(F.sum("n").alias("n"))


def phrases(docs: DataFrame, words: DataFrame, s: Settings) -> DataFrame:
    """size, w1, w2, ..., n: all phrases of at least s.least occurrences; shorter ones by the flow out of their node.

    The edges are read once: at each level, rows that stay go on as they are, and each row of the level goes on as flow of
    its node, with one word less."""
    all_ = names(s.max_words)
    level = edges(docs, words, s).withColumn("size", F.lit(s.max_words))
    for k in range(s.max_words, 0, -1):
        stays = (F.col("size") > k) | ((F.col("n") >= s.least) & (F.col(f"w{k}") != RARE))
        if k == 1:
            level = level.where(stays)
            break
        head, tail = all_[: k - 1], all_[k - 1 :]
        row = F.when(stays, F.struct("size", *tail, "n"))
        flow = F.when(F.col("size") == k, F.struct(F.lit(k - 1).alias("size"), *(F.lit(RARE).cast("long").alias(w) for w in tail), "n"))
        level = level.select(*head, F.explode(F.array_compact(F.array(row, flow))).alias("x")).select(*head, "x.*").groupBy(*head, "size", *tail).agg(F.sum("n").alias("n"))
    return store(level.select("size", *all_, "n"), "phrases")


def of_size(found: DataFrame, k: int, as_: list[str] | None = None, n: str = "n") -> DataFrame:
    return found.where(F.col("size") == k).select(*(F.col(w).alias(a) for w, a in zip(names(k), as_ or names(k), strict=True)), F.col("n").alias(n))


def paths(found: DataFrame, s: Settings) -> DataFrame:
    """w1, w2, ..., path, place, path_words for each frequent edge: the compacted path that it lies on (the words of its
    first edge), its place from 0 on, and the words of the path.

    An edge follows another where all flow of the node between them comes from the one and goes into the other. Pieces
    are finite, so such edges form no ring. Each round doubles how far an edge knows the way back."""
    k = s.max_words
    e = of_size(found, k)
    inner = names(k - 1, 2)
    into = e.join(of_size(found, k - 1, inner), [*inner, "n"]).select(F.struct(*names(k)).alias("before"), *(F.col(w).alias(v) for w, v in zip(inner, names(k - 1), strict=True)), "n")
    out = e.join(of_size(found, k - 1), [*names(k - 1), "n"])
    links = out.join(into, [*names(k - 1), "n"]).select(F.struct(*names(k)).alias("edge"), "before")
    state = store(e.select(F.struct(*names(k)).alias("edge")).join(links, "edge", "left").select("edge", "before", F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place")), "path")
    while True:
        b = state.select(F.col("edge").alias("before"), F.col("before").alias("further"), F.col("place").alias("more"))
        stepped = state.join(b, "before", "left").select("edge", F.coalesce("further", "before").alias("before"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("further").isNotNull().alias("moved"))
        stepped = store(stepped, "path")
        state = stepped.drop("moved")
        if not stepped.where("moved").limit(1).count():
            break
    state = state.select("edge", F.coalesce("before", "edge").alias("path"), "place")
    length = state.groupBy("path").agg((F.max("place") + k).alias("path_words"))
    return state.join(length, "path").select("edge.*", "path", "place", "path_words")


# Candidates ----------------------------------------------------------------------------------------------------------


def best_cut(found: DataFrame, k: int) -> DataFrame:
    """w1, ..., wk, a, l, r, score of each phrase of k words."""
    out, cuts = of_size(found, k, n="a"), []
    for j in range(1, k):
        out = out.join(of_size(found, j, n=f"l{j}"), names(j)).join(of_size(found, k - j, names(k - j, j + 1), f"r{j}"), names(k - j, j + 1))
        a, left, right = (f"cast({c} as decimal(18,0))" for c in ("a", f"l{j}", f"r{j}"))
        score = F.expr(f"(cast(1000000 as decimal(7,0)) * {a} * {a}) div ({left} * {right})")
        cuts.append(F.struct(score.alias("score"), F.lit(j).alias("k"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))
    cut = cuts[0] if len(cuts) == 1 else F.least(*cuts)  # of equal scores the one after fewer words
    return out.select(*names(k), "a", cut.alias("cut")).select(*names(k), "a", "cut.l", "cut.r", "cut.score")


def inside(found: DataFrame, k: int, s: Settings) -> DataFrame:
    """w1, ..., wk, most: the most frequent longer candidate around each phrase of k words."""
    around = [of_size(found, m).select(*(F.col(v).alias(w) for v, w in zip(names(k, i + 1), names(k), strict=True)), "n") for m in range(k + 1, s.max_words + 1) for i in range(m - k + 1)]
    return functools.reduce(DataFrame.unionByName, around).groupBy(*names(k)).agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, path_words: the best phrases of each language (docs: lang, text)."""
    s = settings
    if s.max_words < 2:
        raise ValueError("max_words must be 2 at least")
    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = vocabulary(read, s)
    found = phrases(read, words, s)
    on_path = store(paths(found, s), "on-path")
    parts = []
    for k in range(2, s.max_words + 1):
        one = best_cut(found, k)
        if k == s.max_words:
            one = one.join(on_path.select(*names(k), "path_words"), names(k))
        else:
            if k == s.max_words - 1:  # nodes inside a compacted path
                absorbed = on_path.where("place > 0").select(*names(k))
                one = one.join(absorbed, names(k), "left_anti")
            one = one.join(inside(found, k, s), names(k), "left").where(F.coalesce(100 * F.col("most") < s.contained * F.col("a"), F.lit(True))).drop("most")
            one = one.withColumn("path_words", F.lit(k).cast("long"))
        parts.append(spelled(one, words, k).select("lang", "phrase", "a", "l", "r", "score", "path_words"))
    # A language may hold most candidates, so the best of each of its shares are taken first.
    by = (F.desc("score"), F.desc("a"), "phrase")
    ranked = lambda df, *group: df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by)).cast("long")).where(F.col("rank") <= s.top)
    shares = functools.reduce(DataFrame.unionByName, parts).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(s.shares)))
    top = ranked(ranked(shares, "lang", "share").drop("rank", "share"), "lang")
    totals = words.where("code is null").select("lang", "n")
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")


def spelled(found: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """found with lang and phrase, the words of w1, ..., wk."""
    for i, w in enumerate(names(k)):
        one = words.where("code is not null").select(F.col("code").alias(w), F.col("word").alias(f"s{i}"), *(["lang"] if i == 0 else []))
        found = found.join(one, w)
    return found.withColumn("phrase", F.concat_ws(" ", *(f"s{i}" for i in range(k))))
