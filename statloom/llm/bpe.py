"""Byte-level BPE by speculation: longest matches propose tokens, a vectorised check of adjacent pairs accepts them.

Every token has one merge tree. While a token is built, its last piece runs through the tree's right edge and its first
piece through the left edge, each alive from its own merge's rank to its parent's. Two neighbours are compatible if no
merge of a right-edge piece of the left token with a left-edge piece of the right one would come before either piece is
taken up by its own parent. A proposal in which each adjacent pair is compatible is what merging by rank gives; other
words are merged exactly. Words are encoded once and remembered up to a bound.

The vocabulary is a file of the ``tokenizers`` library; its path is a parameter. It is of fixed size (a few MB), read on
the driver and broadcast. Special tokens written in a text become their ids, as that library does by default.

Defined cases: a null text is an empty one (no ids, decoded to an empty text); rows are encoded one by one, so repeated
rows give repeated results; an empty table gives none; further columns stay as they are, and a column named as the output
column is replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: How byte-level BPE cuts a text into words (white space as Unicode has it).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NEVER = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Words up to this many bytes are proposed and merged many at a time.
SHORT = 48
STEP = np.uint64(0x9E3779B97F4A7C15)


class OpenTable:
    """A hash table of 64-bit numbers that is read many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 18):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            turn = left[np.unique(at[left], return_index=True)[1]]
            turn = turn[self.values[at[turn]] < 0]
            self.keys[at[turn]], self.values[at[turn]] = keys[turn], values[turn]
            left = np.setdiff1d(left, turn, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, wanted: np.ndarray, missing: int) -> np.ndarray:
        out, at, open_ = np.full(len(wanted), missing, np.int32), self.slot(wanted), np.arange(len(wanted))
        while len(open_):
            found = self.values[at[open_]]
            same = (self.keys[at[open_]] == wanted[open_]) & (found >= 0)
            out[open_[same]] = found[same]
            open_ = open_[~same & (found >= 0)]
            at[open_] = (at[open_] + 1) & self.mask
        return out


class Vocabulary:
    """The tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        text = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {bytes(letters[c] for c in t): i for t, i in text.items() if t not in self.special}
        size = 1 + max([*text.values(), *self.special.values()])
        self.spelled = [b""] * size
        for b, i in self.token.items():
            self.spelled[i] = b
        for t, i in self.special.items():
            self.spelled[i] = t.encode()
        self.bytes_ = [self.token[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}  # pair of tokens: rank, merged token
        parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            x, y, xy = text[a], text[b], text[a + b]
            self.rank[x, y] = (r, xy)
            parts.setdefault(xy, (x, y, r))
        self.size, self.into = size, np.array([xy for _, xy in self.rank.values()], np.int64)  # the rules by rank
        self.rules = OpenTable(np.array([a * size + b for a, b in self.rank], np.uint64), np.arange(len(self.rank)))
        self.right, self.right_until = self.edges(parts, 1)
        self.left, self.left_until = self.edges(parts, 0)
        self.own = {b: i for b, i in self.token.items() if self.merged(b) == [i]}  # proposals use these only
        self.longest: dict[bytes, int] = {}  # of the tokens that begin with these two bytes
        for b in self.own:
            self.longest[b[:2]] = max(len(b), self.longest.get(b[:2], 0))
        short = [b for b in self.own if len(b) <= SHORT]
        self.prints = OpenTable(np.array([self.print_of(b) for b in short], np.uint64), np.array([self.own[b] for b in short]))
        self.lengths = np.array([len(b) for b in self.spelled], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(self.spelled), np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the rule that merges each a with its b, NEVER if there is none."""
        return self.rules.get(a.astype(np.uint64) * np.uint64(self.size) + b.astype(np.uint64), NEVER)

    def edges(self, parts: dict[int, tuple[int, int, int]], side: int) -> tuple[np.ndarray, np.ndarray]:
        """Each token's pieces on one side of its tree, from the whole token down, and the rank until which each lives."""
        rows = []
        for t in range(self.size):
            row, until = [(t, NEVER)], t
            while until in parts:
                piece = parts[until][side]
                row.append((piece, parts[until][2]))
                until = piece
            rows.append(row)
        depth = max(map(len, rows))
        piece, until = np.full((self.size, depth), -1, np.int32), np.full((self.size, depth), -1, np.int32)
        for t, row in enumerate(rows):
            piece[t, : len(row)], until[t, : len(row)] = [x for x, _ in row], [u for _, u in row]
        return piece, until

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each token of a stays whole before its neighbour in b."""
        ok = np.ones(len(a), bool)
        for i in range(self.right.shape[1]):
            live = np.flatnonzero(ok & (self.right[a, i] >= 0))
            for j in range(self.left.shape[1]):
                live = live[self.left[b[live], j] >= 0]
                if not len(live):
                    break
                rank = self.ranks(self.right[a[live], i], self.left[b[live], j])
                # Of equal merges the left one comes first, so a tie with the right token's own merge breaks it.
                ok[live[(rank < self.right_until[a[live], i]) & (rank <= self.left_until[b[live], j]) & (rank < NEVER)]] = False
        return ok

    def proposal(self, word: bytes) -> list[int]:
        out, i, n, own, longest = [], 0, len(word), self.own, self.longest
        while i < n:
            for j in range(min(n, i + longest.get(word[i : i + 2], 1)), i, -1):
                if (t := own.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def print_of(self, token: bytes) -> int:
        h = 0
        for c in token:
            h = (h * 0xC2B2AE3D27D4EB4F + c + 1) & (2**64 - 1)
        return h

    def proposals(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The proposals of short words, one after the other, and how many tokens each has: the longest token at every
        place by rolling prints of growing length, then a walk along them."""
        whole = b"".join(words)
        text = np.frombuffer(whole, np.uint8)
        n = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(n)
        left = np.repeat(ends, n) - np.arange(len(text))
        token, length = np.array(self.bytes_, np.int32)[text], np.ones(len(text), np.int64)
        at, h = np.arange(len(text)), text.astype(np.uint64) + np.uint64(1)
        for k in range(2, SHORT + 1):
            more = left[at] >= k
            at, h = at[more], h[more]
            if not len(at):
                break
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + text[at + k - 1] + np.uint64(1)
            found = self.prints.get(h, -1)
            hit = found >= 0
            token[at[hit]], length[at[hit]] = found[hit], k
        here, word = (ends - n)[n > 0], np.flatnonzero(n > 0)
        tokens, owners = [], []
        while len(here):
            tokens.append(token[here])
            owners.append(word)
            here = here + length[here]
            on = here < ends[word]
            here, word = here[on], word[on]
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        flat = np.concatenate(tokens)[order].astype(np.int64) if tokens else np.empty(0, np.int64)
        if self.decoded(flat) != whole:  # two strings with one print
            each = [self.proposal(w) for w in words]
            return np.fromiter(chain.from_iterable(each), np.int64), np.array([len(x) for x in each], np.int64)
        return flat, np.bincount(owner, minlength=len(words))

    def merged(self, word: bytes) -> list[int]:
        """Merging by rank, of equal ranks the leftmost first."""
        ids: list[int] = [self.bytes_[b] for b in word]
        n = len(ids)
        after, before, gone = [*range(1, n), -1], [*range(-1, n - 1)], [False] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, xy = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != x or ids[j] != y:
                continue  # one of the two has been merged since
            ids[i], gone[j], after[i] = xy, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.rank.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [t for t, g in zip(ids, gone, strict=True) if not g]

    def merged_together(self, words: list[bytes]) -> list[bytes]:
        """The same for many short words at once, as bytes: in each round every word makes its next merge."""
        n = np.array([len(w) for w in words], np.int64)
        ids = np.array(self.bytes_, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), n)
        rank = np.append(np.where(of[:-1] == of[1:], self.ranks(ids[:-1], ids[1:]), NEVER), NEVER)
        out = [b""] * len(words)
        while len(ids):
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            best = np.flatnonzero((rank == np.repeat(low, size)) & (rank < NEVER))
            leftmost = np.ones(len(best), bool)
            leftmost[1:] = of[best[1:]] != of[best[:-1]]
            best = best[leftmost]
            done = np.flatnonzero(low == NEVER)
            if len(done):
                spelled = ids.astype(np.int32).tobytes()
                for word, i, j in zip(of[first[done]].tolist(), (4 * first[done]).tolist(), (4 * (first[done] + size[done])).tolist(), strict=True):
                    out[word] = spelled[i:j]
            ids[best] = self.into[rank[best]]
            stays = np.repeat(low < NEVER, size)
            stays[best + 1] = False
            changed = np.cumsum(stays)[best] - 1
            ids, of, rank = ids[stays], of[stays], rank[stays]
            for at in (changed, changed[changed > 0] - 1):
                at = at[at < len(ids) - 1]
                rank[at] = np.where(of[at] == of[at + 1], self.ranks(ids[at], ids[at + 1]), NEVER)
            if len(changed):
                rank[-1] = NEVER
        return out

    def encoded(self, words: list[bytes]) -> tuple[list[bytes], int]:
        """The ids of each word as the bytes of 32-bit numbers, and how many words needed exact merging."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]) > SHORT)  # the long ones last
        n_short = sum(len(w) <= SHORT for w in words)
        words = [words[k] for k in order]
        flat, counts = self.proposals(words[:n_short])
        long = [self.proposal(w) for w in words[n_short:]]
        flat = np.concatenate([flat, *(np.array(x, np.int64) for x in long)])
        ends = np.cumsum(np.concatenate([counts, np.array([len(x) for x in long], np.int64)]))
        inner = np.ones(max(0, len(flat) - 1), bool)
        inner[ends[:-1][ends[:-1] < len(flat)] - 1] = False  # no pair from one word to the next
        at = np.flatnonzero(inner)
        pairs, which = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
        bad = at[~self.compatible(pairs // self.size, pairs % self.size)[which]]
        failing = np.unique(np.searchsorted(ends, bad, "right")).tolist()
        spelled, cuts = flat.astype(np.int32).tobytes(), (4 * ends).tolist()
        ids = [spelled[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]
        short = [k for k in failing if k < n_short]
        for k, x in zip(short, self.merged_together([words[k] for k in short]) if short else [], strict=True):
            ids[k] = x
        for k in failing:
            if k >= n_short:
                ids[k] = np.array(self.merged(words[k]), np.int32).tobytes()
        back = [b""] * len(ids)
        for k, x in zip(order, ids, strict=True):
            back[k] = x
        return back, len(failing)

    def decoded(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        at = np.repeat(self.begins[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.letters[at].tobytes()


@functools.lru_cache(4)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, remember: int = 150_000):
        self.v, self.remember, self.known = vocabulary, remember, {}
        self.words = regex.compile(WORDS)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None
        self.known_special = {t: np.int32(i).tobytes() for t, i in self.v.special.items()}

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.words.findall(text)
        parts = self.special.split(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.words.findall(part))]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known
        new = [w for w in set(chain.from_iterable(split)) if w not in known]
        special = [w for w in new if w in self.known_special]
        plain = [w for w in new if w not in self.known_special]
        if plain:
            known.update(zip(plain, self.v.encoded([w.encode() for w in plain])[0], strict=True))
        known.update((w, self.known_special[w]) for w in special)
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]


def by_size(column: pa.Array, most_bytes: int, most_rows: int = 2000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded size; a longer row stands alone."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (size + n > most_bytes or i - start >= most_rows):
            yield start, i
            start, size = i, 0
        size += int(n)
    if len(sizes) > start:
        yield start, len(sizes)


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """One broadcast of a file's tables for all jobs of a session, so that workers hold one copy."""
    if (spark.sparkContext.applicationId, path) not in SHARED:
        SHARED[spark.sparkContext.applicationId, path] = spark.sparkContext.broadcast(vocabulary_of(path))
    return SHARED[spark.sparkContext.applicationId, path]


SHARED: dict[tuple[str, str], Broadcast] = {}


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the column ids array<int>. decoded: a further column, the text that the ids spell, in the same pass."""
    vocabulary = shared_vocabulary(docs.sparkSession, path)
    columns = [c for c in docs.columns if c not in (ids, decoded)]
    at = columns.index(text)
    names = [*columns, ids, *([decoded] if decoded else [])]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        encoder = Encoder(v)
        for batch in batches:
            for i, j in by_size(batch.column(at), 4 << 20):
                part = batch.slice(i, j - i)
                each = encoder(part.column(at).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
                found = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))]
                if decoded:
                    found.append(pa.array([v.decoded(x).decode("utf-8", "replace") for x in each], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=names)

    schema = docs.select(*columns).schema.add(ids, ArrayType(IntegerType()))
    return docs.select(*columns).mapInArrow(rows, schema.add(decoded, StringType()) if decoded else schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The frame with the text that the ids spell; null ids spell an empty one."""
    vocabulary = shared_vocabulary(encoded.sparkSession, path)
    columns = [c for c in encoded.columns if c != text]
    at = columns.index(ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                each = [v.decoded(x.values.to_numpy()).decode("utf-8", "replace") if x.is_valid and len(x) else "" for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(each, pa.string())], names=[*columns, text])

    return encoded.select(*columns).mapInArrow(rows, encoded.select(*columns).schema.add(text, "string"))
