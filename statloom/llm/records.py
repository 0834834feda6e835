"""Token ids in files of length-delimited binary records, with an offset index beside each file for shuffled reads.

A record is framed as in TFRecord files: its length (8 bytes), the masked CRC-32C of these 8 bytes (4), the data, and the
masked CRC-32C of the data (4), all little-endian. The data are the doc_id (8 bytes) and the ids as unsigned 16-bit
numbers, or 32-bit ones where the vocabulary needs them. ``NAME.idx`` has 32 bytes a record: doc_id, offset and length of
the record in ``NAME.rec``, and the ids before it in that file. A table of shards (Parquet) says how many records and ids
each has, and with them where its ids begin in the whole corpus.

Documents are dealt by ranges of doc_id, sorted within each, encoded and framed in their task; a shard is closed when it
reaches a size, so no task holds more than a batch and no shard grows with the corpus. A file is written under a name of
its own attempt and then renamed: a task that is run again, or twice at once, leaves the same file.

Texts are encoded by the ``tokenizers`` library. Where the file is plain byte-level BPE, the words of a batch of texts are
found by arrays, as the library's own rule cuts them, and each different word is encoded by the library once and remembered
up to a bound; texts that have added tokens and other files go to the library text by text.

Defined cases: a null or empty text is a record with the end id alone; rows with one doc_id are records of their own,
shortest text first, then by the text, and a null doc_id counts as the smallest number of 64 bits; very long texts are one
record; an empty table makes no shard; further columns, whatever their names, are not read. A record whose checksum or
length is wrong raises.
"""

from __future__ import annotations

import functools
import json
import os
import posixpath
import re
import uuid
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm.bpe import by_size, byte_letters
from statloom.llm.common import scratch

NO_ID = -(2**63)


@dataclass(frozen=True)
class Settings:
    end: int = 2  # the id after each document
    shard_bytes: int = 64 << 20  # a shard is closed when it has so many
    task_bytes: int = 32 << 20  # of text, for a task


# Checksums -----------------------------------------------------------------------------------------------------------


def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32C (reflected polynomial 0x82F63B78) of one byte, and of two."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ (np.uint32(0x82F63B78) * (one & 1))
    low = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        low = one[low & 255] ^ (low >> 8)
    return one, low


ONE, TWO = crc_tables()
BLOCK = 512  # bytes that are taken in step


@functools.cache
def past_block() -> np.ndarray:
    """What BLOCK zero bytes make of each byte of a remainder: 4 tables of 256."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]).ravel()
    for _ in range(BLOCK // 2):
        state = TWO[state & 65535] ^ (state >> 16)
    return state.reshape(4, 256)


def crc32c(parts: list[bytes]) -> np.ndarray:
    """The CRC-32C of each part. A remainder of zero stays zero over zero bytes, so parts are filled up in front, blocks
    are reduced side by side, and each part's blocks are then put together."""
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    blocks = -(-np.maximum(n, 4) // BLOCK)
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1]) * BLOCK if len(parts) else 0, np.uint8)
    at = (ends * BLOCK - n).tolist()
    for p, i in zip(parts, at, strict=True):
        data[i : i + len(p)] = np.frombuffer(p, np.uint8)
    begins = np.array(at, np.int64)
    first = begins[:, None] + np.arange(4)
    inside = np.arange(4)[None, :] < n[:, None]
    data[first[inside]] ^= 255  # the remainder starts as ones
    pairs = np.ascontiguousarray(data.view("<u2").reshape(-1, BLOCK // 2).T)
    state = np.zeros(pairs.shape[1], np.uint32)
    for column in pairs:
        state = TWO[(state & 65535) ^ column] ^ (state >> 16)
    tables, out, place = past_block(), np.zeros(len(parts), np.uint32), ends - blocks
    live = np.arange(len(parts))
    while len(live):
        s = out[live]
        out[live] = tables[0][s & 255] ^ tables[1][(s >> 8) & 255] ^ tables[2][(s >> 16) & 255] ^ tables[3][s >> 24] ^ state[place[live]]
        place[live] += 1
        live = live[place[live] < ends[live]]
    short = np.flatnonzero(n < 4)  # fewer bytes than the remainder has: byte by byte
    for k in short.tolist():
        s = np.uint32(0xFFFFFFFF)
        for b in parts[k]:
            s = ONE[(s ^ np.uint32(b)) & np.uint32(255)] ^ (s >> np.uint32(8))
        out[k] = s
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated by 15 bits, plus a constant: a checksum of data that hold checksums stays telling."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


# Encoding ------------------------------------------------------------------------------------------------------------


class Parts:
    """Encodes texts by the library, each different word once.

    Byte-level BPE cuts a text into words by the kinds of its characters and merges within them. The words of a batch are
    found by arrays over its bytes, for characters of one and two bytes, whose kinds the library itself tells. A space
    before a character that is no white space always begins a word, whatever stands before; so where there are longer
    characters, all from such a space to the next is one word here, and the library cuts it."""

    LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4
    PIECE = re.compile(rb" (?=[A-Za-z])")

    def __init__(self, path: str, remember: int = 50_000, most_bytes: int = 8 << 20):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        cut = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.plain = (
            spec["model"]["type"] == "BPE" and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in added)
            and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout") and not spec["model"].get("unk_token") and byte_letters().keys() <= spec["model"]["vocab"].keys()
        )
        self.added = [t["content"] for t in added if t["content"]]
        if self.plain:
            self.kinds = np.array([self.kind(chr(c)) for c in range(0x800)], np.uint8)
            self.of_byte = np.append(self.kinds[:128], np.zeros(128, np.uint8))
            self.letters = "".join(sorted(byte_letters(), key=byte_letters().get))  # the letter that stands for each byte
            self.stretch = re.compile(b"|".join([rb"[\xe0-\xff]", *(re.escape(chr(c).encode()) for c in np.flatnonzero(self.kinds == 0).tolist())]))
        self.remember, self.most_bytes, self.known, self.older = remember, most_bytes, {}, {}

    def kind(self, c: str) -> int:
        """Which one of these the library joins with the character; 0 if not just one."""
        joined = [k for k, x in ((self.LETTER, "a"), (self.NUMBER, "1"), (self.WHITE, "\n"), (self.OTHER, "!")) if len(self.library.pre_tokenizer.pre_tokenize_str(x + c)) == 1]
        return joined[0] if len(joined) == 1 else 0

    def begins(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Where words begin in the bytes of texts, which begin at the places in texts."""
        n = len(data)
        kind = self.of_byte[data]
        two = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
        kind[two] = kind[two + 1] = self.kinds[(data[two] & 31).astype(np.int64) << 6 | (data[two + 1] & 63)]
        new = np.zeros(n + 4, bool)  # a text begins, or all are over
        new[texts], new[n:] = True, True
        first = new.copy()
        first[1:n] |= kind[1:] != kind[:-1]
        white = kind == self.WHITE
        after = np.flatnonzero(white[:-1] & ~white[1:]) + 1
        after = after[~new[after]]
        first[after - 1 - (data[after - 1] > 127)] = True  # the last white space stands apart from those before it,
        first[after[data[after - 1] == 32]] = False  # and a space with what follows
        quote = np.flatnonzero(data == 39)
        quote = quote[first[quote] & ~new[quote + 1]]
        one, next_ = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
        short = quote[(one == 115) | (one == 116) | (one == 109) | (one == 100)]  # 's, 't, 'm, 'd
        long = quote[((((one == 114) | (one == 118)) & (next_ == 101)) | ((one == 108) & (next_ == 108))) & ~new[quote + 2]]  # 're, 've, 'll
        first[short + 1], first[short + 2], first[long + 1], first[long + 3] = False, True, False, True
        odd = np.flatnonzero(kind == 0)
        if len(odd):
            space = np.flatnonzero((data[:-1] == 32) & ~white[1:] & (kind[1:] > 0) & ~new[1:n])
            sure = new[:n].copy()
            sure[space] = True
            stretch = np.cumsum(sure)
            mixed = np.zeros(stretch[-1] + 1, bool)
            mixed[stretch[odd]] = True
            first[:n] &= sure | ~mixed[stretch]
        return np.flatnonzero(first[:n])

    def learnt(self, words: list[bytes]) -> list[bytes]:
        """The ids of the words by the library: by its model at once, but for stretches, which it has to cut."""
        tokenize, letters, stretch = self.library.model.tokenize, self.letters, self.stretch.search
        mixed = [k for k, w in enumerate(words) if stretch(w)]
        if mixed:
            out = self.learnt([b"" if stretch(w) else w for w in words])
            for k, x in zip(mixed, self.by_library([words[k].decode() for k in mixed]), strict=True):
                out[k] = x
            return out
        return [array("I", [t.id for t in tokenize(charmap_decode(w, "strict", letters)[0])]).tobytes() for w in words]

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words. Those that are known come from two bounded tables; of the older one, words that come
        again move to the newer one."""
        if len(self.known) > self.remember:
            self.known, self.older = {}, self.known
        out = list(map(self.known.get, words))
        if None in out:
            missing = [k for k, x in enumerate(out) if x is None]
            found = list(map(self.older.get, [words[k] for k in missing]))
            new = [k for k, x in zip(missing, found, strict=True) if x is None]
            learnt = iter(self.learnt([words[k] for k in new]))
            for k, x in zip(missing, found, strict=True):
                out[k] = next(learnt) if x is None else x
                if len(words[k]) <= 60:
                    self.known[words[k]] = out[k]
        return out

    def coded(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        if not self.plain:
            return self.by_library(texts.to_pylist())
        texts = texts.cast(pa.binary())
        special = functools.reduce(pc.or_, [pc.match_substring(texts, t) for t in self.added], pa.array([False] * len(texts)))
        whole = np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()
        if whole:
            out = self.coded(pc.if_else(special, b"", texts))
            for k, x in zip(whole, self.by_library([texts[k].as_py().decode() for k in whole]), strict=True):
                out[k] = x
            return out
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if len(texts) == 1 and ends[1] - ends[0] > self.most_bytes:
            return [b"".join(x for p in self.pieces(texts[0].as_py()) for x in self.in_words(np.frombuffer(p, np.uint8), np.array([0, len(p)])))]
        return self.in_words(np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0])

    def pieces(self, text: bytes) -> Iterator[bytes]:
        """A long text in pieces that begin with a space before a letter."""
        i = 0
        while i < len(text):
            cut = self.PIECE.search(text, i + self.most_bytes)
            j = cut.start() if cut else len(text)
            yield text[i:j]
            i = j

    def in_words(self, data: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of each text of data, whose bytes lie between neighbours in ends."""
        if not len(data):
            return [b""] * (len(ends) - 1)
        at = self.begins(data, ends[:-1][ends[1:] > ends[:-1]])
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self.of_words(words.dictionary.to_pylist()), pa.binary()).take(words.indices)
        bounds = np.frombuffer(ids.buffers()[1], np.int32)[np.searchsorted(at, ends)].tolist()
        flat = ids.buffers()[2].to_pybytes()
        return [flat[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.coded(pa.array(texts, pa.string()))


@functools.lru_cache(2)
def encoder_of(path: str) -> Parts:
    """Kept in a Python worker from task to task."""
    return Parts(path)


# Files ---------------------------------------------------------------------------------------------------------------


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system that tasks can open, and the path in it (any that Arrow knows: local or mounted, HDFS, S3, GCS, ABFS)."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def unused() -> None:
    """Gives back what Arrow keeps of memory that it has freed: workers live on, several to a core, when their task is over."""
    pa.default_memory_pool().release_unused()


def framed(doc_ids: list[int], coded: list[bytes], kind: str) -> list[bytes]:
    data = [np.int64(d).tobytes() + np.frombuffer(c, np.uint32).astype(kind).tobytes() for d, c in zip(doc_ids, coded, strict=True)]
    heads = [len(x).to_bytes(8, "little") for x in data]
    of_heads, of_data = masked(crc32c(heads)).astype("<u4").tobytes(), masked(crc32c(data)).astype("<u4").tobytes()
    return [h + of_heads[4 * i : 4 * i + 4] + x + of_data[4 * i : 4 * i + 4] for i, (h, x) in enumerate(zip(heads, data, strict=True))]


class Shard:
    """One open pair of files; close() gives its row of the table of shards."""

    def __init__(self, folder: str, name: str):
        self.files, root = place(folder)
        self.name, self.attempt = posixpath.join(root, name), f".{uuid.uuid4().hex}.tmp"
        self.out = self.files.open_output_stream(self.name + ".rec" + self.attempt)
        self.rows, self.bytes, self.ids, self.index = 0, 0, 0, []

    def add(self, doc_ids: list[int], records: list[bytes], n_ids: np.ndarray) -> None:
        sizes = np.fromiter(map(len, records), np.int64, len(records))
        rows = np.empty((len(records), 4), "<i8")
        rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = doc_ids, self.bytes + np.cumsum(sizes) - sizes, sizes, self.ids + np.cumsum(n_ids) - n_ids
        self.index.append(rows.tobytes())
        self.out.write(b"".join(records))
        self.rows, self.bytes, self.ids = self.rows + len(records), self.bytes + int(sizes.sum()), self.ids + int(n_ids.sum())

    def close(self) -> tuple[int, int, int]:
        self.out.close()
        with self.files.open_output_stream(self.name + ".idx" + self.attempt) as f:
            f.write(b"".join(self.index))
        for kind in (".rec", ".idx"):
            self.files.move(self.name + kind + self.attempt, self.name + kind)
        return self.rows, self.ids, self.bytes


SHARDS = "part int, piece int, name string, n_records long, n_ids long, n_bytes long, width int"


def write(docs: DataFrame, path: str, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Writes the records of docs (doc_id, text) to the folder, a new one that tasks can reach, and returns the shards."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    amount = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(1, -(-amount // settings.task_bytes))
    files, root = place(folder)
    files.create_dir(root, recursive=True)
    kind = "<u4" if encoder_of(path).size > 65536 or settings.end > 65535 else "<u2"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, piece, shard, tail = encoder_of(path), TaskContext.get().partitionId(), 0, None, np.uint32(settings.end).tobytes()

        def closed() -> pa.RecordBatch:
            one = (part, piece, f"part-{part:06d}-{piece:04d}", *shard.close(), int(kind[2]))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["part", "piece", "name", "n_records", "n_ids", "n_bytes", "width"])

        for batch in batches:
            for i, j in by_size(batch.column(1), 4 << 20):
                ids = batch.column(0).slice(i, j - i).to_pylist()
                coded = [c + tail for c in coder.coded(batch.column(1).slice(i, j - i))]
                shard = shard or Shard(folder, f"part-{part:06d}-{piece:04d}")
                shard.add(ids, framed(ids, coded, kind), np.fromiter(map(len, coded), np.int64, len(coded)) // 4)
                if shard.bytes >= settings.shard_bytes:
                    yield closed()
                    shard, piece = None, piece + 1
            unused()
        if shard:
            yield closed()

    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.octet_length("text"), "text")
    dealt.mapInArrow(shards, SHARDS).write.parquet(f"{folder}/shards")
    return shards_of(docs.sparkSession, folder)


def shards_of(spark: SparkSession, folder: str) -> DataFrame:
    """The shards in the order of their documents, with the ids in all shards before (a row each: small beside the data)."""
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(SHARDS).parquet(f"{folder}/shards").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def index(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record: shard, width, doc_id, offset, length, start (ids of all records before it in the corpus)."""
    shards = shards_of(spark, folder).select("name", "n_records", "width", "start")
    n = shards.count()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = place(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with files.open_input_stream(posixpath.join(root, r["name"] + ".idx")) as f:
                    left = r["n_records"]
                    while left:
                        found = np.frombuffer(f.read(32 * min(left, 50_000)), "<i8").reshape(-1, 4)
                        if not len(found):
                            raise ValueError(f"{r['name']}.idx ends before its last record")
                        left -= len(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["name"]] * len(found)), pa.array(np.full(len(found), r["width"], np.int32)), *(pa.array(found[:, k]) for k in (0, 1, 2)), pa.array(found[:, 3] + r["start"])],
                            names=["name", "width", "doc_id", "offset", "length", "start"],
                        )

    return shards.repartition(max(1, n)).mapInArrow(rows, "name string, width int, doc_id long, offset long, length long, start long")


def fetch(records: DataFrame, folder: str, most_bytes: int = 2 << 20) -> DataFrame:
    """The records that rows of the index name, in the rows' order: doc_id, start, n_tokens, ids (binary, 32-bit numbers).

    Neighbours in a shard are read together; rows in another order (``index(...).orderBy(rand(seed))``) one by one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = place(folder)
        name, source = None, None
        for batch in batches:
            names, width, offset, length = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            i = 0
            while i < len(names):
                j, size = i + 1, int(length[i])
                while j < len(names) and names[j] == names[i] and offset[j] == offset[j - 1] + length[j - 1] and size < most_bytes:
                    size += int(length[j])
                    j += 1
                if names[i] != name:
                    name, source = names[i], files.open_input_file(posixpath.join(root, names[i] + ".rec"))
                found = source.read_at(size, int(offset[i]))
                at = (offset[i:j] - offset[i]).tolist()
                each = [found[a : a + n] for a, n in zip(at, length[i:j].tolist(), strict=True)]
                ids = unframed(each, batch.column(2).slice(i, j - i).to_pylist(), f"<u{width[i]}", name)
                n_ids = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), batch.column(5).slice(i, j - i), pa.array(n_ids), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                i = j
            unused()

    return records.select("name", "width", "doc_id", "offset", "length", "start").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


def unframed(records: list[bytes], doc_ids: list[int], kind: str, name: str) -> list[bytes]:
    """The ids of each record; raises where a length, a checksum or the document is wrong."""
    heads, data = [r[:8] for r in records], [r[12:-4] for r in records]
    said = np.frombuffer(b"".join(r[8:12] + r[-4:] for r in records), "<u4").reshape(-1, 2)
    right = (masked(crc32c(heads)) == said[:, 0]) & (masked(crc32c(data)) == said[:, 1])
    right &= np.array([int.from_bytes(h, "little") == len(x) and int.from_bytes(x[:8], "little", signed=True) == d for h, x, d in zip(heads, data, doc_ids, strict=True)], bool)
    if not right.all():
        raise ValueError(f"{name}.rec: damaged record of document {doc_ids[int(np.flatnonzero(~right)[0])]}")
    return [np.frombuffer(x, kind, offset=8).astype("<u4").tobytes() for x in data]


def shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """All records in an order that the seed decides."""
    return fetch(index(spark, folder).orderBy(F.xxhash64(F.lit(seed), "doc_id", "start"), "start"), folder)


def new_folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/records-{uuid.uuid4().hex}"
