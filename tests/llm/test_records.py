import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.llm import queries, records

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
PARTS = records.Parts(PATH)
SF = "/root/testdata/sf0.001"


def plain_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert records.crc32c([b"123456789", b"\x00" * 32]).tolist() == [0xE3069283, 0x8A9136AA]  # known values of CRC-32C
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (0, 1, 2, 3, 4, 5, 8, 511, 512, 513, 1024, 5000, 7)]
    assert records.crc32c(parts).tolist() == [plain_crc(p) for p in parts]
    assert records.crc32c([]).tolist() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aein  '\n\t  \x1c<|>endoftx01")), max_size=60))
def test_parts_are_encoded_as_the_library_encodes_the_text(text):
    assert np.frombuffer(PARTS([text])[0], np.uint32).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a   b", "a  \n b", " a", "a ", "  ", "x <|endoftext|> y", "x  <|endoftext|>", "<|endoftext|>", "\n \n", "a　 b", "a 　b", "日本 語" * 500, "=" * 3000])
def test_odd_texts(text):
    assert np.frombuffer(PARTS([text, text])[1], np.uint32).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "it's they're I'll 's ''s 're'd 'sab 'LL 'l", "don't 'tis \n'vex 'r", "x'", "x 'm", "1's!'s", "a \n\n b\xa0\xa0c \x85d", "é ü\u0301x ÿß ²½ ٣ жук",
    "  \u3000 a", "a\u3000 b 語's it's", "“it’s” — 5 €, ok", "\x1c\x1d a\x1f b", "🙂's 🙂 's", "a\u2003 \u2003b",
])
def test_words_are_cut_as_the_library_cuts_them(text):
    for parts in (PARTS, records.Parts(PATH, remember=1, most_bytes=4)):
        many = ["", text, "'s", " ", text + " ", "", "s " + text, " x", text + "'", "re"]
        for _ in range(2):
            assert [np.frombuffer(x, np.uint32).tolist() for x in parts(many)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in many]
        assert np.frombuffer(parts([text * 9])[0], np.uint32).tolist() == LIBRARY.encode(text * 9, add_special_tokens=False).ids


def test_words_that_are_remembered_stay_within_a_bound():
    parts = records.Parts(PATH, remember=1000)
    for i in range(40):
        parts([" ".join(f"{c}{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for c in chr(97 + i % 26) + chr(65 + i % 26) for k in range(100)) + f" word{'x' * i}"])
    assert len(parts.known) <= 1300 and len(parts.older) <= 1300


def test_words_are_looked_up_once_a_batch(monkeypatch):
    """A text of one word many times costs one look at the table, not one a word: the time and memory of large tables."""
    parts, seen = records.Parts(PATH), []
    monkeypatch.setattr(parts, "of_words", lambda words, f=parts.of_words: seen.append(len(words)) or f(words))
    ids = parts([" over and over" * 5000, " over"])
    assert seen == [2] and np.frombuffer(ids[0], np.uint32).tolist() == LIBRARY.encode(" over and over" * 5000, add_special_tokens=False).ids


def test_other_files_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    other, parts = tokenizers.Tokenizer.from_file(path), records.Parts(path)
    other.no_truncation()
    other.no_padding()
    assert not parts.plain
    assert np.frombuffer(parts(["Two  Words, and MORE"])[0], np.uint32).tolist() == other.encode("Two  Words, and MORE", add_special_tokens=False).ids


def expected(docs):
    out, start = [], 0
    for d, text in sorted(docs, key=lambda r: (r[0], len((r[1] or "").encode()), (r[1] or "").encode())):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_as_the_library(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op12_records(spark, SF)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == expected(docs)


def test_defined_cases(spark, tmp_path):
    long = "word " * 60_000
    rows = [(5, "b", "x"), (5, "b", "y"), (1, None, "x"), (2, "", None), (9, long, "x"), (None, "tail", "x"), (5, "a a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = f"file://{tmp_path}/a"
    shards = records.write(docs, PATH, folder, records.Settings(shard_bytes=40, task_bytes=100_000))
    assert shards.count() > 2 and shards.agg({"n_records": "sum"}).first()[0] == 7
    got = records.fetch(records.index(spark, folder), folder).collect()
    want = expected([(records.NO_ID if r[0] is None else r[0], r[1]) for r in rows])
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got) == want
    mixed = records.shuffled(spark, folder, 3).collect()
    assert sorted(mixed) == sorted(got) and [r.start for r in mixed] != sorted(r.start for r in mixed)
    assert [r.start for r in records.shuffled(spark, folder, 3).collect()] == [r.start for r in mixed]
    empty = records.write(docs.limit(0), PATH, f"file://{tmp_path}/b")
    assert empty.count() == 0 and records.fetch(records.index(spark, f"file://{tmp_path}/b"), f"file://{tmp_path}/b").count() == 0


def test_damage_is_seen(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (2, "more words")], "doc_id long, text string")
    folder = str(tmp_path / "c")
    records.write(docs, PATH, folder)
    name = next(os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".rec"))
    raw = bytearray(open(name, "rb").read())
    for at in (0, 9, 14, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        open(name, "wb").write(bad)
        with pytest.raises(Exception, match="damaged record"):
            records.fetch(records.index(spark, folder), folder).collect()
    open(name, "wb").write(raw)
    assert records.fetch(records.index(spark, folder), folder).count() == 2
    assert raw[:8] == (8 + 2 * len([*LIBRARY.encode("some words").ids, 2])).to_bytes(8, "little")  # the frame of TFRecord
    assert not [f for f in os.listdir(folder) if f.endswith(".tmp")]
