import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = bpe.Vocabulary(PATH)
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


def ids(text):
    return bpe.Encoder(VOCABULARY)([text])[0].tolist()


def test_every_code_point_is_classed_as_in_the_library():
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    encoder = bpe.Encoder(VOCABULARY)
    for i in range(0, len(points), 20_000):
        text = "".join(f"a{c}1{c} " for c in points[i : i + 20_000])
        assert encoder([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinorst  '\n\t<|>endoftx0123")), max_size=60))
def test_as_the_library_encodes_and_decodes(text):
    got = ids(text)
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids
    assert VOCABULARY.decoded(np.array(got, np.int64)).decode() == LIBRARY.decode(got, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "<|endoftext|>x<|endoftext|>", "aaa aaaa aaaaa", "  \n\n  x  ", "don't we'll", "=" * 700, "日本語" * 900])
def test_long_and_odd_texts(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_proposals_are_accepted_only_if_right():
    words = list({w for i in range(0, 50_000, 7) for w in [VOCABULARY.spelled[i] + VOCABULARY.spelled[(i * 31) % 50_000]]})
    coded, failing = VOCABULARY.encoded(words)
    coded = [np.frombuffer(x, np.int32).tolist() for x in coded]
    assert coded == [VOCABULARY.merged(w) for w in words]
    short = [w for w in words if len(w) <= 48] + [b"a", b"aaa", b"aaaa", b"zqxj", b"\xff\xfe"]
    assert [np.frombuffer(x, np.int32).tolist() for x in VOCABULARY.merged_together(short)] == [VOCABULARY.merged(w) for w in short]
    assert 0 < failing < len(words)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "Hello wörld", "y"), (3, "Hello wörld", "y")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH).drop("text"), PATH).orderBy("doc_id").collect()
    assert [(r.doc_id, r.decoded) for r in out] == [(1, ""), (2, ""), (3, "Hello wörld"), (3, "Hello wörld")]
    assert out[0].ids == [] and out[2].ids == LIBRARY.encode("Hello wörld", add_special_tokens=False).ids
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    both = bpe.encode(docs, PATH, decoded="decoded").orderBy("doc_id").collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in both] == [(r.doc_id, r.ids, r.decoded) for r in out]
