import math
import random

import pytest

from statloom.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute_force(model, word):
    """Every pre-token by itself, by recursion over the first piece."""
    best = {len(word): (0.0, 0)}
    for i in reversed(range(len(word))):
        n = len(word[i].encode())
        options = [(best[i + 1][0] + n * model.byte_score, -(n - best[i + 1][1]))]
        options += [(model.score[p] + best[j][0], best[j][1] - 1) for j in range(i + 1, len(word) + 1) if (p := word[i:j]) in model.score]
        best[i] = max(options)
    return -best[0][1]


def test_counts_as_brute_force():
    model = token_counts.Unigram(PATH)
    rng = random.Random(1)
    words = sorted({"▁" + "".join(rng.choice("aeitnrshé一☃") for _ in range(rng.randrange(0, 14))) for _ in range(1500)})
    assert model.counts(words) == {w: brute_force(model, w) for w in words}


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "the the cat", 5), (4, "the the cat", 5), (None, "the", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumn("row", token_counts.F.lit(0)).withColumn("others", token_counts.F.lit(0))
    model = token_counts.Unigram(PATH)
    n = 2 * brute_force(model, "▁the") + brute_force(model, "▁cat")
    for shared in (1 << 19, 2, 1):  # all words broadcast, some, none
        out = sorted(token_counts.token_counts(docs, PATH, fitted=False, shared=shared).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
        assert [tuple(r) for r in out] == [(None, 1, brute_force(model, "▁the")), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 3, n), (4, 3, n)]
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0
    assert {r.pretoken: r.n for r in token_counts.vocabulary(docs).collect()} == {"▁the": 5, "▁cat": 2}


def test_each_pretoken_is_scored_once_in_the_corpus(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abné☃") for _ in range(rng.randrange(1, 7))) for _ in range(60))) for i in range(50)]
    words = token_counts.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"))
    model = token_counts.Unigram(PATH, token_counts.fit(words, PATH))
    known = token_counts.terminal_counts(words, PATH, token_counts.fit(words, PATH)).collect()
    assert len(known) == len({w for _, t in rows for w in t.split()}) == len({r.pretoken for r in known})
    assert all(r.n_tokens == brute_force(model, r.pretoken) for r in known)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH, shared=500).collect()}
    assert got == {i: sum(brute_force(model, "▁" + w) for w in t.split()) for i, t in rows}


def test_very_long_texts_and_words(spark):
    rows = [(1, "ab " * 300_000 + "a" * 30_000), (2, "ab")]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH, fitted=False).collect()}
    model = token_counts.Unigram(PATH)
    long = "▁" + "a" * 30_000
    assert got[2] == (1, brute_force(model, "▁ab")) and got[1] == (300_001, 300_000 * got[2][1] + model.counts([long])[long])


def test_fitted_scores_count_as_the_encoder(spark):
    """The file's scores are ranks of merges; summed, they cut this sentence of 12 words into more than 30 pieces."""
    text = "The quick brown fox jumps over the lazy dog near international organizations"
    docs = spark.createDataFrame([(1, text), (2, text + "\n" + text), (3, "é☃ T h e"), (4, None)], "doc_id long, text string")
    scores = token_counts.fit(token_counts.vocabulary(docs), PATH)
    assert set(scores) == set(token_counts.Unigram(PATH).score) and max(scores.values()) < 0
    assert abs(sum(math.exp(s) for s in scores.values()) - 1) < 1e-6
    encoder, _ = token_counts.encoder(PATH)
    n = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH).collect()}
    assert n[1] == len(encoder.encode(text)) and n[2] == 2 * n[1]
    assert {r.n_tokens for r in token_counts.token_counts(docs.where("doc_id = 1"), PATH, fitted=False).collect()} != {n[1]}
