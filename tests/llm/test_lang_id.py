import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import lang_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_held_out_accuracy(spark, docs):
    out = lang_id.predict(docs, lang_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where(lang_id.held_out() & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    total, right = held.count(), held.where("lang = lang_pred").count()
    assert total > 150 and right / total > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0
    assert out.count() == docs.count()


def test_undetermined_and_odd_rows(spark, docs):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "the cat and the dog"), (5, "é"), (5, "é")], "doc_id long, text string")
    out = lang_id.predict(odd, lang_id.train(docs)).collect()
    by = {r.doc_id: r for r in out}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0.0
    assert by[None].lang_pred == "en" and len(out) == 6 and by[5].lang_pred != "und"


def test_few_labels(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert lang_id.predict(none, lang_id.train(none)).first().lang_pred == "und"
    one = spark.createDataFrame([(i, "abc", "xx") for i in range(8)], "doc_id long, text string, lang string")
    r = lang_id.predict(one, lang_id.train(one)).first()
    assert (r.lang_pred, r.score) == ("xx", 1.0)
    assert lang_id.predict(one.limit(0), lang_id.train(one)).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark, docs):
    flipped = docs.withColumn("lang", F.when(lang_id.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert lang_id.train(flipped)["langs"] == ["de", "en", "es", "fr"]


def test_three_families_vote():
    import numpy as np

    w = lambda *x: np.array(x, np.float32)
    model = {"pairs": {("family", "a", "b"): w(1, 0, 0), ("family", "a", "c"): w(1, 0, 0), ("family", "b", "c"): w(0, 1, 0)}}
    assert lang_id.vote(["a", "b", "c"], "family", model, w(1, 0))[0] == "a"
    assert lang_id.vote(["a", "b", "c"], "family", model, w(-1, 1))[0] == "b"


def plain_features(text, s):
    """Counts of hashed n-grams by plain loops over the characters."""
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    if not letters.strip():
        return None
    chars = letters[0] + "".join(c for a, c in zip(letters, letters[1:]) if c != " " or a != " ")
    bins = [0] * s.dims
    for n in range(1, s.longest + 1):
        for i in range(len(chars) - n + 1):
            h = ord(chars[i])
            for c in chars[i + 1 : i + n]:
                h = (h * 0x01000193 % 2**32) ^ ord(c)
            h = (h + n) * 0x9E3779B1 % 2**32
            bins[(h ^ h >> 15) % s.dims] += 1
    return [math.sqrt(b / sum(bins)) for b in bins]


def test_features_as_brute_force():
    s = lang_id.Settings(dims=256)
    features = lang_id.Features(s)
    rng = random.Random(1)
    for text in ["a", "Ab  c!", "é☃ 12 ß", "İx", "."] + ["".join(rng.choice("abcé ß.1\n") for _ in range(rng.randrange(1, 90))) for _ in range(60)]:
        want, got = plain_features(text, s), features(text)
        assert (want is None) == (got is None) and (want is None or np.allclose(got, want, atol=1e-6))


def plain_svm(rows, y, rounds, c):
    """The same steps without arrays."""
    rows = [[*x, 1.0] for x in rows]
    n = {1: sum(t > 0 for t in y), -1: sum(t < 0 for t in y)}
    weight = [c * 0.5 / n[1 if t > 0 else -1] for t in y]
    step, d = 1 / (1 / c + 4 * c), len(rows[0])
    w = ahead = [0.0] * d
    for k in range(rounds):
        slack = [max(0.0, 1 - t * sum(a * b for a, b in zip(x, ahead))) for x, t in zip(rows, y)]
        new = [ahead[j] - step * (ahead[j] / c - 2 * sum(u * v * t * x[j] for u, v, t, x in zip(weight, slack, y, rows))) for j in range(d)]
        ahead, w = [b + k / (k + 3) * (b - a) for a, b in zip(w, new)], new
    return w


def test_svm_as_brute_force_and_at_the_optimum():
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(40, 6))) + np.repeat([[0, 0, 1, 0, 0, 0], [1, 0, 0, 0, 0, 0]], 20, axis=0)
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    y = np.repeat([1.0, -1.0], 20)
    w = lang_id.fit_svm(x, y)
    assert np.allclose(w, plain_svm(x.tolist(), y.tolist(), 150, 30.0), atol=1e-4)

    def loss(w, c=30.0):
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
        return w @ w / (2 * c) + c * (slack**2 * np.where(y > 0, 0.5 / 20, 0.5 / 20)).sum()

    best = lang_id.fit_svm(x, y, rounds=20_000).astype(float)
    assert all(loss(best) <= loss(best + rng.normal(size=7) * size) + 1e-6 for size in (0.01, 0.1, 1) for _ in range(50))
    assert loss(w.astype(float)) <= 1.05 * loss(best)


def test_predictions_as_brute_force(spark, docs):
    """Families by all duels, then the family's languages by all duels; scores from the weakest duel of each step."""
    model, s = lang_id.train(docs), lang_id.Settings()
    features = lang_id.Features(s)

    def winner(names, kind, x):
        margin = lambda a, b: float(x @ model["pairs"][kind, a, b][:-1] + model["pairs"][kind, a, b][-1]) if (kind, a, b) in model["pairs"] else -margin(b, a)
        rank = lambda a: (sum(margin(a, b) > 0 for b in names if b != a), sum(margin(a, b) for b in names if b != a))
        best = max(sorted(names), key=rank)
        return best, min([1.0, *(1 / (1 + math.exp(-4 * margin(best, b))) for b in names if b != best)])

    rows = {r.doc_id: r.text for r in docs.limit(300).collect()}
    some = spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumn("score", F.lit("x"))
    for r in lang_id.predict(some, model).collect():
        x = features(rows[r.doc_id])
        if x is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        family, sure = winner(sorted(set(model["family"].values())), "family", x)
        lang, surer = winner([n for n in model["langs"] if model["family"][n] == family], "lang", x)
        assert r.lang_pred == lang and abs(r.score - sure * surer) < 1e-4


def test_empty_tables_long_texts_and_clashing_columns(spark, docs):
    model = lang_id.train(docs)
    text = docs.where("lang = 'en' AND n_chars > 500").first().text
    df = spark.createDataFrame([(1, text * (3_000_000 // len(text)), 5, "z")], "doc_id long, text string, score int, x string")
    out = lang_id.predict(df, model, keep_columns=True)
    assert out.columns == ["doc_id", "text", "x", "lang_pred", "score"] and out.first().lang_pred == "en"
    assert lang_id.predict(df.limit(0), model).count() == 0 and lang_id.train(docs.limit(0))["langs"] == []
