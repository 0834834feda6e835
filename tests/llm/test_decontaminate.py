import random

import pytest

from statloom.llm import decontaminate as dc


def brute_force(docs, items, width, slop=None):
    out = []
    for d, t in docs:
        w = dc.words_of((t or "").encode())
        hit, exact, near = set(), set(), set()
        for item, text in items:
            x = dc.words_of((text or "").encode())
            for i in range(max(1, len(x) - width + 1) if x else 0):
                win = x[i : i + width]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        exact.add(str(item))
                if slop is not None and any(set(win) <= set(w[p : p + len(win) + slop]) for p in range(len(w))):
                    near.add(str(item))
        out.append((d, len(w), len(hit), tuple(sorted(exact)), tuple(sorted(near))))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "Ünï", "x1", "rare", "word", "deep", "blue", "sea"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 4, 5, 9, 14])))) for i in range(25)]
    docs = []
    for d in range(40):
        parts = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = rng.choice(items)[1].upper().split()
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(parts)))
    return docs, items


def run(spark, docs, items, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.near)) for r in dc.report(df, bench, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{"width": 5}, {"width": 5, "segment_words": 100}])
def test_phrases_as_brute_force(spark, options):
    docs, items = corpus(4)
    assert run(spark, docs, items, **options) == brute_force(docs, items, 5)


def test_proximity_as_brute_force(spark):
    docs, items = corpus(9)
    assert run(spark, docs, items, width=4, slop=2) == brute_force(docs, items, 4, 2)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "one two three"), (4, "one two three"), (None, "two three"), (5, "ONE-TWO!three four")]
    items = [(7, "one two three"), (7, "two three"), (8, None), (9, "?"), (None, "four")]
    got = run(spark, docs, items, width=10)
    assert got == sorted([(1, 0, 0, (), ()), (2, 0, 0, (), ()), (3, 0, 0, (), ()), (4, 3, 3, ("7",), ()), (4, 3, 3, ("7",), ()), (None, 2, 2, ("7",), ()), (5, 4, 4, ("7",), ())], key=str)
    assert all(r[2] == 0 for r in run(spark, docs, [], width=10))
    empty = spark.createDataFrame([], "doc_id long, text string, items string")
    assert dc.report(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, "four", "a"), (2, "five", "b")], "doc_id long, text string, contaminated string")
    left = dc.decontaminate(rows, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == rows.columns and [r.doc_id for r in left.collect()] == [2]


def test_proximity_does_not_span_documents(spark):
    docs, items = [(1, "alpha beta"), (2, "gamma delta")], [(5, "beta gamma")]
    assert all(r[4] == () for r in run(spark, docs, items, width=4, slop=60))
    with pytest.raises(ValueError):
        run(spark, docs, items, width=4, slop=80)


def test_many_items_share_a_window_and_a_very_long_text(spark):
    items = [(i, "one two three four five six") for i in range(300)]
    text = "zero " * 400_000 + "one two three four five six " + "zero " * 400_000
    got = run(spark, [(1, text), (2, "one two three four five")], items, width=5, segment_words=1000)
    assert got == [(1, 800_006, 6, tuple(sorted(str(i) for i in range(300))), ()), (2, 5, 5, tuple(sorted(str(i) for i in range(300))), ())]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "four", "a", 1, 2), (2, "five", "b", 1, 2)], "doc_id long, text string, segment string, bad_id int, Phrase int")
    bench = spark.createDataFrame([(1, "four", "x")], "item_id long, text string, term string")
    left = dc.decontaminate(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "five", "b", 1, 2)]
