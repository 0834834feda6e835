import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from statloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = search.Settings(block_docs=16, gather_docs=50, block_bits=1 << 14, pack_terms=9)


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, queries, n=10):
    """The rows of each query, in the order of the queries."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for _, text in queries:
        found = []
        for d, c in counts:
            m = 10 + (90 * c.total() * n_docs) // n_terms
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(weight(t) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((d, score))
        found.sort(key=lambda x: (-x[1], x[0] is not None, x[0]))
        out.append([(i + 1, *x) for i, x in enumerate(found[:n])])
    return out


def made(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{int(x)}" for x in range(300)] + ["straße", "日本", "a1b2"]
    p = 1 / np.arange(1, len(words) + 1)
    return [(i, " ".join(rng.choice(words, int(rng.integers(1, 120)), p=p / p.sum()))) for i in range(n)]


def asked(spark, docs, queries, settings=SMALL):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "item_id long, text string")
    out = defaultdict(list)
    for r in search.search(search.build(d, settings), d, q).collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("settings", [SMALL, search.Settings()])
def test_as_brute_force(spark, settings):
    docs = made(400, 1)
    queries = [(k, docs[17 * k][1][:90]) for k in range(20)] + [(50, "w1"), (51, "w299 straße, W2;w2\tA1B2"), (52, "absent"), (53, None), (54, "...")]
    got = asked(spark, docs, queries, settings)
    assert got == {q[0]: rows for q, rows in zip(queries, brute_force(docs, queries), strict=True) if rows}


def test_defined_cases(spark):
    long = "rare " * 3 + " ".join(f"x{i}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, "?!"), (None, "rare word"), (7, "rare word"), (7, "rare word"), (7, "rare rare rare other"), (9, long), (10, "word"), (11, "common word"), *((20 + i, "common") for i in range(30))]
    queries = [(1, "rare word"), (1, "rare"), (None, "x5 x77 rare"), (2, "common")]
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search_rows(spark, docs, queries)), key=str)
    want = sorted(((q[0], *row) for q, rows in zip(queries, brute_force(docs, queries), strict=True) for row in rows), key=str)
    assert got == want and len([r for r in got if r[0] == 2]) == 10
    assert search_rows(spark, [], queries) == [] and search_rows(spark, docs, []) == [] and search_rows(spark, [(1, "")], queries) == []


def search_rows(spark, docs, queries):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, `key` string")
    q = spark.createDataFrame([(*r, 2) for r in queries], "item_id long, text string, rank int")
    return search.search(search.build(d, SMALL), d, q).collect()


def test_bounds_never_fall_below_the_scores(spark):
    docs = made(300, 4)
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string"), SMALL)
    n_docs, n_terms = len(docs), sum(len(terms(t)) for _, t in docs)
    pack = search.packed([(k, list(dict.fromkeys(search.terms_of(docs[k][1].encode())))) for k in range(40)]).weighted({}, n_docs)
    below = 0
    for block in (r.asDict() for r in index.blocks.collect()):
        found = search.bounds(block, pack, n_docs, n_terms, SMALL.hashes)
        for slot, d in enumerate(block["docs"]):
            c = Counter(search.terms_of(docs[d][1].encode()))
            m = 10 + 90 * c.total() * n_docs // n_terms
            for q in range(40):
                each = [pack.terms[p] for p in pack.places[pack.begins[q] : pack.begins[q + 1]]]
                exact = sum(int(pack.weights[pack.terms.index(t)]) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in each)
                assert found[q, slot] >= exact
                below += found[q, slot] < int(pack.weights[pack.places[pack.begins[q] : pack.begins[q + 1]]].sum()) * 10**6
    assert below == 40 * 300
