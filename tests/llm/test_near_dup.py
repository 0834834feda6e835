import random
from itertools import combinations

import pytest

from statloom.llm import near_dup

S = near_dup.Settings(shingle=3, percent=85)


def brute_force(docs, s=S):
    """All pairs on sets of words, and a union-find."""
    sets = {}
    for doc_id, text in docs:
        w = (text or "").encode().lower().split()
        k = s.shingle
        sets.setdefault(doc_id, []).append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= s.percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d: top(d) for d in sets}


def run(spark, docs, s=S):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return near_dup.near_duplicates(df, s).collect()


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i : i + rng.randrange(0, 3)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(0, 2)
    return words


def test_groups_as_brute_force(spark):
    rng = random.Random(5)
    docs, n = [], 0
    for _ in range(12):  # groups whose members are near the first text, not all near each other
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 30)):
            docs.append((n, " ".join(edited(rng, base, rng.randrange(0, 6)))))
            n += 1
    rng.shuffle(docs)
    want = brute_force(docs)
    got = run(spark, docs)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == n


def test_chain_of_texts_that_no_star_holds_together(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 6 : i * 6 + 120])) for i in range(40)]  # each near its neighbours only
    got = {r.doc_id: r.component_id for r in run(spark, docs)}
    assert got == brute_force(docs) and len(set(got.values())) < 10


@pytest.mark.parametrize("block", [2, 512])
def test_many_blocks(spark, block):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join(edited(rng, base, rng.randrange(2, 9)))) for i in range(60)]
    s = near_dup.Settings(shingle=3, percent=85, block=block)
    assert {r.doc_id: r.component_id for r in run(spark, docs, s)} == brute_force(docs)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a"), (7, "b"), (8, "x y z"), (8, "x y z"), (None, "x y z"), (9, "p q r s"), (9, "x y z"), (10, "p q r s")]
    got = run(spark, docs)
    assert len(got) == len(docs)
    by = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got}
    assert by[1, 0] == (1, True) and by[2, 0] == (2, True) and by[4, 1] == (4, True) and by[5, 1] == (4, False) and by[6, 1] == (6, True) and by[7, 1] == (7, True)
    assert by[8, 1] == (8, True) and by[9, 2] == (8, False) and by[10, 2] == (8, False) and by[None, 1] == (None, True)
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "a b c", 6, "y")], "doc_id long, text string, component long, n_shingles string")
    assert sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()) == [(1, 1), (2, 1)]
    docs = docs.withColumnRenamed("component", "gone_id").withColumn("Salt", near_dup.F.lit(1))
    assert near_dup.keep_first(docs).columns == docs.columns and near_dup.keep_first(docs).count() == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(64)]
    parent = {}
    top = lambda x: x if parent.setdefault(x, x) == x else top(parent[x])
    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    spark.conf.get("spark.checkpoint.dir", None) or near_dup.store(spark.range(1), "x")
    got = {r.node: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


def test_bucket_of_texts_that_share_half_and_long_ones(spark):
    """Texts of one form share buckets without being linked; pairs of them that are near are found by blocks."""
    rng = random.Random(3)
    form = [f"f{i}" for i in range(90)]
    docs = []
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(25)]
        docs.append((2 * i, " ".join(form + own)))
        if i % 3 == 0:
            docs.append((2 * i + 1, " ".join(form + edited(rng, own, 1))))
    docs += [(1000 + i, " ".join(f"l{j}" for j in range(i, 300_000))) for i in range(3)]
    s = near_dup.Settings(shingle=3, percent=85, block=8, block_shingles=2000, rows=3, bands=40)
    assert {r.doc_id: r.component_id for r in run(spark, docs, s)} == brute_force(docs, s)


def test_rows_of_a_large_class(spark):
    docs = [(i, "the same words in every copy of this text") for i in range(400)] + [(1000 + i, f"own words of {i} only {i}") for i in range(50)]
    got = {r.doc_id: r.component_id for r in run(spark, docs, near_dup.Settings(shingle=3, percent=85, bands=25, salts=8))}
    assert got == {d: 0 if d < 1000 else d for d, _ in docs}
