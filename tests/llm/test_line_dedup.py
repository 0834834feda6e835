import hashlib
import random
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest

from statloom.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"
FOLD = {c: c + 32 for c in range(65, 91)}


def brute_force(docs, min_docs=5, min_chars=40):
    key = lambda x: x.strip(BLANK).translate(FOLD)
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(d)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), d) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    common = [f"Line {i} " + "é" * rng.randrange(20, 50) + "x" * rng.randrange(0, 12) for i in range(25)]
    spoilt = lambda x: rng.choice([x, f"  {x}\t", x.upper().replace("É", "é"), x.lower()])
    return [(i, "\n".join(spoilt(rng.choice(common)) if rng.random() < 0.6 else f"own line {i} {rng.random()} of this document only" for _ in range(rng.randrange(0, 12)))) for i in range(n)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


def result(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()}


@pytest.mark.parametrize("keys", [4, 1 << 16])
def test_as_brute_force(spark, keys):
    docs = corpus(1) + [(100, None), (101, "")]
    df = frame(spark, docs)
    assert result(line_dedup.dedup(df, line_dedup.build(df, keys_per_shard=keys))) == brute_force(docs)


def test_places_of_one_shard_split_a_common_line(spark, monkeypatch):
    """A shard's keys are dealt to many places, and the filter stands at each of them."""
    docs = corpus(7, 80)
    df = frame(spark, docs)
    index = line_dedup.build(df)
    index = replace(index, filters=line_dedup.with_places(index.filters, index.counts, index.n_shards, keys_per_place=20))
    assert index.filters.first().n_places > 5 and index.n_shards == 1
    assert result(line_dedup.dedup(df, index)) == brute_force(docs)


def test_hits_are_the_frequent_lines_and_few_others(spark):
    docs = corpus(5, 80)
    df = frame(spark, docs)
    index = line_dedup.build(df)
    found = {(r.k1, r.k2) for r in line_dedup.hits(df, index).collect()}
    often = {(r.k1, r.k2) for r in index.often.collect()}
    assert often <= found and len(found) < index.counts.count() / 2


def test_insertions_and_deletions_leave_the_index_as_built_anew(spark):
    docs = corpus(2, 80)
    a, b = frame(spark, docs[:50]), frame(spark, docs[50:])
    index = line_dedup.insert(line_dedup.build(a, keys_per_shard=4), b)
    both = frame(spark, docs)
    assert result(line_dedup.dedup(both, index)) == brute_force(docs)
    index = line_dedup.delete(index, b)
    assert result(line_dedup.dedup(a, index)) == brute_force(docs[:50])
    fresh = line_dedup.build(a)
    assert sorted(map(tuple, index.counts.collect())) == sorted(map(tuple, fresh.counts.collect()))
    index = line_dedup.delete(index, a)
    assert index.counts.count() == 0
    assert all(not np.frombuffer(bytes(r.slots), np.uint16).any() for r in index.filters.collect())


def test_cuckoo_tables():
    rng = np.random.default_rng(3)
    k = rng.integers(-(2**63), 2**63 - 1, (20_000, 2))
    n = line_dedup.buckets_for(len(k))
    tables = line_dedup.cuckoo_grow([], k, n)

    hold = lambda keys: line_dedup.may_hold(keys, n, line_dedup.pack(tables))
    assert hold(k).all()
    other = rng.integers(-(2**63), 2**63 - 1, (20_000, 2))
    assert hold(other).mean() < 0.005
    line_dedup.cuckoo_delete(tables, k[:15_000])
    assert hold(k[15_000:]).all() and hold(k[:15_000]).mean() < 0.005


def test_an_index_grown_from_nothing_is_as_a_fresh_one(spark):
    docs = [(i, "\n".join(f"a line of more than forty signs with the number {j}" for j in range(3000))) for i in range(5)]
    df = frame(spark, docs)
    empty = line_dedup.build(df.limit(0), keys_per_shard=500)
    index, fresh = line_dedup.insert(empty, df), line_dedup.build(df, keys_per_shard=500)
    assert index.n_shards == fresh.n_shards == 6
    sizes = lambda x: sorted((r.shard, r.n_buckets, len(r.slots)) for r in x.filters.collect())
    assert sizes(index) == sizes(fresh)
    some = line_dedup.insert(line_dedup.build(frame(spark, [(9, "x")])), df)  # one shard that outgrows its table
    assert sizes(some) == sizes(line_dedup.build(df))


def test_odd_rows_and_columns(spark):
    line = "a line of at least forty characters, which repeats"
    rows = [(i, line + "\nx", i, "s") for i in range(6)] + [(5, line + "\nx", 5, "s"), (None, line, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, gone string")
    out = line_dedup.dedup(df, line_dedup.build(df), keep_columns=True)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got.count((5, line + "\nx", len(line) + 2)) == 2 and got.count((0, "x", 1)) == 1 and (None, line, len(line)) in got
    empty = df.limit(0)
    assert line_dedup.dedup(empty, line_dedup.build(empty)).count() == 0


def test_query_columns(spark):
    from statloom.llm import queries

    r = queries.op1_line_dedup(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    assert set(r.asDict()) == {"doc_id", "n_lines", "n_dropped", "kept_sha256"} and len(r.kept_sha256) == len(hashlib.sha256().hexdigest())


def test_the_query_stores_an_index_that_takes_insertions(spark, monkeypatch):
    built, build = [], line_dedup.build
    monkeypatch.setattr(line_dedup, "build", lambda *a, **k: built.append(build(*a, **k)) or built[-1])
    from statloom.llm import queries

    queries.op1_line_dedup(spark, "/root/testdata/sf0.001")
    assert built[0].counts.where("n_docs < 5").count() > 0


def test_a_line_below_the_limit_counts_on(spark):
    docs = [(i, "a line of more than forty signs that only four documents have") for i in range(5)]
    a, b = frame(spark, docs[:4]), frame(spark, docs[4:])
    assert result(line_dedup.dedup(frame(spark, docs), line_dedup.insert(line_dedup.build(a), b))) == brute_force(docs)


def test_very_long_texts_and_lines(spark):
    docs = [(i, "long line " * 300_000 + "\n" + "\n".join(f"{'short line of forty signs and some more'} {j}" for j in range(50_000))) for i in range(5)]
    got = line_dedup.dedup(frame(spark, docs), line_dedup.build(frame(spark, docs))).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in got) == [(i, 50_001, 50_001 if i < 4 else 0) for i in range(5)]
