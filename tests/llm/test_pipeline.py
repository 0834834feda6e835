from collections import defaultdict
from hashlib import sha256

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")

from statloom.llm import near_dup  # noqa: E402
from statloom.llm.decontaminate import words_of  # noqa: E402
from statloom.llm.queries import tokenizer  # noqa: E402
from tests.llm.test_near_dup import brute_force  # noqa: E402

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def plain(docs, benchmark):
    docs = {d: t for d, t in docs.items() if t and any(c.isalpha() for c in t)}
    holders = defaultdict(set)
    key = lambda x: x.strip(BLANK).translate({c: c + 32 for c in range(65, 91)})
    for d, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(d)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    docs = {d: "\n".join(x for x in t.split("\n") if last.get(key(x), d) == d) for d, t in docs.items()}
    group = brute_force(docs.items(), near_dup.Settings(shingle=5, percent=80))
    docs = {d: t for d, t in docs.items() if group[d] == d}
    wanted = defaultdict(set)
    for t in benchmark:
        w = words_of(t.encode())
        for i in range(max(1, len(w) - 9) if w else 0):
            wanted[len(w[i : i + 10])].add(tuple(w[i : i + 10]))
    clean = {}
    for d, t in docs.items():
        w = words_of(t.encode())
        if not any(tuple(w[i : i + n]) in found for n, found in wanted.items() for i in range(len(w) - n + 1)):
            clean[d] = t
    return clean


def test_as_the_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = plain(docs, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want) and 50 < len(want) < len(docs)
    library = tokenizers.Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    for d, text in want.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[d].ids == ids and got[d].n_tokens == len(ids)
        assert got[d].decoded_sha256 == sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SF).columns == docs.columns


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_defined_cases(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = [(900, None), (901, ""), (902, "123 ... 45"), (903, "the same words of this text again and again here\n" * 4000), (904, "one short text"), (904, "one short text")]
    extra = spark.createDataFrame(odd, "doc_id long, text string")
    docs = base.select("doc_id", "text", "lang").unionByName(extra, allowMissingColumns=True)
    named = docs.selectExpr("doc_id", "text", "lang", "5 AS score", "'x' AS lang_pred", "7 AS `items`", "'k' AS kept", "1 AS key", "2 AS n_words", "3 AS component_id").cache()
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, named, SF)
        assert out.columns == named.columns, name
        rows = out.collect()
        assert all((r.score, r.lang_pred, r["items"], r.kept, r.key, r.n_words, r.component_id) == (5, "x", 7, "k", 1, 2, 3) for r in rows), name
        left = {r.doc_id for r in rows}
        assert ({900, 901, 902} & left == set()) if name == "languages" else {900, 901, 902, 903, 904} <= left, name
        assert [r.doc_id for r in rows].count(904) == 2, name
        assert f(spark, named.limit(0), SF).count() == 0, name
    last = {r.doc_id: r for r in stage("tokens")(spark, named, SF).collect()}
    assert last[900].n_tokens == last[901].n_tokens == 0 and last[903].n_tokens > 20_000
    assert stage("tokens")(spark, named.limit(0), SF).count() == 0
