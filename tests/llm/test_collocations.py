import re
from collections import Counter

import numpy as np
import pytest

from statloom.llm import collocations
from statloom.llm.collocations import Settings


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute_force(docs, s):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            total[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, s.max_words + 1) for i in range(len(words) - k + 1))
    out = []
    often = {p for p, n in f.items() if n >= s.least and len(p) > 2}
    for p in often:
        lang, words, a = p[0], p[1:], f[p]
        _, k = min((10**6 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words)))
        l, r = f[(lang, *words[:k])], f[(lang, *words[k:])]
        around = [f[q] for q in often if q[0] == lang and len(q) > len(p) and any(q[1 + i : 1 + i + len(words)] == words for i in range(len(q) - len(words)))]
        if not any(100 * n >= s.contained * a for n in around):
            out.append((lang, " ".join(words), a, l, r, total[lang], 10**6 * a * a // (l * r)))
    rows = []
    for lang in sorted({x[0] for x in out}):
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[: s.top]
        rows += [(lang, i + 1, *x[1:]) for i, x in enumerate(best)]
    return rows


def made(n, seed):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(60)] + ["New", "York", "straße", "\x1cx"])
    p = 1 / np.arange(1, len(words) + 1)
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words, int(rng.integers(0, 40)), p=p / p.sum()))
        text += [". In New  York\tCity we trust, ", "\nall of this is said again and again; ", "!?"][int(rng.integers(0, 3))] + str(i)
        out.append((["en", "de", None][i % 3], text))
    return out


def rows_of(spark, docs, s):
    d = spark.createDataFrame([(*r, 1) for r in docs], "lang string, text string, n int").repartition(3)
    return sorted(tuple(r)[:8] for r in collocations.collocations(d, s).collect())


@pytest.mark.parametrize("s", [Settings(), Settings(least=3, top=50), Settings(max_words=4, least=4), Settings(max_words=2, least=5), Settings(least=5, filter_bits=7, hold=50)])
def test_as_brute_force(spark, s):
    docs = made(240, 3)
    want = brute_force(docs, s)
    assert rows_of(spark, docs, s) == sorted(want) and len(want) > 20


def test_defined_cases(spark):
    long = "deep sea fish " * 30_000
    docs = [("en", None), ("en", ""), (None, "ha ha ha ha ha ha ha ha ha ha ha ha"), ("und", "ha ha"), ("fr", long), ("fr", "x" * 100_000), *[("de", "Guten Tag. Guten Tag")] * 6]
    assert rows_of(spark, docs, Settings()) == sorted(brute_force(docs, Settings()))
    assert rows_of(spark, [], Settings()) == [] and rows_of(spark, [("en", "few words")], Settings()) == []


def test_paths_are_compacted(spark):
    docs = [("en", f"{'abc'[i % 3]}{i} one two three four five six seven {i}") for i in range(12)] + [("en", "five six")]
    d = spark.createDataFrame(docs, "lang string, text string")
    s = Settings()
    words = collocations.vocabulary(d, s)
    spelled = {r.code: r.word for r in words.collect()}
    found = collocations.paths(collocations.phrases(d, words, s), s).collect()
    got = {(" ".join(spelled[r[w]] for w in ("w1", "w2", "w3")), " ".join(spelled[c] for c in r.path), r.place, r.path_words) for r in found}
    first = "one two three"  # five six occurs alone too, so that its node is not inside
    assert got == {(first, first, 0, 6), ("two three four", first, 1, 6), ("three four five", first, 2, 6), ("four five six", first, 3, 6), ("five six seven", "five six seven", 0, 3)}
