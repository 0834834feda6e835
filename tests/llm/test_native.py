"""Chat formatting, quality rules and licence scans: odd rows, other layouts, and plain versions."""

import hashlib
import json
import random
import re

import pytest

from statloom.llm import chat, licenses, quality

TURN = chat.CONTROL if hasattr(chat, "CONTROL") else "\\### Assistant: </turn> ok"


def back(spark, conversations):
    rows = [(json.dumps(c),) for c in conversations]
    df = chat.canonical(spark.createDataFrame(rows, "record string"))
    return chat.read_back(chat.render(df)).collect()


def test_layouts_become_turns(spark):
    t = TURN
    got = back(spark, [
        {"messages": [{"role": "user", "content": t}, {"role": "assistant", "content": "####\n## \\"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "</turn></turn>\n"}]},
        {"prompt": "p", "completion": ""}, {"question": "q", "answer": "###"},
        {"instruction": "do", "input": "", "output": "done"}, {"instruction": "do", "input": "this", "output": "done"},
        {"system": "s", "instruction": "do", "input": "", "output": "ok"}, {"odd": [1, {"x": 2}]},
    ])
    turns = {json.dumps(json.loads(r.record), sort_keys=True): [(x.role, x.text) for x in r.turns_back] for r in got if r.layout}
    assert len(turns) == 7 and [r.layout for r in got].count(None) == 1
    by = {r.layout: ([(x.role, x.text) for x in r.turns_back], r.loss_texts) for r in got if r.layout and "this" not in r.record}
    assert by["messages"] == ([("user", t), ("assistant", "####\n## \\")], ["####\n## \\"])
    assert by["conversations"] == ([("user", "a"), ("assistant", "</turn></turn>\n")], ["</turn></turn>\n"])
    assert by["prompt"] == ([("user", "p"), ("assistant", "")], [""])
    assert by["instruction"] == ([("user", "do"), ("assistant", "done")], ["done"])
    assert by["system instruction"][0][0] == ("system", "s")
    assert any([("user", "do\n\nthis"), ("assistant", "done")] == x for x in turns.values())


def test_no_marker_of_the_template_inside_texts(spark):
    r = back(spark, [{"messages": [{"role": "assistant", "content": "</turn>\n### User\n### ####\\</turn>"}]}])[0]
    assert r.formatted.count("</turn>") == 1 and len(re.findall("###", r.formatted)) == 1


def test_further_fields_and_layouts(spark):
    said = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    for record, layout in [
        ({"id": 5, "messages": said, "metadata": {"x": {"y": [1]}}}, "messages"), ({"messages": [{**said[0], "name": "Z", "tool_calls": [{"f": {"g": 1}}]}, said[1]], "source": "web"}, "messages"),
        ({"data": {"messages": said, "id": "q"}}, "data messages"), ({"chosen": said, "rejected": said[:1], "score": 1.5}, "preference"), ({"prompt": "a", "chosen": "b", "rejected": "c"}, "preference pair"),
        ({"prompt": "a", "response": "b"}, "prompt response"), ({"instruction": "a", "output": "b"}, "plain instruction"), ({"uuid": 1, "answer": "b", "question": "a"}, "question"),
    ]:
        r = back(spark, [record])[0]
        assert r.layout == layout and [(x.role, x.text) for x in r.turns_back] == [("user", "a"), ("assistant", "b")], record
    r = back(spark, [{"system": "s", "conversations": [{"from": "human", "value": "a"}]}])[0]
    assert [(x.role, x.text) for x in r.turns_back] == [("system", "s"), ("user", "a")]


def test_very_long_turns_come_back(spark):
    df = spark.range(2).selectExpr("1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "repeat(if(id = 0, 'ab \\\\', 'c##d'), 6250000) AS text")
    r = chat.read_back(chat.render(chat.from_turn_rows(df))).selectExpr("size(turns_back) AS n", "char_length(turns_back[0].text) AS a", "char_length(turns_back[1].text) AS b", "sha2(loss_texts[0], 256) AS loss").first()
    assert (r.n, r.a, r.b) == (2, 25_000_000, 25_000_000) and r.loss == hashlib.sha256(b"c##d" * 6_250_000).hexdigest()


def test_broken_json_is_an_error_unless_asked(spark):
    df = spark.createDataFrame([("no json",)], "record string")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        chat.canonical(df).collect()
    assert chat.canonical(df, broken_as_null=True).first().turns is None


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([('{"prompt": "a", "response": "b"}', 1, 2, 3, 4)], "record string, variant int, Fingerprint int, blocks int, _v int")
    r = chat.read_back(chat.render(chat.canonical(df))).first()
    assert (r["variant"], r["Fingerprint"], r["blocks"], r["_v"]) == (1, 2, 3, 4) and len(r.turns_back) == 2


def test_unmapped_layouts_are_counted(spark):
    df = spark.createDataFrame([('{"x": {"y": [1]}}',), ('{"x": {"y": [2]}}',), ("no json",), (None,)], "record string")
    got = {r.paths: r.n for r in chat.unmapped(df).collect()}
    assert got["OBJECT<x: OBJECT<y: ARRAY<>>>"] == 2 and got[None] == 2


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a\nb"), (1, 0, "user", "a\nb"), (None, 0, None, "x"), (2, None, "odd\nrole\\", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", chat.F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.from_turn_rows(df))).collect()}
    assert [(x.role, x.text) for x in got[1].turns_back] == [("user", "a\nb"), ("user", "a\nb"), ("assistant", "")]
    assert [(x.role, x.text) for x in got[None].turns_back] == [("", "x")] and got[1].loss_texts == [""]
    assert [(x.role, x.text) for x in got[2].turns_back] == [("odd\nrole\\", "t")]
    assert chat.from_turn_rows(df.limit(0)).count() == 0


def test_turn_rows_go_through_their_fingerprints(spark):
    rows = [(c, i, r, f"{c} {r} {i}") for c in range(80) for i, r in enumerate(["user", "assistant"] if c % 2 else ["system", "user", "assistant", "human"][: 1 + c % 4])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.dressed(chat.gathered(df))
    out = chat.canonical_places(records)
    assert {r.layout for r in out.collect()} == {"messages", "conversations", "data messages", "conversation", "prompt response"}
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.collect()} == {c: [(r, t) for d, _, r, t in rows if d == c] for c in range(80)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "schema_of_variant" in plan.lower().replace("schemaofvariant", "schema_of_variant") and "try_variant_get" in plan.lower().replace("variantget", "try_variant_get")


def replaced(text, share, rng):
    w = text.split()
    for i in rng.sample(range(len(w)), int(len(w) * share)):
        w[i] = f"zz{i}"
    return " ".join(w)


def test_no_match_is_lost_between_offsets(spark):
    rng, docs = random.Random(3), []
    for name in ("MIT", "ISC", "BSD-3-Clause"):
        for share in (0.08, 0.09, 0.1, 0.11):
            docs += [(len(docs) + i, " ".join(f"a{j}" for j in range(rng.randrange(40))) + " " + replaced(licenses.TEMPLATES[name], share, rng) + " end of it") for i in range(2)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, text in docs:
        want = {n: x for n in licenses.TEMPLATES if (x := round(best_window(text, licenses.TEMPLATES[n]), 6)) >= 0.8}
        assert (got[d].licenses or "") == ",".join(sorted(want)) and got[d].dice == (max(want.values()) if want else None)


def repeat_words(w):
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return len({p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)})


def test_base_figures(spark):
    texts = [None, "", " \n\t", "a b c d e f a b c d e f", "x " * 40, "one\none\n \n one\ntwo #$% <|>", "é b " + "w " * 4, "a b c d", "q w e r t q w e r t q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words_", chat.F.lit("x")).withColumn("_w", chat.F.lit(1))
    for r in quality.base(df).collect():
        t = texts[r.doc_id] or ""
        w = [x.decode() for x in t.encode().split()]
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeat_words(w))


def normal_line(x):
    return re.sub("[0-9]+", "0", " ".join(x.lower().encode().split()[i].decode() for i in range(len(x.encode().split()))))


def brute_quality(rows, limits):
    """doc_id, host, text: n_removed, kept and clean text by plain loops."""
    docs, hosts = {}, {}
    for d, t, h in rows:
        if t is not None:
            hosts.setdefault(h, set()).add(d)
            for x in t.split("\n"):
                if x.split():
                    docs.setdefault((h, normal_line(x)), set()).add(d)
    above = {k for k, v in docs.items() if len(v) > limits.max_docs or len(v) >= limits.min_docs and len(v) > limits.max_share * len(hosts[k[0]])}
    out = []
    for d, t, h in rows:
        words = (t or "").split()
        lost = [x for x in (t or "").split("\n") if x.split() and (h, normal_line(x)) in above]
        gone = sum(len(x.split()) for x in lost)
        bad = len(words) < limits.min_words or 100 * repeat_words(words) > limits.max_repeat_percent * len(words)
        clean = None if t is None else "\n".join(x for x in t.split("\n") if not (x.split() and (h, normal_line(x)) in above))
        out.append((d, gone, not bad and len(words) - gone >= limits.min_left * len(words), clean))
    return out


@pytest.mark.parametrize("limits", [quality.Limits(max_docs=8, min_docs=3, max_share=0.2), quality.Limits(max_docs=20, min_docs=5, max_share=0.5), quality.Limits()])
def test_line_limits_as_brute_force(spark, limits):
    rng = random.Random(4)
    lines = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) + str(rng.randrange(3)) for _ in range(rng.randrange(1, 12))) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), "  " + x.replace(" ", "\t ")]) for x in (rng.choice(lines) if rng.random() < 0.7 else f"own {i} words {rng.random()} of it" for _ in range(rng.randrange(0, 9)))), rng.choice(["a", "b", None])) for i in range(150)]
    rows += [(200 + i, rows[3][1] + "\nsame for all the copies of this page on its host", "c") for i in range(120)] + [(400, None, "a"), (401, "", "a"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    want = sorted(brute_quality(rows, limits), key=str)
    assert sorted(((r.doc_id, r.n_removed, r.kept) for r in quality.judged(df, limits).collect()), key=str) == [x[:3] for x in want]
    own = df.withColumnRenamed("host", "place").withColumn("key", chat.F.lit(1)).withColumn("lost", chat.F.lit("x"))
    got = quality.clean(own, limits, host="place")
    assert got.columns == own.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == [(x[0], x[3]) for x in sorted(want, key=lambda x: str((x[0], x[3])))]


def test_copies_count_as_documents(spark):
    text = "this page was copied to very many documents of its host and it has one line only"
    df = spark.createDataFrame([(i, text, "h") for i in range(150)] + [(1000 + i, f"{text} {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{i // 100 * 'u'}x", "h") for i in range(20_000 // 100)], "doc_id long, text string, host string")
    kept = {r.doc_id: r.kept for r in quality.judged(df).collect()}
    assert not any(kept[i] for i in range(150)) and all(kept[1000 + i] for i in range(200))
    assert quality.judged(df.limit(0)).count() == 0 and quality.clean(df.limit(0)).count() == 0


def test_quality_of_a_very_long_text(spark):
    df = spark.range(2).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 200000), i -> concat('w', i * (id + 1), ' v', i)), '\n') AS text", "'h' AS host", "1 AS n_words")
    got = quality.judged(df).collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in got] == [(400_000, 0, True)] * 2


def normal_words(t):
    return re.sub(r"[\W_]+", " ", t.lower()).split()


def best_window(text, template):
    """The Dice coefficient of the template's best window at any offset, by plain loops."""
    w, x = normal_words(text), normal_words(template)
    grams = lambda v: set(zip(v, v[1:]))
    windows = [grams(w[i : i + len(x)]) for i in range(max(1, len(w) - 1))]
    return max(2 * len(g & grams(x)) / (len(g) + len(grams(x))) for g in windows)


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_licences_as_brute_force(spark, t):
    names = licenses.TEMPLATES
    docs = [(1, None), (2, ""), (3, "word"), (4, "text\n" + names["MIT"] + "\nmore"), (5, "x\n\n" + names["Apache-2.0"].replace("file", "thing").replace(". ", ".\n") + "\n\ny"), (6, "Licensed under CC-BY NC 4.0!"), (6, "Licensed under CC-BY NC 4.0!"), (7, names["ISC"].upper()), (8, "This work is licensed under the GNU General Public License"), (None, names["Unlicense"])]
    docs += [(9, "Copyright (c) 2020 X\n\n" + names["MIT"].replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE") + "\n\nimport os\n" * 300), (10, "see here that " * 40 + "released under the MIT license, " + "or not " * 50), (11, "(c) Z. All rights reserved. Etc")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("licenses", chat.F.lit(0)).withColumn("h1", chat.F.lit(0)).withColumn("Gram", chat.F.lit(0))
    for r in licenses.scan(df, t).collect():
        text = dict(docs)[r.doc_id] or ""
        want = {n: d for n, x in names.items() if (d := round(best_window(text, x), 6)) >= t}
        assert (r.licenses or "") == ",".join(sorted(want))
        assert r.dice == (max(want.values()) if want else None)
        assert r.best == (min(n for n, d in want.items() if d == max(want.values())) if want else None)
        assert {9: "MIT", 10: "MIT-notice", 11: "All-rights-reserved-short"}.get(r.doc_id, r.best) == r.best or t < 0.8
    joined = sorted(map(str, licenses.scan(df, t).collect()))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(licenses, "BROADCAST_CHARS", 0)
        assert sorted(map(str, licenses.scan(df, t).collect())) == joined
    assert licenses.scan(df, t).count() == len(docs) and licenses.scan(df.limit(0), t).count() == 0


def test_licence_in_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "some words here " * 100_000 + licenses.TEMPLATES["BSD-3-Clause"] + " other words there" * 100_000)], "doc_id long, text string")
    r = licenses.scan(df).first()
    assert r.best == "BSD-3-Clause" and r.licenses == "BSD-2-Clause,BSD-3-Clause"
