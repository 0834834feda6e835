"""Known cases of national forms, tables, compaction, suites and stored results, written down by hand."""

import json

import pytest
from pyspark.sql import functions as F

from statloom.functions.numbers import amount_after_code, preferred_scanned_amount
from statloom.operators import audit, calibration, forms, text
from statloom.sources import stored


def docs_of(spark, *texts, tables=False):
    return spark.createDataFrame([(str(i), t, tables, i) for i, t in enumerate(texts)], "doc string, text string, has_tables boolean, value int")


def found(df):
    return {(r.doc, r.metric_key): r.value for r in df.collect()}


def test_scanned_amounts(spark):
    cases = {
        "1348 503 1339 235": 1348503.0, "3211 - - - - - 1339 235 1339 235": 1339235.0, "123 456 789 111 222 333": 123456789.0, "1 234 567 (8 900)": 1234567.0, "(12 345)": -12345.0,
        "1448 897 216 2601771": 1448897.0, "2023 2022": 20232022.0, "2023": None, "17": 17.0, "0710001": 710001.0, "": None, None: None, "-5 000 4 000": -5000.0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", preferred_scanned_amount("t").alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases
    behind = spark.createDataFrame([(" 103 015 103 015",), (" 17",), (" 2023 12",), (" 5 435 659 511",)], "t string").select(amount_after_code("t").alias("v"))
    assert [r.v for r in behind.collect()] == [103015.0, None, 202312.0, 5435.0]


def test_codes_on_lines(spark):
    docs = docs_of(
        spark, "Бухгалтерский баланс 1600 435 659 511 307 785 500\nИтого по разделу П 1200 174 989 150 141 877 788\nВыручка (стр. 2110) 103 015 103 015",
        "12.1.5. Дебиторская задолженность (стр. 1230)\nДебиторская задолженность в таблице 7.1", "код 1400 33 723 849 43 960 253\nпрочее 1500 77 777\n1210 55 555", None, "",
    )
    assert found(forms.code_candidates(docs)) == {("0", "total_assets"): 435659511.0, ("0", "current_assets"): 174989150.0, ("0", "revenue"): 103015.0, ("2", "long_term_liabilities"): 33723849.0, ("2", "inventory"): 55555.0}
    assert forms.code_candidates(docs.limit(0)).count() == 0


def test_values_on_following_lines(spark):
    page = "Отчет о финансовых результатах\nВыручка\n\n12\n(5) \n1 234 567 1 100 000\nЗапасы\nпрочее 99 999\n555 000\nДебиторская задолженность 70 000\nДебиторская задолженность 60 000"
    got = found(forms.multiline_candidates(docs_of(spark, page, "Выручка\n1 234 567", None)))
    assert got == {("0", "revenue"): 1234567.0, ("0", "inventory"): 555000.0, ("0", "accounts_receivable"): 60000.0}
    profit = "Форма 0710002\nЧистая прибыль\n" + "прочее\n" * 22 + "1 348 503\n"
    assert found(forms.multiline_candidates(docs_of(spark, profit, profit.replace("прочее\n", "прочее\nпрочее\n", 1), profit.replace("прочее", "Совокупный финансовый результат периода", 1)))) == {("0", "net_profit"): 1348503.0}
    with_cash = "Форма 0710001\nДенежные средства 55 000"
    assert found(forms.multiline_candidates(docs_of(spark, with_cash))) == {} and found(forms.multiline_candidates(docs_of(spark, with_cash, tables=True))) == {("0", "cash_and_equivalents"): 55000.0}


def test_section_totals(spark):
    docs = docs_of(
        spark, "Бухгалтерский баланс\nИтого по разделу Ш 209 475 516 208 127 013\n5\nИтого по разделу V 192 460 146 153 956 227", "Итого по разделу IV 226 183 995 197 916 480\nкод 1400 33 723 849 43 960 253",
        "12 000\nруководитель 90 000\n15 000\nИтого по разделу V\n14 000", "Итого по разделу IV 50 005 49 000\nИтого по разделу V 50 000",
    )
    assert found(forms.section_candidates(docs)) == {
        ("0", "equity"): 209475516.0, ("0", "short_term_liabilities"): 192460146.0, ("1", "long_term_liabilities"): 33723849.0, ("2", "short_term_liabilities"): 15000.0,
        ("3", "long_term_liabilities"): 50005.0, ("3", "short_term_liabilities"): 50000.0,
    }
    earlier = spark.createDataFrame([("0", "equity", 1.0), ("1", "short_term_liabilities", 33723849.0)], "doc string, metric_key string, value double")
    got = found(forms.section_candidates(docs, earlier))
    assert ("0", "equity") not in got and got["1", "long_term_liabilities"] == 226183995.0


def test_results_section(spark):
    pages = [
        "Отчет о финансовых результатах\nВыручка 10 000 9 000\nЧистая прибыль\nв том числе\n1 348 503\nБухгалтерский баланс\nВыручка 77 000", "Отчет о финансовых результатах\nЧистая прибыль\nСовокупный финансовый результат периода 44 000\n55 000",
        "Отчет о финансовых результатах\nСовокупный финансовый результат периода 44 000", "Выручка 10 000",
    ]
    got = {(r.doc, r.metric_key): (r.value, r.quality) for r in forms.result_section_candidates(docs_of(spark, *pages)).collect()}
    assert got == {("0", "revenue"): (10000.0, 108), ("0", "net_profit"): (1348503.0, 106), ("1", "net_profit"): (44000.0, 112)}


def rows_of(spark, *rows):
    return spark.createDataFrame([("t", 0, i, list(r)) for i, r in enumerate(rows)], "doc string, table_no int, row_no int, cells array<string>")


def test_labels(spark):
    rows = rows_of(spark, ("Non-current assets", "", "12,345"), ("Current assets", "", "9,999"), ("Total current assets", "5", "8,888"), ("Total assets", "21,233"), ("Revenue", "3", "999"), ("Revenue", "3", "1,000"), (None, None, None), ())
    assert [(r.row_no, r.metric_key, r.value, r.quality) for r in forms.by_english_label(rows).orderBy("row_no").collect()] == [(0, "total_assets", 12345.0, 50), (2, "current_assets", 8888.0, 90), (5, "revenue", 1000.0, 50)]
    national = rows_of(spark, ("Гудвил", "11", "67 029 310"), ("Долгосрочная дебиторская задолженность", "14", "353 774"), ("Итого активы", "", "1 395 998 440", "1 209 760 255"), ("Торговая и прочая дебиторская задолженность", "", "5 000"))
    assert [(r.row_no, r.metric_key, r.value, r.quality) for r in forms.by_national_label(national).orderBy("row_no").collect()] == [(2, "total_assets", 1395998440.0, 50), (3, "accounts_receivable", 5000.0, 88)]
    assert [tuple(r)[2:] for r in forms.by_approximate_label(rows_of(spark, ("Gross profit", "", "7,000"), ("Gross profit", "", "70"))).collect()] == [("ebitda", 7000.0, 75, "gross_profit_to_ebitda_approximation")]


def test_labelled_values_of_any_quality(spark):
    """A label that must not give its metric as a candidate still names the row's value; the first label decides."""
    rows = rows_of(spark, ("Short-term liabilities", "", "-4,000"), ("Cash and short-term liabilities", "", "5,000"), ("Other", "", "6,000"), ("Short-term liabilities", "", "999"), (None, None, None), ())
    labels = {"short-term liabilities": "short_term_liabilities", "cash": "cash_and_equivalents"}
    assert [(r.row_no, r.metric_key, r.value) for r in forms.labelled_values(rows, labels).orderBy("row_no").collect()] == [(0, "short_term_liabilities", -4000.0), (1, "short_term_liabilities", 5000.0)]
    assert forms.by_label(rows, labels).count() == 0


def test_heading_totals(spark):
    rows = [("Non-current assets", ""), ("Buildings", "7,000"), ("", "90,000"), ("Current assets", ""), ("Stocks", "2,000"), ("Cash", "3,000"), ("", "5,000"), ("Total assets", "95,000"), ("", "1,000"), ("Current liabilities", ""), ("-", "4,000"), ("Total", "6,000"), ("Total liabilities", "8,000")]
    got = {r.metric_key: r.value for r in forms.heading_totals(rows_of(spark, *rows)).collect()}
    assert got == {"current_assets": 5000.0, "short_term_liabilities": 6000.0}
    assert forms.heading_totals(rows_of(spark, *rows).limit(0)).count() == 0


def test_heading_totals_shuffle_marks_only(spark):
    """Cells stay where they are; marks of the whole table, also far from a total, still count."""
    table = lambda no, *rows: [("t", no, i, list(r)) for i, r in enumerate(rows)]
    filler = [("Stocks", "2,000")] * 20
    plain = table(0, ("Current assets", ""), *filler[:3], ("", "5,000"))
    restated = table(1, ("как пересчитано",), *filler, ("Current assets", ""), ("", "6,000"))
    whole = table(2, ("Current assets", ""), *filler[:9], ("", "7,000"), *filler, ("Total assets", "9,000"), ("Equity and liabilities", ""))
    empty = table(3, ("Current assets", ""), ("", "no amount"), ("Total", ""))
    rows = lambda *tables: forms.heading_totals(spark.createDataFrame(sum(tables, []), "doc string, table_no int, row_no int, cells array<string>"))
    value = lambda *tables: [r.value for r in rows(*tables).collect()]
    assert value(plain, restated) == [5000.0] and value(plain, restated, whole) == [7000.0] and value(restated) == [6000.0] and value(empty) == []
    query = rows(plain)._jdf.queryExecution()
    text_ = query.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    shuffles = [block for block in text_.split("\n\n") if ") Exchange" in block.split("\n")[0]]
    assert shuffles and not any("cells#" in block or "low#" in block for block in shuffles)


def test_results_sanity(spark):
    side = "struct<value: double, match_type: string, is_exact: boolean, quality: int>"
    t = lambda v, match="text", exact=True, q=60: (v, match, exact, q)
    rows = [
        (0, t(100.0), t(50.0), None, None, False), (1, t(100.0), t(90.0), 200.0, 20.0, False), (2, t(100.0), t(90.0), 400.0, None, False), (3, t(100.0), t(90.0), None, None, False), (4, t(100.0), t(90.0, q=90), None, None, False),
        (5, t(100.0, "table"), t(90.0), None, None, False), (6, t(100.0), t(90.0), None, None, True), (7, t(100.0), None, None, 5.0, False), (8, t(100.0), t(-90.0), None, 80.0, False),
    ]
    df = spark.createDataFrame(rows, f"id int, revenue {side}, net_profit {side}, revenue_code double, profit_code double, standalone boolean")
    got = {r.id: (r.revenue and r.revenue.value, r.net_profit and r.net_profit.value, [e.reason for e in r.events]) for r in forms.results_sanity(df).collect()}
    code = "sanity_pnl_replaced_{}_with_code".format
    assert got == {
        0: (100.0, 50.0, []), 1: (200.0, 20.0, [code("revenue"), code("net_profit")]), 2: (400.0, 90.0, [code("revenue")]), 3: (100.0, None, ["sanity_pnl_conflict_drop_net_profit"]),
        4: (None, 90.0, ["sanity_pnl_conflict_drop_revenue"]), 5: (100.0, 90.0, []), 6: (100.0, 90.0, []), 7: (100.0, None, []), 8: (None, 80.0, [code("net_profit"), "sanity_pnl_conflict_drop_revenue"]),
    }


def plain_chunks(text_, size, overlap):
    """Chunks by a plain loop."""
    if len(text_) <= size:
        return [text_] if text_ else []
    out, parts, n = [], [], 0
    for p in text_.split("\n\n"):
        if len(p) > size:
            if parts:
                out.append("\n\n".join(parts))
            parts, n, start = [], 0, 0
            while True:
                out.append(p[start : start + size])
                if start + size >= len(p):
                    break
                start += size - overlap
            continue
        if parts and n + len(p) + 2 > size:
            out.append("\n\n".join(parts))
            tail = out[-1][-overlap:]
            parts, n = ([tail], len(tail)) if tail else ([], 0)
        parts.append(p)
        n += len(p) + 2
    return out + (["\n\n".join(parts)] if parts else [])


@pytest.mark.parametrize("size,overlap", [(30, 7), (50, 49), (12_000, 200)])
def test_chunks(spark, size, overlap):
    texts = ["", None, "short", "a" * 100, "\n\n".join(f"paragraph {i} " * (i % 4) for i in range(40)), "x\n\n" * 30, "b" * 61 + "\n\nc\n\n" + "d" * 29, "para " * 6000 + "\n\n" + "tail"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, text string")
    got = {}
    for r in text.chunks(docs, size, overlap, None).orderBy("doc", "chunk_no").collect():
        got.setdefault(r.doc, []).append(r.chunk)
    assert got == {str(i): c for i, t in enumerate(texts) if (c := plain_chunks(t or "", size, overlap))}
    assert text.chunks(docs, size, overlap, 5).groupBy("doc").count().agg(F.max("count")).first()[0] <= 5


def test_compaction_keeps_neighbours(spark):
    page = "intro words\n12 345\nTotal assets\n999 000\nsome words\n77 тыс\nNet income 500 000\nNET   income 500 000\n" + "long prose without numbers " * 10
    df = text.extraction_compacted(spark.createDataFrame([("a", page), ("b", ""), ("c", None), ("d", "nothing here")], "doc string, text string"), 10_000)
    assert [(r.doc, r.compact.split("\n")) for r in df.collect()] == [("a", ["12 345", "Total assets", "999 000", "77 тыс", "Net income 500 000"])]


def test_suites(spark):
    case = {"case_id": "a", "kind": "candidate_threshold", "decision_surface": "threshold_boundary", "metric_key": "revenue", "candidate": {"value": 5.0, "match_type": "table", "is_exact": True, "candidate_quality": 120}, "expected": {"survives": True, "expected_source": "table"}}
    good = {"version": 2, "suite_id": "s", "suite_tier": "fast", "cases": [case]}
    bad = {"version": 3, "suite_id": "z", "suite_tier": "slow", "threshold": 0.6, "cases": [{**case, "kind": "merge"}, {"case_id": "p", "kind": "parse", "decision_surface": None, "risk_tags": ["x"], "pipeline_mode": "y", "suite_id": "q"}]}
    read = calibration.read_suites(spark.createDataFrame([("1", json.dumps(good)), ("2", json.dumps(bad)), ("3", "[1]"), ("4", None)], "file string, text string"))
    got = {(r.file, r.case_id, r.violation) for r in calibration.violations(read).collect()}
    both = {(f, None, v) for f in "12" for v in ("versions_differ", "thresholds_differ")}
    assert got == both | {("2", None, "suite_tier"), ("3", None, "no_object"), ("4", None, "no_object"), ("2", "a", "no_fallback"), ("1", "a", "case_id_repeated")} | {("2", "p", v) for v in ("decision_surface", "risk_tags", "pipeline_mode", "suite_id", "no_expectation")}
    one = calibration.threshold_outcomes(calibration.cases(read)).collect()
    assert [(r.case_id, r.correct, r.outcome, r.confidence) for r in one] == [("a", True, "survive:table", 0.97)]


def test_upsert_is_idempotent_and_export_ordered(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v int, x string")
    read = lambda: sorted((r.k, r.v, r.x) for r in spark.read.parquet(path).collect())
    stored.upsert(spark, rows((1, 1, "a"), (2, 1, "b"), (2, 2, "c"), (None, 1, "n")).where("k is not null"), path, "k", "v")
    for _ in range(2):
        stored.upsert(spark, rows((2, 3, "d"), (3, 1, "e"), (1, 0, "old")), path, "k", "v")
        assert read() == [(1, 1, "a"), (2, 3, "d"), (3, 1, "e")]
    stored.upsert(spark, rows().limit(0), path, "k", "v")
    assert read() == [(1, 1, "a"), (2, 3, "d"), (3, 1, "e")]
    out = f"{tmp_path}/x"
    data = spark.range(1000).selectExpr("cast(id % 3 as int) AS section_no", "(id * 37) % 1000 AS k", "'b' AS body").repartition(5)
    stored.export(data, out, ["k"], 4)
    back = stored.read_export(spark, out, "section_no int, k long, body string").orderBy("place").collect()
    assert [(r.section_no, r.k) for r in back] == sorted((i % 3, i * 37 % 1000) for i in range(1000)) and [r.place for r in back] == list(range(1000))


def test_contexts_and_traces(spark):
    df = spark.createDataFrame([({"a": 1234567.0, "b": None, "c": 0.05, "d": 99.994}, {}, ["1", "2", "3", "4"], [])], "m map<string,double>, r map<string,double>, risks array<string>, f array<string>")
    assert json.loads(df.select(audit.context_record(F.col("m"), F.col("r"), F.col("risks"), F.col("f")).alias("x")).first().x) == {"metrics": {"a": "1,234,567", "c": "0.05", "d": "99.99"}, "ratios": {}, "risks": ["1", "2", "3"], "key_factors": []}
    meta = spark.createDataFrame([("x", "a", "llm"), ("x", "b", "table"), ("y", "a", "table"), ("z", "a", "llm")], "doc string, metric_key string, source string")
    merges = spark.createDataFrame([("z", ["a"], ["b", "c"])], "doc string, contributed array<string>, rejected array<string>")
    over = spark.createDataFrame([("z", "a"), ("z", "a")], "doc string, metric_key string")
    got = {r.doc: (r.is_complete, r.missing, r.summary) for r in audit.completeness(meta, merges, over, "doc").collect()}
    none = "No cross-cutting pipeline overrides applied"
    assert got == {"x": (False, "llm_merge_trace", none), "y": (True, "", none), "z": (True, "", "LLM: 1 contributed, 2 rejected; Issuer overrides: 1 metrics")}


def test_suites_in_parts(spark):
    """A suite in two parts is the same suite: its own violations come once, its cases all, and no case carries its suite."""
    cases = [{"case_id": str(i), "kind": "candidate_threshold", "candidate": {"value": 5.0, "match_type": "table"}} for i in range(4)]
    whole = {"version": 2, "suite_id": "s", "suite_tier": "slow", "cases": cases}
    halves = [("1", json.dumps({**whole, "cases": c})) for c in (cases[:2], cases[2:])]
    read = lambda *texts: calibration.read_suites(spark.createDataFrame(list(texts), "file string, text string"))
    rows = lambda df: sorted(map(str, df.collect()))
    one, two = read(("1", json.dumps(whole))), read(*halves)
    assert rows(calibration.violations(one)) == rows(calibration.violations(two)) and calibration.cases(two).count() == 4
    plan = calibration.cases(one)._jdf.queryExecution().optimizedPlan()
    generate = next(line for line in plan.toString().split("\n") if "Generate" in line)
    assert "suite#" not in generate


def test_upsert_writes_rows_once(spark, tmp_path):
    """No second copy beside the table, long payloads alike take little room, and rows are dealt by key once."""
    path = f"{tmp_path}/t"
    rows = lambda v, n: spark.range(n).selectExpr("id AS k", f"{v} AS v", "repeat('x', 5000) || id AS x")
    stored.upsert(spark, rows(1, 300), path, "k", "v")
    stored.upsert(spark, rows(2, 100), path, "k", "v")
    assert {(r.v, r.n) for r in spark.read.parquet(path).groupBy("v").agg(F.count("*").alias("n")).collect()} == {(1, 200), (2, 100)}
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    assert all(p.name.endswith(".zstd.parquet") for p in tmp_path.rglob("*.parquet"))
    plan = stored.latest(rows(1, 9), ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_parts_by_root(spark):
    """Groups by root find each part wherever it stands, parts within parts and repeated ones too."""
    from statloom.functions import words

    for parts in (sorted({k for ks in words.KEYWORDS.values() for k in ks}), words.UNITS, words.FINANCIAL, ["ab", "b", "ab", "cabd"], ["x"]):
        groups = text.by_root(parts)
        assert sorted(p for _, group in groups for p in group) == sorted(parts) and all(root in p for root, group in groups for p in group)
        lines = [*parts, *(f"{a} {b}" for a, b in zip(parts, parts[1:])), *(root for root, _ in groups), "", "no words", " and ", None]
        got = spark.createDataFrame([(x,) for x in lines], "x string").coalesce(1).select("x", text.hits_of(F.col("x"), parts).alias("n"), text.some_of(F.col("x"), parts).alias("some")).collect()
        assert {r.x: (r.n, r.some) for r in got} == {x: (0, None) if x is None else (sum(p in x for p in parts), any(p in x for p in parts)) for x in lines}
    assert len(text.by_root(sorted({k for ks in words.KEYWORDS.values() for k in ks}))) < 50  # of 157


def test_compaction_finds_places_once(spark):
    """The runs of a text's lines are read off once, not for each line: no pattern within a lambda over the lines' places."""
    plan = text.extraction_compacted(spark.createDataFrame([("a", "x")], "doc string, text string"), 100)._jdf.queryExecution().optimizedPlan().toString()
    inside = plan[plan.index("sequence(0, (size(l#") :]
    assert "UL*" not in inside[: inside.index("AS at#")]


def test_line_queries_use_all_cores(spark, tmp_path):
    """Documents in one row group come in one task; the lines of all queries over them are read by all cores."""
    from statloom.plans import documents

    for t in ("orders", "customer", "lineitem", "part"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    spark.range(64).selectExpr("id AS doc_id", "'Revenue 1 000' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    tasks = documents.t11_t13_line_scores(spark, str(tmp_path)).where("doc LIKE 'd%'").select("doc", F.spark_partition_id().alias("task")).groupBy("task").count().count()
    assert tasks >= spark.sparkContext.defaultParallelism
