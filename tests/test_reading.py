"""Known cases of values read from text, lines, rows and pages."""

from pyspark.sql import functions as F

from statloom.functions.numbers import preferred_amount
from statloom.operators import reading


def test_preferred_amount(spark):
    cases = {
        "2023 14 1 234 567 1 100 000": 1234567.0, "12": 12.0, "5 17": 17.0, "0710001 345 678": 345678.0, "(1,234,567)": -1234567.0, "2022 2023": None,
        "123 456 654 321": 123456.0, "growth of 12 to 1 234,5": 1234.5, "no number": None, "": None, None: None, "$ 98,765.50": 98765.5,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", preferred_amount("t").alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases


def test_best_line(spark):
    text = "Revenue grew, and a customer accounted for 10 000 000 of revenue\nRevenue 5 1 234 567 1 000 000\n\nTotal liabilities and shareholders’ equity 9 000 000\nTotal liabilities 4 000 000"
    docs = spark.createDataFrame([("a", text, 1), ("b", None, 2), ("c", "", 3)], "doc string, text string, line int")
    rows = {(r.doc, r.metric_key): r.value for r in reading.by_line(docs).collect()}
    assert rows == {("a", "revenue"): 1234567.0, ("a", "liabilities"): 4000000.0, ("a", "equity"): 9000000.0}


def test_near_keyword(spark):
    docs = spark.createDataFrame([("a", "net sales: none" + "x" * 70 + " net sales were 2023\n 77 500"), ("b", None)], "doc string, text string")
    assert [tuple(r) for r in reading.near_keyword(docs).collect()] == [("a", "revenue", 77500.0)]
    assert reading.near_keyword(docs.limit(0)).count() == 0


def test_any_cell(spark):
    rows = [("a", 0, ["note", "Total assets", "12", "5,000,000"]), ("a", 1, ["Total liabilities 77", None]), ("a", 2, []), ("a", 3, None), ("a", 4, ["Revenue", "2023"])]
    df = reading.by_any_cell(spark.createDataFrame(rows, "doc string, row_no int, cells array<string>"))
    found = {(r.row_no, r.metric_key): (r.value, r.is_exact, r.is_total) for r in df.collect()}
    assert found == {(0, "total_assets"): (5000000.0, True, True), (1, "liabilities"): (77.0, False, True)}


def test_enough_pages(spark):
    page = {1: "Balance sheet 1600 1200 1250", 2: "Statement of income 2110", 3: None, 4: "2400", 5: "1400", 6: "1500", 7: "1700"}
    rows = [("a", n, t) for n, t in page.items()] + [("b", 1, "\n".join(filter(None, page.values())))]
    df = reading.enough_pages(spark.createDataFrame(rows, "doc string, page int, text string"))
    assert dict(map(tuple, df.collect())) == {"a": 6, "b": None}


def test_demo_view(spark):
    df = spark.createDataFrame([(1, {"m": -12345.0, "n": None}, {"r": 0.0}, "secret", 77), (2, None, None, None, 1)], "id int, metrics map<string,double>, ratios map<string,double>, text string, score int")
    one, two = (r.asDict() for r in reading.demo_view(df, F.lit(True)).orderBy("id").collect())
    assert one == {"id": 1, "metrics": {"m": "-XX,XXX", "n": None}, "ratios": {"r": "X"}, "text": "[DEMO: текст скрыт]", "score": 77}
    assert two == {"id": 2, "metrics": None, "ratios": None, "text": None, "score": 1}


def test_lines_are_made_once_and_by_all_cores(spark):
    """Orders in few files are dealt out before their texts are read, and no filter makes the lines again before that."""
    from statloom.plans import QUERIES
    from statloom.sources.facts import spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= cores
    assert spread(spark.range(0, 10, 1, 4 * cores)).rdd.getNumPartitions() == 4 * cores
    for name in ("x5_following_lines", "x8_results_section"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
        below = plan.toString().split("Repartition ")[-1]
        assert "Repartition " in plan.toString() and "split(" not in below and "Filter" not in below
