"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from statloom import plans
from statloom.functions import words
from statloom.sources.facts import statement_facts
from tools.compare import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_all_queries_have_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    found = duck.execute(plans.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert os.path.isdir(SF) and __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scaled_values_try_every_label(duck):
    """The SQL looks for each label of the list within a row's label; it does not know the printed ones beforehand."""
    sql = plans.ORACLE["r7_scaled_values"]
    longer = sql.replace("'Revenue' AS label", "'Our net sales and turnover' AS label")
    assert longer != sql and sorted(duck.execute(longer).fetchall()) == sorted(duck.execute(sql).fetchall())


def test_scaled_values_of_every_printed_fact(spark, duck):
    """Each amount that a statement prints is scaled, also those that no English label names (costs, short-term liabilities)."""
    want = set()
    for r in statement_facts(spark, SF).collect():
        for no, key in enumerate(words.PRINTED):
            v = None if r[key] is None else math.floor(r[key] / 1000)
            if v is not None and abs(v) >= 1000 and not 1900 <= v <= 2100:
                want.add((f"s{r.entity_id}-{r.period_label}", key, no, v * (1e3 if r.fy % 2 == 0 else 1e6)))
    assert {"cost_of_goods_sold", "short_term_liabilities"} <= {key for _, key, _, _ in want}
    for got in (plans.QUERIES["r7_scaled_values"](spark, SF).collect(), duck.execute(plans.ORACLE["r7_scaled_values"]).fetchall()):
        assert len(got) == len(want) and {tuple(r) for r in got} == want
