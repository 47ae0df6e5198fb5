import duckdb
import pytest

import __spark_entry__ as entry
from glossaweave.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, name):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name not in registry.ORACLE:
        return
    con = duckdb.connect()
    for t in "orders lineitem documents pages labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(registry.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLE) <= set(registry.QUERIES) <= set(entry.queries())


def test_plans_stay_in_the_jvm(spark):
    plan = registry.QUERIES["html_text_units"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and "ReadSchema: struct<page_id:bigint,html:string>" in plan
