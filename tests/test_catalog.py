import pytest

from compare import same
from textloom.plans import catalog, files


@pytest.mark.parametrize("name", sorted(files.ORACLES))
def test_query_equals_sql(spark, sf, name):
    ours, theirs = same(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf)
    assert ours == theirs
    assert ours


def test_every_query_without_sql_has_a_test_of_its_own():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"text_extract"}


def test_flagship(spark, sf):
    rows = catalog.flagship(spark, sf).collect()
    assert len(rows) == 20
    assert rows == sorted(rows, key=lambda r: (-r["score"], r["doc_id"]))


def test_line_filter_does_not_shuffle(spark, sf):
    plan = catalog.line_clean(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
