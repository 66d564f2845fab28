import pytest

from compare import same
from textloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    ours, theirs = same(spark, registry.QUERIES[name], registry.ORACLES[name], sf)
    assert ours == theirs and ours


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op3_quality_ledger", "op4_weighted_fair_mix"])
def test_native(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
