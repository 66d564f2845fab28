import random

import plain
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality_ledger, source_mix


def test_measurements(spark):
    r = random.Random(1)
    texts = ["", " ", "a " * 8, "a " * 9, "a b c d e f g h " * 3, "x|y\n\nx|y\n \n"] + [r.choice([" ", "\n"]).join(r.choice(["a", "b", "#c", "é😀"]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    rows = quality_ledger.op3_quality_ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        assert tuple(row[c] for c in quality_ledger.BASE_COLUMNS) == plain.rules(texts[row["doc_id"]]), texts[row["doc_id"]]
        n, *_, repeated = plain.rules(texts[row["doc_id"]])
        assert row["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert not (row["kept"] and row["base_failed"])


def test_policies_and_ablations(spark):
    entries = spark.createDataFrame([(0,), (1,), (4,), (5,), (4 + 8,)], "fail_mask long")
    assert [r["kept"] for r in quality_ledger.apply_policy(entries, "v1").collect()] == [True, False, True, False, True]
    assert [r["kept"] for r in quality_ledger.apply_policy(entries, "v2").collect()] == [True, False, False, False, False]
    found = {r["rule"]: tuple(r)[1:] for r in quality_ledger.ablations(entries).collect()}
    assert found["symbols"] == (3, 1, 2) and found["too_few_words"] == (2, 1, 2) and found["shouting"] == (0, 0, 1)


def _docs(spark, sizes):
    rows = [(i, " ".join("w" * (k % 3 + 1) for k in range(n)), s) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_targets(spark, seed):
    r = random.Random(seed)
    sizes = [(r.choice(["a", "b", "c", "é", "Z", None, "hot", "hot", "hot"]), r.choice([0, 1, 5, 40, 200])) for _ in range(120)]
    per = {}
    for s, n in sizes:
        per[s] = per.get(s, 0) + n
    rows = source_mix.op4_weighted_fair_mix(_docs(spark, sizes)).collect()
    expected, taken = plain.targets(per), {}
    for row in rows:
        assert row["size"] == sizes[row["doc_id"]][1] and row["source_size"] == per[row["source"]]
        assert row["target"] == pytest.approx(expected[row["source"]])
        assert 0 <= row["taken"] <= 3 * row["size"]
        taken[row["source"]] = taken.get(row["source"], 0) + row["taken"]
    for s, n in taken.items():
        assert n == pytest.approx(expected[s], abs=1)


def test_whole_copies(spark):
    mix = source_mix.weighted_fair_mix(_docs(spark, [("a", 10), ("b", 40), ("b", 40)]), boundary="whole")
    for row in mix.collect():
        assert row["taken"] == row["copies"] * row["size"]
    order = [r["finish"] for r in source_mix.served_order(mix).collect()]
    assert order == sorted(order)
    with pytest.raises(ValueError):
        source_mix.weighted_fair_mix(_docs(spark, [("a", 1)]), boundary="x")


def test_ledger_replaces_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x " * 30, "old", 7)], "doc_id long, text string, n_words string, extra int")
    row = quality_ledger.ledger(docs).select("extra", F.col("n_words")).head()
    assert (row["extra"], row["n_words"]) == (7, 30)
