"""Digests by key parts: what differs is found, what is equal isn't shuffled."""

import random
from collections import Counter

import pytest

from tidemark.operators.digest import differing_buckets, table_diff

SCHEMA = "k string, a bigint, b double, t string"


def _rows(seed, n=300):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot", None, f"k{i}"]), rnd.choice([None, i % 7]), rnd.choice([0.0, -0.0, 1.5, None]), rnd.choice([None, "", "x"])) for i in range(n)]


def _diff(spark, left, right, **k):
    out = table_diff(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"], **k)
    assert out.columns == ["k", "a", "b", "t", "surplus"]
    return {tuple(r)[:4]: r["surplus"] for r in out.collect()}


def _expected(left, right):
    count = Counter(left)
    count.subtract(right)
    return {row: n for row, n in count.items() if n}


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_diff_equals_multiset_difference(spark, buckets):
    left = _rows(1)
    right = left[20:] + _rows(2, 25) + [left[30]] * 3
    random.Random(3).shuffle(right)
    assert _diff(spark, left, right, buckets=buckets) == _expected(left, right)


def test_swapped_values_and_nulls_are_seen(spark):
    left = [("k", None, 1.5, "x"), ("k", 1, None, "x"), ("m", 2, 2.0, "y")]
    right = [("k", 1, 1.5, "x"), ("k", None, None, "x"), ("m", 2, 2.0, "y")]
    assert _diff(spark, left, right) == _expected(left, right)
    assert _diff(spark, [(None, None, None, "x")], [("x", None, None, None)]) == {(None, None, None, "x"): 1, ("x", None, None, None): -1}


def test_repeated_rows_count(spark):
    row = ("hot", 1, 1.0, "x")
    assert _diff(spark, [row] * 1000, [row] * 998) == {row: 2}


def test_equal_and_empty_tables(spark, tmp_path):
    rows = _rows(4)
    assert _diff(spark, rows, rows[::-1]) == {} and _diff(spark, [], []) == {}
    assert _diff(spark, [], rows[:5]) == _expected([], rows[:5])
    for name, data in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in "ab")
    # the comparison of equal tables has one exchange, of part numbers and sums
    plan = differing_buckets(a, b, ["k"])._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "hashpartitioning(_tm_bucket" in exchanges[0]
    # nothing is left to read
    assert str(tmp_path) not in table_diff(a, b, ["k"])._jdf.queryExecution().optimizedPlan().toString()


def test_only_differing_parts_are_compared(spark):
    left = [(f"k{i}", i, 1.0, "x") for i in range(2000)]
    right = [r if r[1] != 77 else (r[0], r[1], 2.0, r[3]) for r in left]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    assert differing_buckets(a, b, ["k"]).count() == 1
    assert _diff(spark, left, right) == {("k77", 77, 1.0, "x"): 1, ("k77", 77, 2.0, "x"): -1}


def test_other_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="t"):
        table_diff(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA).drop("t"), ["k"])
