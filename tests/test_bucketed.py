"""Bucketed tables join without an exchange; hot keys leave the buckets."""

import os
import random
from collections import Counter

import pytest

from tidemark.session import materialize, stage_folder, stage_scope
from tidemark.sources.bucketed import colocated_join, write_bucketed


def _data(seed, n, hot):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < hot else rnd.choice([None, f"k{rnd.randrange(n)}"]), i) for i in range(n)]


def _expected(left, right):
    by_key = {}
    for k, v in right:
        by_key.setdefault(k, []).append(v)
    return Counter((k, a, b) for k, a in left if k is not None for b in by_key.get(k, []))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_left,hot_right", [(0, 0), (0.4, 0), (0.4, 0.1), (0, 0.4)])
def test_join_equals_plain_join(spark, hot_left, hot_right):
    left, right = _data(1, 600, hot_left), _data(2, 300, hot_right)
    a = write_bucketed(spark.createDataFrame(left, "k string, a int"), "k", rows_per_bucket=40, min_part_rows=50)
    b = write_bucketed(spark.createDataFrame(right, "k string, b int"), "k", rows_per_bucket=40, min_part_rows=50)
    assert (a.buckets, b.buckets) == (15, 8) and ("hot" in a.hot, "hot" in b.hot) == (hot_left > 0, hot_right > 0.1)
    out = colocated_join(spark, a, b)
    assert out.columns == ["k", "a", "b"]
    assert Counter(map(tuple, out.collect())) == _expected(left, right)


def test_no_exchange_without_hot_keys(spark):
    a = write_bucketed(spark.range(4000).selectExpr("id % 900 AS k", "id AS a"), "k", rows_per_bucket=500)
    b = write_bucketed(spark.range(900).selectExpr("id AS k", "id * 2 AS b"), "k", like=a)
    plan = _plan(colocated_join(spark, a, b))
    assert a.buckets == b.buckets == 8 and "Join" in plan and "Exchange" not in plan
    assert colocated_join(spark, a, b).count() == 4000


def test_only_hot_rows_are_exchanged(spark):
    a = write_bucketed(spark.range(4000).selectExpr("if(id % 2 = 0, 0, id) AS k", "id AS a"), "k", rows_per_bucket=500, min_part_rows=100)
    b = write_bucketed(spark.range(4000).selectExpr("id AS k", "id AS b"), "k", like=a, min_part_rows=100)
    assert set(a.hot) == {0} and not b.hot
    plan = _plan(colocated_join(spark, a, b))
    assert "NOT (k" in plan and plan.count("Exchange hashpartitioning") <= 2
    assert colocated_join(spark, a, b).count() == 4000


def test_empty_tables_and_other_keys(spark):
    a = write_bucketed(spark.createDataFrame([], "k string, a int"), "k")
    b = write_bucketed(spark.createDataFrame([("x", 1)], "k string, b int"), "k")
    assert a.buckets == 1 and colocated_join(spark, a, b).count() == 0
    with pytest.raises(ValueError):
        colocated_join(spark, a, write_bucketed(spark.createDataFrame([("x", 1)], "k string, b int"), "b"))


def test_stage_tables_of_a_scope_go(spark):
    outside = materialize(spark.range(3))
    with stage_scope(spark):
        folder = stage_folder(spark)
        assert materialize(spark.range(4)).count() == 4 and os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and outside.count() == 3
    with pytest.raises(RuntimeError), stage_scope(spark):
        folder = stage_folder(spark)
        materialize(spark.range(4))
        raise RuntimeError
    assert not os.path.exists(folder.removeprefix("file:")) and stage_folder(spark) != folder
