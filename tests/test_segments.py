"""Windows by segments equal the plain windows, whatever the borders."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.metrics import JoinPolicy, SeriesTrend, with_rank, with_trend
from tidemark.operators.segments import _ranges, longest_series, segmented_rank, segmented_trend

FRAME = "entity_id string, period int, item_count bigint, total_weight bigint, weighted_score double"


def _frame(spark, seed):
    """One hot entity, small ones, a NULL entity, a NULL period, gaps, NULL and tied scores. Scores are
    multiples of 1/8, so sums are exact in any order."""
    rnd = random.Random(seed)
    sizes = {"hot": 400, "b": 3, "c": 1, None: 90, "all_null": 60, "z": 17}
    rows = []
    for entity, n in sizes.items():
        for period in [None, *rnd.sample(range(2000), n - 1)]:
            score = None if entity == "all_null" or rnd.random() < 0.2 else rnd.randrange(8, 40) / 8
            rows.append((entity, period, 1, rnd.randrange(5), score))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, FRAME), len(rows)


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("window,limit", [(1, 40), (3, 40), (3, 2), (7, 3)])
def test_segments_equal_plain_windows(spark, window, limit):
    frame, n = _frame(spark, window * 100 + limit)
    plain = with_trend(frame, window=window)
    split = segmented_trend(frame, n, window=window, rows_per_task=limit)
    assert split.columns == plain.columns and [t for _, t in split.dtypes] == [t for _, t in plain.dtypes]
    assert _sorted(split) == _sorted(plain)
    ranked, by_segments = with_rank(plain), segmented_rank(plain, n, rows_per_task=limit)
    assert by_segments.columns == ranked.columns and by_segments.dtypes == ranked.dtypes
    assert _sorted(by_segments) == _sorted(ranked)


def test_empty_frame(spark):
    empty = spark.createDataFrame([], FRAME)
    assert longest_series(empty) == 0
    assert segmented_rank(segmented_trend(empty, 0), 0).count() == 0


def test_hot_entity_has_no_single_window_task(spark):
    frame = spark.range(40_000).select(
        F.lit("hot").alias("entity_id"), F.col("id").cast("int").alias("period"), F.lit(1).cast("bigint").alias("item_count"),
        F.lit(1).cast("bigint").alias("total_weight"), (F.col("id") % 64 / 8).alias("weighted_score"))
    ranged = _ranges(frame, [F.col("entity_id"), F.col("period")], 40_000, 4_000)
    sizes = [r["count"] for r in ranged.groupBy("_seg").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * 4_000
    split = segmented_trend(frame, 40_000, rows_per_task=4_000)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition" in line]
    assert windows
    # windows by entity alone run on what crosses the borders, never on the frame's own rows
    for line in windows:
        assert "_seg" in line, line
    assert split.filter("below = 1").count() == with_trend(frame).filter("below = 1").count()


def test_series_uses_segments_only_for_long_entities(spark):
    fact = spark.range(3_000).select(
        F.col("id").cast("string").alias("item_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("e"), F.col("id") % 90)).alias("entity_id"),
        (F.col("id") % 701).cast("int").alias("period"), F.lit(1).alias("ordinal"), (F.col("id") % 10).cast("double").alias("score"), F.lit(4).cast("bigint").alias("weight"))
    split, plain = SeriesTrend(fact, policy=JoinPolicy(segment_rows=50)), SeriesTrend(fact)
    whole = SeriesTrend(fact, policy=JoinPolicy(segment_rows=5_000))
    a, b, c = (_sorted(t.kpis().drop("baseline")) for t in (split, plain, whole))
    assert a == b == c
    assert split._segmented and not whole._segmented and not plain._segmented
    entities = fact.select("entity_id").distinct()
    fresh = SeriesTrend(fact, policy=JoinPolicy(segment_rows=50))
    assert _sorted(fresh.summary(entities)) == _sorted(plain.summary(entities))
