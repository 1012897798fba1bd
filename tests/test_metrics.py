"""Edge-case fixtures (zero weight, period gaps, single period, ties, orphans)."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tidemark.operators.joins import attach
from tidemark.operators.metrics import JoinPolicy, SeriesTrend, counted_scores, period_base, period_base_of_counts

# (entity, period, score, weight), one item each.
EDGE = [
    ("z", 1, 8.0, 10), ("z", 2, 6.0, 0), ("z", 3, 5.0, 10),
    ("g", 1, 7.0, 10), ("g", 2, 4.0, 10), ("g", 5, 4.0, 10), ("g", 6, 12.0, 10),
    ("s", 1, 7.5, 4),
    ("t", 1, 8.0, 5), ("t", 2, 8.0, 9), ("t", 3, 7.0, 5),
    ("orphan", 1, 5.0, 1),
]

# Expected: weighted, baseline, rolling3, pct_high, rank, below, value_index.
EXPECTED = {
    ("z", 1): (8.0, 6.5, 8.0, 100, 1, 0, 8.331141),
    ("z", 2): (None, 6.5, 8.0, 0, 3, 0, None),
    ("z", 3): (5.0, 6.5, 6.5, 0, 2, 0, 5.206963),
    ("g", 1): (7.0, 6.75, 7.0, 100, 2, 0, 7.289749),
    ("g", 2): (4.0, 6.75, 5.5, 0, 3, 1, 4.165571),
    ("g", 5): (4.0, 6.75, 5.0, 0, 3, 1, 4.165571),
    ("g", 6): (12.0, 6.75, 6.666667, 100, 1, 1, 12.496712),
    ("s", 1): (7.5, 7.5, 7.5, 100, 1, 0, 5.242275),
    ("t", 1): (8.0, 7.666667, 8.0, 100, 1, 0, 6.225210),
    ("t", 2): (8.0, 7.666667, 8.0, 100, 1, 0, 8.0),
    ("t", 3): (7.0, 7.666667, 7.666667, 0, 3, 0, 5.447059),
}


def _fact(spark):
    data = [(f"{e}-{i}", e, p, i, s, w) for i, (e, p, s, w) in enumerate(EDGE)]
    return spark.createDataFrame(data, "item_id string, entity_id string, period int, ordinal int, score double, weight bigint")


def _dim(spark):
    return spark.createDataFrame([(e,) for e in ["z", "g", "s", "t", "empty"]], "entity_id string")


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, abs_tol=1e-6)


@pytest.mark.parametrize("policy", [JoinPolicy(), JoinPolicy(max_broadcast_rows=0)])
def test_kpis_edge_cases(spark, policy):
    t = SeriesTrend(_fact(spark), policy=policy)
    k = rows(t.kpis(), "entity_id", "period")
    flags = rows(t.frame, "entity_id", "period")
    for key, (wr, base, roll, pct, rank, below, vi) in EXPECTED.items():
        r = k[key]
        assert _close(r["weighted_score"], wr), key
        assert _close(r["baseline"], base), key
        assert _close(r["rolling_mean"], roll), key
        assert _close(r["pct_high"], pct), key
        assert r["period_rank"] == rank, key
        assert flags[key]["below"] == below, key
        assert _close(r["value_index"], vi), key
        assert r["score_stddev"] is None  # n = 1
    assert ("orphan", 1) in k  # KPI rows come from the fact, not the dim


def test_break_and_durability(spark):
    t = SeriesTrend(_fact(spark))
    dim = _dim(spark)
    b = rows(t.break_period(dim), "entity_id")
    bs = rows(t.break_period(dim, strict=True), "entity_id")
    d = rows(t.durability(dim), "entity_id")
    assert {k: v["break_period"] for k, v in b.items()} == {"z": None, "g": 4, "s": None, "t": None, "empty": None}
    assert {k: v["break_period"] for k, v in bs.items()} == {"z": None, "g": 2, "s": None, "t": None, "empty": None}
    assert {k: v["durability"] for k, v in d.items()} == {"z": 3, "g": 1, "s": 1, "t": 3, "empty": 0}
    summ = rows(t.summary(dim), "entity_id")
    assert summ["g"]["break_label"] == "4" and summ["z"]["break_label"] == "No break detected"
    assert summ["empty"]["period_count"] == 0


def test_period_base_single_pass_types(spark):
    pb = period_base(_fact(spark))
    types = dict(pb.dtypes)
    assert types["item_count"] == "bigint" and types["total_weight"] == "bigint"
    assert types["weighted_score"] == "double" and types["score_stddev"] == "double"


# Golden values of the reference's committed sample (FIXTURES.md section 2).
GOLDEN_BREAKS = {"tt0096697": 6, "tt0182576": None, "tt0206512": 5, "tt1520211": 5}
GOLDEN_DURABILITY = {"tt0096697": 5, "tt0182576": 5, "tt0206512": 4, "tt1520211": 4}
# Folder with the pre-joined sample files (episodes_filtered.csv, ...); tests skip when unset.
SAMPLE_DIR = os.environ.get("TIDEMARK_SAMPLE_DIR", "")
SAMPLE = os.path.join(SAMPLE_DIR, "episodes_filtered.csv")


def test_golden_sample(spark):
    if not (SAMPLE_DIR and os.path.exists(SAMPLE)):
        pytest.skip("set TIDEMARK_SAMPLE_DIR to the pre-joined sample folder")
    from tidemark.sources.raw import read_csv_table
    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField("item_id", T.StringType()), T.StructField("entity_id", T.StringType()),
        T.StructField("period", T.IntegerType()), T.StructField("ordinal", T.IntegerType()),
        T.StructField("score", T.DoubleType()), T.StructField("weight", T.LongType()),
    ])
    fact = read_csv_table(spark, SAMPLE, schema)
    t = SeriesTrend(fact)
    dim = fact.select("entity_id").distinct()
    assert {k: v["break_period"] for k, v in rows(t.break_period(dim), "entity_id").items()} == GOLDEN_BREAKS
    assert {k: v["durability"] for k, v in rows(t.durability(dim), "entity_id").items()} == GOLDEN_DURABILITY
    k = rows(t.kpis(), "entity_id", "period")
    assert len(k) == 27
    r = k[("tt0096697", 1)]
    assert (r["item_count"], r["total_weight"]) == (8, 239115)
    assert _close(r["weighted_score"], 8.406940) and _close(r["score_stddev"], 0.311677)
    assert _close(r["value_index"], 45.217639) and _close(r["baseline"], 7.521504)
    r = k[("tt0182576", 3)]
    assert _close(r["pct_high"], 16.666667) and r["period_rank"] == 6


FACT = "item_id string, entity_id string, period int, ordinal int, score double, weight bigint"


def test_kpis_scan_the_fact_once_and_need_no_salts(spark, tmp_path):
    """One entity holds most rows; with broadcasting disabled the baseline meets counted scores, not items."""
    data = [(f"h{i}", "hot", 1 + i % 3, i, float(i % 10), 1 + i % 4) for i in range(300)]
    data += [(f"c{i}", "cold", 1 + i % 3, i, float(i % 7), 2) for i in range(20)]
    spark.createDataFrame(data, FACT).write.parquet(f"{tmp_path}/fact")
    fact = spark.read.parquet(f"{tmp_path}/fact")
    wide = SeriesTrend(fact, policy=JoinPolicy(max_broadcast_rows=0))
    assert wide.counts.count() == 30 + 20 and wide.counts.filter("entity_id = 'hot'").count() == 30
    plan = wide.kpis()._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan and "_tm_salt" not in plan and "BroadcastNestedLoopJoin" not in plan
    plain = SeriesTrend(fact)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(wide.kpis()) == key(plain.kpis())


def test_period_base_from_counted_scores(spark):
    rnd = random.Random(4)
    data = [(f"i{i}", rnd.choice(["A", "B", None]), rnd.choice([1, 2, 3, None]), i, rnd.choice([None, 7.1, 7.1, 8.3, 9.0]), rnd.choice([None, 0, 3, 5])) for i in range(200)]
    data += [("x", "one", 1, 1, 9.1, 4), ("y", "none", 1, 1, None, None)] + [(f"z{i}", "same", 1, i, 8.7, 10**6) for i in range(1000)]
    fact = spark.createDataFrame(data, FACT)
    order = ["entity_id", "period"]
    direct = period_base(fact).orderBy(*order).collect()
    counted = period_base_of_counts(counted_scores(fact)).orderBy(*order).collect()
    assert len(direct) == len(counted)
    for a, b in zip(direct, counted):
        a, b = a.asDict(), b.asDict()
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == b[k] or math.isclose(a[k], b[k], rel_tol=1e-12, abs_tol=1e-9), (k, a, b)


def test_broadcast_bound_counts_bytes(spark):
    big, table = spark.range(100).withColumn("k", F.col("id")), spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    plan = lambda **k: attach(big, table, ["k"], table_rows=50, **k)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan() and "broadcast" not in plan(max_broadcast_bytes=1000) and "broadcast" not in plan(max_broadcast_rows=10)
