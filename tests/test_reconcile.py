"""Reconciliation reports and exact order statistics."""

import random
from datetime import date
from decimal import Decimal

from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators import order_stats, reconcile
from tidemark.operators.order_stats import element_at_rank, first_by
from tidemark.session import materialize


def _items(spark, data):
    return spark.createDataFrame(data, "item_id string, entity_id string, period int, ordinal int, score double, weight bigint")


def test_reconcile_counts_sentinel(spark):
    items = _items(spark, [(f"a{i}", "A", 1, i, 8.0, 1) for i in range(5)] + [(f"b{i}", "A", 2, i, 8.0, 1) for i in range(3)])
    kpis = spark.createDataFrame([("A", 2, 3), ("A", 3, 4)], "entity_id string, period int, item_count bigint")
    titles = spark.createDataFrame([("A", "Show A")], "entity_id string, title string")
    r = rows(reconcile.reconcile_counts(items, kpis, titles, titles_rows=1), "entity_id", "period")
    assert (r[("A", 1)]["diff"], r[("A", 1)]["match"], r[("A", 1)]["count_from_kpis"]) == (6, False, None)
    assert (r[("A", 2)]["diff"], r[("A", 2)]["match"]) == (0, True)
    assert (r[("A", 3)]["diff"], r[("A", 3)]["count_from_items"]) == (-5, None)
    assert r[("A", 1)]["title"] == "Show A"


def test_spot_check_prefers_not_first_period_and_zero_weight(spark):
    items = _items(spark, [("x1", "A", 1, 1, 8.0, 5), ("x2", "A", 1, 2, 8.0, 5), ("x3", "A", 2, 1, 6.0, 0)])
    kpis = spark.createDataFrame([("A", 1, 2, 8.0), ("A", 2, 1, None)],
                                 "entity_id string, period int, item_count bigint, weighted_score double")
    titles = spark.createDataFrame([("A", "Show A")], "entity_id string, title string")
    out = reconcile.spot_check(items, kpis, titles, kpi_rows=2, titles_rows=1).collect()
    summary = [r for r in out if r["is_summary"]][0]
    assert summary["period"] == 2 and summary["item_id"] == "SUMMARY"
    assert summary["pass"] is False and summary["note"] == "sum_weight=0" and summary["manual_weighted_score"] is None
    assert len(out) == 2


def test_break_sanity(spark):
    breaks = spark.createDataFrame([("A", 2), ("B", None), ("C", 5)], "entity_id string, break_period int")
    kpis = spark.createDataFrame([("A", 1), ("A", 4), ("C", 9)], "entity_id string, period int")
    titles = spark.createDataFrame([("A", "a")], "entity_id string, title string")
    r = rows(reconcile.break_sanity(breaks, kpis, titles, titles_rows=1, kpi_rows=3), "entity_id")
    assert [r[k]["flag_suspicious"] for k in "ABC"] == [True, False, False]
    assert r["A"]["total_periods"] == 4 and r["B"]["total_periods"] is None


def test_element_at_rank_matches_sort(spark):
    rnd = random.Random(7)
    for n in (1, 2, 15, 400):
        data = [(rnd.randint(0, 5), f"id{rnd.randint(0, 30):03d}") for _ in range(n)]
        df = spark.createDataFrame(data, "w int, k string")
        got = element_at_rank(df, ["w", "k"], 0.5, rows_per_task=4).collect()
        want = sorted(data)[n // 2]
        assert [(r["w"], r["k"]) for r in got] == [want]


def test_weight_extremes(spark):
    data = [(f"i{i}", "A", 1, i, 7.0, w) for i, w in enumerate([5, 1, 9, 9, 3])]
    titles = spark.createDataFrame([("A", "Show A")], "entity_id string, title string")
    out = {r["pick"]: r for r in reconcile.weight_extremes(_items(spark, data), titles, titles_rows=1).collect()}
    assert out["lowest"]["item_id"] == "i1"
    assert out["median"]["weight"] == 5  # sorted weights 1,3,5,9,9 -> index 2
    assert out["highest"]["item_id"] == "i2"  # tie on 9 -> lowest id
    assert out["highest"]["link"].endswith("/i2/")
    first = first_by(_items(spark, data), ["weight", "item_id"], ["item_id"]).collect()
    assert first[0]["item_id"] == "i1"


def test_qa_summary(spark):
    items = _items(spark, [("x1", "A", 2, 1, 8.0, 5), ("x1", "A", 2, 2, 6.0, 5)])
    kpis = spark.createDataFrame([("A", 2, 2, 7.0)], "entity_id string, period int, item_count bigint, weighted_score double")
    titles = spark.createDataFrame([("A", "Show A")], "entity_id string, title string")
    breaks = spark.createDataFrame([("A", None)], "entity_id string, break_period int")
    counts = reconcile.reconcile_counts(items, kpis, titles, titles_rows=1)
    spot = reconcile.spot_check(items, kpis, titles, kpi_rows=1, titles_rows=1)
    dups = reconcile.duplicate_items(items)
    sanity = reconcile.break_sanity(breaks, kpis, titles, titles_rows=1, kpi_rows=1)
    s = {r["check"]: r["result"] for r in reconcile.qa_summary(counts, spot, dups, sanity, True).collect()}
    assert s == {"count_reconciliation": "PASS", "weighted_mean_check": "PASS", "duplicate_check": "FAIL",
                 "break_sanity": "PASS", "weight_check": "SKIP"}


def test_spot_check_salted_path_matches_broadcast(spark):
    data = [(f"x{i}", "A", 2, i, float(i % 7), i % 5) for i in range(200)] + [("y1", "B", 3, 1, 5.0, 2)]
    items = _items(spark, data)
    kpis = spark.createDataFrame([("A", 2, 200, 3.0), ("B", 3, 1, 5.0)],
                                 "entity_id string, period int, item_count bigint, weighted_score double")
    titles = spark.createDataFrame([("A", "a"), ("B", "b")], "entity_id string, title string")
    fast = reconcile.spot_check(items, kpis, titles, kpi_rows=2, titles_rows=2)
    salted = reconcile.spot_check(items, kpis, titles, kpi_rows=2, titles_rows=2, max_broadcast_rows=0, hot_rows=10)
    assert sorted(map(tuple, fast.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)
    assert len(salted.collect()) == 203


def test_weight_extremes_ignore_missing_weights(spark):
    from tidemark.operators.reconcile import weight_extremes

    items = spark.createDataFrame([("a", None), ("b", 3), ("c", 9)], "item_id string, weight long").selectExpr(
        "item_id", "'E' AS entity_id", "1 AS period", "1 AS ordinal", "1.0D AS score", "weight")
    titles = spark.createDataFrame([("E", "t")], "entity_id string, title string")
    got = {r["pick"]: r["weight"] for r in weight_extremes(items, titles).collect()}
    assert got == {"lowest": 3, "median": 9, "highest": 9}


def test_element_at_rank_of_every_type_and_heavy_ties(spark):
    """Small task limits force every round: ties, text with common starts, NULL, not-a-number, decimals, dates."""
    rnd = random.Random(3)
    nan = float("nan")
    texts = ["", "a", "a\x00", "abcdefg", "abcdefgh", "abcdefghijklmnop", "abcdefghijklmnoq", "é", None]
    rows_ = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice([0.5, 0.5, -1e300, nan, None]), rnd.choice(texts), Decimal(rnd.randint(0, 3)) / 10**20,
              date(2000, 1, rnd.randint(1, 3)), i) for i in range(300)]
    df = spark.createDataFrame(rows_, "w int, d double, s string, p decimal(38,20), t date, i long").repartition(3)
    last = lambda v, k=0: (v is None, v != v, k if v is None or v != v else v)
    want = sorted(rows_, key=lambda r: (last(r[0]), last(r[1]), last(r[2] and r[2].encode(), b"") if r[2] != "" else (False, False, b""), r[3], r[4], r[5]))
    for fraction in (0.0, 0.35, 0.8):
        got = element_at_rank(df, ["w", "d", "s", "p", "t", "i"], fraction, rows_per_task=9).collect()
        assert [r["i"] for r in got] == [want[int(300 * fraction)][5]]
    assert element_at_rank(df.filter("i < 0"), ["w", "i"]).collect() == []
    same = spark.createDataFrame([("x", 1)] * 20, "s string, w int")
    assert [tuple(r) for r in element_at_rank(same, ["s", "w"], 0.5, rows_per_task=2).collect()] == [("x", 1)]


def test_element_at_rank_writes_only_the_bracket(spark, monkeypatch):
    written = []
    monkeypatch.setattr(order_stats, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("w"))
    want = sorted(i * 7919 % 200_003 for i in range(200_000))[100_000]
    assert element_at_rank(df, ["w"], 0.5, rows_per_task=10_000).first()["w"] == want
    assert [w.count() < 5000 for w in written] == [True]
