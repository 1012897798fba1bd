"""Data-quality job and marts on small literal inputs."""

from helpers import rows
from tidemark.operators import marts, quality
from tidemark.operators.metrics import SeriesTrend

FACT = [  # entity, period, score, weight (two items per period)
    ("A", p, s, 10) for p, s in [(1, 9.0), (2, 9.0), (3, 8.5), (4, 5.0), (5, 4.0), (6, 4.0)]
] + [("B", p, s, 10) for p, s in [(1, 6.0), (2, 7.0), (3, 8.0)]]


def _fact(spark):
    data = [(f"{e}{p}-{k}", e, p, k, s + 0.1 * k, w) for e, p, s, w in FACT for k in (0, 1)]
    return spark.createDataFrame(data, "item_id string, entity_id string, period int, ordinal int, score double, weight bigint")


def test_dq_checks(spark):
    fact = _fact(spark)
    t = SeriesTrend(fact)
    expected = spark.createDataFrame([("A",), ("B",)], "entity_id string")
    meta = spark.createDataFrame([("A", "a", 1, 2, "x"), ("B", "b", 1, 2, "y")],
                                 "entity_id string, title string, start_year int, end_year int, genres string")
    types = fact.select("item_id").withColumn("item_type", fact.item_id.substr(0, 0)).selectExpr(
        "item_id", "'tvEpisode' AS item_type")
    rules = quality.QualityRules(rederive_breaks=True, id_prefix="A")
    checks = quality.dq_checks(fact, meta, types, t.kpis(), t.break_period(expected), t.durability(expected),
                               expected, rules, expected_rows=2)
    got = {r["check_id"]: (r["status"], r["observed"]) for r in checks.collect()}
    assert got["Q2"] == ("PASS", 0)
    assert got["Q11"] == ("FAIL", 6)  # B's item ids do not carry the prefix
    assert got["Q19a"][0] == "PASS" and got["Q19b"] == ("PASS", 0)
    assert got["Q21"] == ("PASS", 0)
    assert got["Q4a"] == ("PASS", 0)
    # B rises 6 -> 7 -> 8: its first two rolling means sit below the baseline, so it
    # "breaks" at period 1, which the break check rejects (a break must be >= 3).
    assert got["Q17c"] == ("FAIL", 1)
    fails = sorted(k for k, (st, _) in got.items() if st == "FAIL")
    assert fails == ["Q11", "Q17c"]
    summary = quality.dq_passed(checks).first()
    assert summary["passed"] is False and summary["failures"] == 2


def test_marts(spark):
    t = SeriesTrend(_fact(spark))
    dim = spark.createDataFrame([("A", "a", "cat1", "x,y"), ("B", "b", "cat1", "y"), ("C", "c", "cat2", None)],
                                "entity_id string, title string, category string, genres string")
    card = rows(marts.kpi_card(t, dim), "entity_id")
    assert card["A"]["best_period"] in (1, 2) and card["C"]["total_items"] == 0
    marker = rows(marts.break_marker(t), "entity_id", "period")
    brk = card["A"]["break_period"]
    assert brk is not None and marker[("A", brk)]["break_flag"] == 1
    dr = rows(marts.durability_rank(t, dim), "entity_id")
    assert dr["C"]["durability"] == 0 and dr["C"]["durability_rank"] == 3
    top = marts.top_periods(t, 2).collect()
    assert len([r for r in top if r["entity_id"] == "A"]) == 2
    dist = rows(marts.score_distribution(t), "entity_id", "period")
    assert abs(dist[("A", 1)]["score_median"] - 9.05) < 1e-9
    genres = rows(marts.genre_agg(t, dim, 3), "genre")
    assert genres["y"]["entities"] == 2 and None in genres
    cats = rows(marts.category_comparison(t, dim, 3), "category")
    assert cats["cat2"]["entities"] == 1
    rec = rows(marts.recovery(t, dim), "entity_id")
    assert rec["C"]["recovered"] is False
