"""End-to-end job on literal raw dumps written to a scratch folder."""

import gzip
import os
import tempfile

from tidemark.operators import ingest
from tidemark.plans.run import PrejoinedPaths, RawPaths, run_all, run_prejoined
from tidemark.sources.sinks import register_view

EPISODES = """tconst\tparentTconst\tseasonNumber\tepisodeNumber
e1\tS1\t1\t1
e2\tS1\t1\t2
e3\tS1\t2\t1
e4\tS1\t2\t2
e5\tS1\t3\t1
e6\tS1\t4\t1
e7\tS1\t\\N\t1
e8\tS1\t0\t1
e9\tS2\t1\t1
e10\tX9\t1\t1
e11\tS2\t2\t1
e12\tS1\t5\t1
"""
RATINGS = """tconst\taverageRating\tnumVotes
e1\t9.0\t100
e2\t8.5\t50
e3\t8.0\t80
e4\t7.5\t20
e5\t6.0\t90
e6\t5.0\t70
e7\t9.9\t5
e8\t9.9\t5
e9\t7.0\t10
e10\t7.0\t10
e11\t6.5\t0
e12\t4.0\t60
"""
BASICS = """tconst\ttitleType\tprimaryTitle\tstartYear\tendYear\truntimeMinutes\tgenres
e1\ttvEpisode\tEp\t\\N\t\\N\t22\tComedy
e2\ttvEpisode\tEp\t\\N\t\\N\t22\tComedy
e3\ttvEpisode\tEp\t\\N\t\\N\t22\tComedy
e4\ttvEpisode\tEp\t\\N\t\\N\t22\tComedy
e5\ttvEpisode\tEp\t\\N\t\\N\t22\tComedy
e6\ttvEpisode\tEp\t\\N\t\\N\t22\tComedy
e9\ttvEpisode\tEp\t\\N\t\\N\t22\tDrama
e11\ttvSpecial\tEp\t\\N\t\\N\t22\tDrama
e12\ttvEpisode\tEp\t\\N\t\\N\t22\tComedy
S1\ttvSeries\tShow One\t1999\t2010\t22\tComedy,Animation
S2\ttvSeries\tShow "Two"\t2001\t\\N\t44\tDrama
"""
CATEGORIES = "entity_id,title,category\nS1,Show One,animation\nS2,Show Two,drama\n"
SELECTED = "entity_id\nS1\nS2\n"


def _write(root, name, text):
    path = os.path.join(root, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_run_all(spark):
    root = tempfile.mkdtemp(prefix="tidemark-run-")
    paths = RawPaths(
        items=_write(root, "episode.tsv", EPISODES),
        ratings=_write(root, "ratings.tsv", RATINGS),
        basics=_write(root, "basics.tsv", BASICS),
        categories=_write(root, "categories.csv", CATEGORIES),
        selected=_write(root, "selected.csv", SELECTED),
    )
    out = run_all(spark, paths, os.path.join(root, "out"), ingest.CleanRules(), is_sample=True)
    clean = {r["item_id"] for r in out["clean_items"].collect()}
    assert clean == {"e1", "e2", "e3", "e4", "e5", "e6", "e9", "e12"}
    funnel = {r["outcome"]: r["row_count"] for r in out["clean_funnel"].collect()}
    assert funnel == {"kept": 8, "period_null": 1, "period_zero": 1, "not_selected": 1, "type_wrong": 1}
    meta = {r["entity_id"]: r for r in out["dim_entity"].collect()}
    assert meta["S2"]["title"] == 'Show "Two"' and meta["S2"]["end_year"] is None
    assert meta["S1"]["category"] == "animation" and meta["S1"]["start_year"] == 1999
    kpis = {(r["entity_id"], r["period"]): r for r in out["period_kpis"].collect()}
    assert abs(kpis[("S1", 1)]["weighted_score"] - (9.0 * 100 + 8.5 * 50) / 150) < 1e-12
    breaks = {r["entity_id"]: r["break_period"] for r in out["break_period"].collect()}
    # S1 weighted means 8.83, 7.9, 6.0, 5.0, 4.0; baseline 6.35; rolling means of periods 4 and 5
    # (6.3, 5.0) are the first two below it -> break = 5 - 1 = 4
    assert breaks == {"S1": 4, "S2": None}
    dur = {r["entity_id"]: r["durability"] for r in out["durability"].collect()}
    assert dur == {"S1": 3, "S2": 1}
    dq = {r["check_id"]: r["status"] for r in out["dq_checks"].collect()}
    assert dq["Q2"] == "PASS" and dq["Q17c"] == "PASS" and dq["Q19b"] == "PASS" and dq["Q21"] == "PASS"
    qa = {r["check"]: r["result"] for r in out["qa_summary"].collect()}
    assert qa == {"count_reconciliation": "PASS", "weighted_mean_check": "PASS", "duplicate_check": "PASS",
                  "break_sanity": "PASS", "weight_check": "SKIP"}
    extremes = {r["pick"]: r["item_id"] for r in out["weight_extremes"].collect()}
    # weights sorted: 10 20 50 60 70 80 90 100 -> index floor(8/2) = 4 is e6 (70)
    assert extremes == {"lowest": "e9", "median": "e6", "highest": "e1"}


def _gz(root, name, text, members=3):
    """``text`` as a gzip file of several members, cut anywhere."""
    data, path = text.encode(), os.path.join(root, name)
    step = -(-len(data) // members)
    with open(path, "wb") as f:
        f.write(b"".join(gzip.compress(data[i : i + step]) for i in range(0, len(data), step)))
    return path


def test_run_all_on_gzip_dumps_counts_malformed_lines(spark):
    root = tempfile.mkdtemp(prefix="tidemark-gz-")
    paths = RawPaths(
        items=_gz(root, "episode.tsv.gz", EPISODES + "e13\tS1\nbroken\n"),
        ratings=_gz(root, "ratings.tsv.gz", RATINGS + "e1\t9.5\t7\ne2\tnot a number\t7\n"),
        basics=_gz(root, "basics.tsv.gz", BASICS),
        categories=_write(root, "categories.csv", CATEGORIES),
        selected=_write(root, "selected.csv", SELECTED),
    )
    out = run_all(spark, paths, os.path.join(root, "out"), ingest.CleanRules(), is_sample=True)
    funnel = {r["outcome"]: r["row_count"] for r in out["clean_funnel"].collect()}
    # the second rating of e1 joins, that of e2 has no score
    assert funnel == {"kept": 9, "score_null": 1, "period_null": 1, "period_zero": 1, "not_selected": 1, "type_wrong": 1, "malformed": 2}
    assert sorted(r["score"] for r in out["clean_items"].filter("item_id = 'e1'").collect()) == [9.0, 9.5]


PRE_ITEMS = """episode_tconst,show_tconst,season_num,episode_num,avg_rating,num_votes
p1,S1,1.0,1,9.0,100
p2,S1,1.0,2,8.0,100.0
p3,S1,2.0,1,7.0,50
p4,S1,,1,7.0,50
p5,S1,0.0,1,7.0,50
p6,S1,3.0,1,,50
p7,S2,1.0,1,6.5,0
p8,S2,2.0,x,6.5,5
p9,S2,2.0,2,6.5,5
"""
PRE_TYPES = "episode_tconst,title_type\n" + "".join(f"p{i},tvEpisode\n" for i in range(1, 9)) + "p9,tvSpecial\n"
PRE_META = "show_tconst,primary_title,start_year,end_year,genres\nS1,Show One,1999,2010,Comedy\nS2,Show Two,2001,,Drama\n"
PRE_CATEGORIES = "show_tconst,title,category\nS1,Show One,animation\nS2,Show Two,drama\n"


def test_run_prejoined_on_literal_rows(spark):
    root = tempfile.mkdtemp(prefix="tidemark-pre-")
    paths = PrejoinedPaths(
        items=_write(root, "items.csv", PRE_ITEMS), metadata=_write(root, "meta.csv", PRE_META),
        types=_write(root, "types.csv", PRE_TYPES), categories=_write(root, "categories.csv", PRE_CATEGORIES),
    )
    out = run_prejoined(spark, paths, os.path.join(root, "out"), id_prefix="p", csv_dir=os.path.join(root, "csv"))
    funnel = {r["outcome"]: r["row_count"] for r in out["clean_funnel"].collect()}
    assert funnel == {"kept": 4, "period_null": 1, "period_zero": 1, "score_null": 1, "ordinal_invalid": 1, "type_invalid": 1}
    assert {r["item_id"]: r["weight"] for r in out["clean_items"].collect()} == {"p1": 100, "p2": 100, "p3": 50, "p7": 0}
    kpis = {(r["entity_id"], r["period"]): r for r in out["period_kpis"].collect()}
    assert kpis[("S1", 1)]["weighted_score"] == 8.5 and kpis[("S2", 1)]["weighted_score"] is None
    assert {r["entity_id"]: r["durability"] for r in out["durability"].collect()} == {"S1": 2, "S2": 0}  # 8.5 and the mean of 8.5 and 7 reach 7.75
    checks = {r["check_id"]: r["status"] for r in out["dq_checks"].collect()}
    assert checks["Q2"] == checks["Q11"] == "PASS"
    exported = spark.read.option("header", True).csv(os.path.join(root, "csv", "clean_items"))
    assert [r["item_id"] for r in exported.collect()] == ["p1", "p2", "p3", "p7"]  # by entity, period, ordinal


def test_views_are_replaced(spark):
    register_view(spark.range(3), "tm_view")
    register_view(spark.range(5), "tm_view")
    assert spark.table("tm_view").count() == 5


# Pre-joined sample folder and its category table; the test skips when unset.
SAMPLE_DIR = os.environ.get("TIDEMARK_SAMPLE_DIR", "")
CATEGORY_FILE = os.environ.get("TIDEMARK_CATEGORY_FILE", "")


def test_run_prejoined_on_reference_sample(spark):
    """The pre-joined mode on the committed sample (175 items, 4 entities)
    reproduces its designed outcomes and passes every data-quality check."""
    import pytest

    if not (SAMPLE_DIR and CATEGORY_FILE and os.path.exists(SAMPLE_DIR) and os.path.exists(CATEGORY_FILE)):
        pytest.skip("set TIDEMARK_SAMPLE_DIR and TIDEMARK_CATEGORY_FILE")
    paths = PrejoinedPaths(
        items=f"{SAMPLE_DIR}/episodes_filtered.csv",
        metadata=f"{SAMPLE_DIR}/shows_metadata.csv",
        types=f"{SAMPLE_DIR}/episodes_basics.csv",
        categories=CATEGORY_FILE,
    )
    root = tempfile.mkdtemp(prefix="tidemark-sample-")
    out = run_prejoined(spark, paths, os.path.join(root, "out"), id_prefix="tt999", csv_dir=os.path.join(root, "csv"))
    assert out["clean_items"].count() == 175
    breaks = {r["entity_id"]: r["break_period"] for r in out["break_period"].collect()}
    assert breaks == {"tt0096697": 6, "tt0182576": None, "tt0206512": 5, "tt1520211": 5}
    dur = {r["entity_id"]: r["durability"] for r in out["durability"].collect()}
    assert dur == {"tt0096697": 5, "tt0182576": 5, "tt0206512": 4, "tt1520211": 4}
    dq = {r["check_id"]: r["status"] for r in out["dq_checks"].collect()}
    assert {k for k, v in dq.items() if v != "PASS"} == set(), dq
    assert "Q11" in dq and "Q19b" in dq
    qa = {r["check"]: r["result"] for r in out["qa_summary"].collect()}
    assert qa == {"count_reconciliation": "PASS", "weighted_mean_check": "PASS", "duplicate_check": "PASS",
                  "break_sanity": "PASS", "weight_check": "SKIP"}
    ext = {r["pick"]: (r["item_id"], r["weight"]) for r in out["weight_extremes"].collect()}
    assert ext == {"lowest": ("tt9990174", 4154), "median": ("tt9990065", 21950), "highest": ("tt9990139", 38643)}
    # CSV export with a header, rows in (entity, period) order
    kpi_csv = spark.read.option("header", True).csv(os.path.join(root, "csv", "period_kpis"))
    assert kpi_csv.count() == 27 and kpi_csv.columns[:2] == ["entity_id", "period"]
    first = kpi_csv.first()
    assert (first["entity_id"], first["period"]) == ("tt0096697", "1")
