"""Cleaning rules in order (FIXTURES.md section 3), first failing rule wins."""

from helpers import rows
from pyspark.sql import functions as F
from tidemark.operators import bloom, ingest, model
from tidemark.operators.dedupe import dedupe_first, duplicate_keys, extra_duplicates

ITEMS = [  # item, parent, season, ep
    ("i1", "A", "1", "1"), ("i2", "A", "1", "2"), ("i3", "B", "1", "1"), ("i4", "A", None, "1"),
    ("i5", "A", "0", "1"), ("i6", "A", "1", None), ("i7", "A", "1", "3"), ("i8", "A", "1", "4"),
    ("i9", "A", "1", "5"), ("i10", "A", "1", "6"), ("i11", "A", "1", "7"), ("i12", "A", "0", None),
    ("i13", "A", "x1", "8"),
]
RATINGS = [  # item, rating, votes
    ("i1", 8.0, 10), ("i2", 7.0, 0), ("i3", 8.0, 10), ("i4", 8.0, 10), ("i5", 8.0, 10), ("i6", 8.0, 10),
    ("i8", None, 10), ("i9", 8.0, None), ("i10", 8.0, 10), ("i11", 8.0, 10), ("i13", 8.0, 10),
]
TYPES = [(f"i{n}", "tvEpisode") for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 13)] + [("i11", "tvSpecial"), ("i12", "tvSpecial")]

OUTCOME = {
    "i1": None, "i2": None, "i3": "not_selected", "i4": "period_null", "i5": "period_zero",
    "i6": "ordinal_null", "i7": "unrated", "i8": "score_null", "i9": "weight_null", "i10": "type_missing",
    "i11": "type_wrong", "i12": "period_zero", "i13": "period_invalid",
}


def _tagged(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, parent_id string, period_text string, ordinal_text string")
    ratings = spark.createDataFrame(RATINGS, "item_id string, score double, weight bigint")
    types = spark.createDataFrame(TYPES, "item_id string, item_type string")
    sel = spark.createDataFrame([("A",)], "entity_id string")
    return ingest.tag_items(items, ratings, types, sel, ingest.CleanRules(), selected_rows=1)


def test_reject_reasons(spark):
    got = {k: v["reject_reason"] for k, v in rows(_tagged(spark), "item_id").items()}
    assert got == OUTCOME


def test_clean_items_and_funnel(spark):
    tagged = _tagged(spark)
    clean = rows(ingest.clean_items(tagged), "item_id")
    assert set(clean) == {"i1", "i2"}
    assert clean["i2"]["weight"] == 0  # zero weight kept
    assert ingest.clean_items(tagged).columns == ["item_id", "entity_id", "period", "ordinal", "score", "weight"]
    funnel = {r["outcome"]: (r["row_count"], r["zero_weight_rows"]) for r in ingest.clean_funnel(tagged).collect()}
    assert funnel["kept"] == (2, 1)
    assert funnel["period_zero"] == (2, 0)
    assert sum(n for n, _ in funnel.values()) == len(ITEMS)


def test_item_types_superset(spark):
    got = set(rows(ingest.item_types(_tagged(spark)), "item_id"))
    # items that passed the item-level rules and have a valid type; unrated ones stay in
    assert got == {"i1", "i2", "i7", "i8", "i9"}


def test_entity_metadata_and_dim(spark):
    basics = spark.createDataFrame(
        [("A", "Show A", "2001", "2010", "Drama,Comedy"), ("A", "Show A (dup)", "2001", None, "Drama"),
         ("B", "Show B", "1999.0", None, None)],
        "entity_id string, title string, start_year string, end_year string, genres string",
    )
    sel = spark.createDataFrame([("A",), ("B",)], "entity_id string")
    meta = ingest.entity_metadata(basics, sel, 2)
    m = rows(meta, "entity_id")
    assert len(m) == 2 and m["A"]["title"] == "Show A"
    cat = spark.createDataFrame([("A", "Show A", "drama")], "entity_id string, title string, category string")
    d = rows(model.dim_entity(meta, cat, 1), "entity_id")
    assert d["A"]["category"] == "drama" and d["B"]["category"] is None
    assert d["B"]["start_year"] == 1999 and d["A"]["end_year"] == 2010


def test_prejoined_mode(spark):
    items = spark.createDataFrame(
        [("e1", "A", 1, 1, 8.0, 10), ("e2", "A", 0, 1, 8.0, 10), ("e3", "A", 1, None, 8.0, 10),
         ("e4", "A", 1, 2, None, 10), ("e5", "A", 1, 3, 7.0, 3)],
        "item_id string, entity_id string, period int, ordinal int, score double, weight bigint",
    )
    types = spark.createDataFrame([("e1", "tvEpisode"), ("e4", "tvEpisode"), ("e5", "movie")],
                                  "item_id string, item_type string")
    got = {k: v["reject_reason"] for k, v in rows(ingest.prejoined_tag(items, types), "item_id").items()}
    assert got == {"e1": None, "e2": "period_zero", "e3": "ordinal_null", "e4": "score_null", "e5": "type_invalid"}


def test_prejoined_mode_accepts_whole_decimals(spark):
    items = spark.createDataFrame([("e1", 1.0, "2.0", 8.0, "10.0"), ("e2", 1.5, "1", 8.0, "1"), ("e3", 2.0, "x", 8.0, "1"), ("e4", 2.0, "3", 8.0, "1.5"),
                                   ("e5", 2.0, " +3. ", 8.0, "1e3"), ("e6", 2.0, "1e40", 8.0, "1"), ("e7", float("nan"), "1", 8.0, "1")],
                                  "item_id string, period double, ordinal string, score double, weight string")
    items = items.selectExpr("item_id", "'A' AS entity_id", "period", "ordinal", "score", "weight")
    types = spark.createDataFrame([(f"e{i}", "tvEpisode") for i in range(1, 8)], "item_id string, item_type string")
    got = {r["item_id"]: (r["period"], r["ordinal"], r["weight"], r["reject_reason"]) for r in ingest.prejoined_tag(items, types).collect()}
    assert got["e1"] == (1, 2, 10, None)
    assert [got[f"e{i}"][3] for i in (2, 3, 4)] == ["period_invalid", "ordinal_invalid", "weight_null"]
    assert got["e5"] == (2, 3, 1000, None) and [got[f"e{i}"][3] for i in (6, 7)] == ["ordinal_invalid", "period_invalid"]


ITEM_SCHEMA = "item_id string, parent_id string, period_text string, ordinal_text string"


def test_every_matching_rating_joins_and_incomplete_ones_go_after_it(spark):
    items = spark.createDataFrame([("a", "A", "1", "1"), ("a", "A", "1", "1"), ("b", "A", "1", "2"), (None, "A", "1", "3")], ITEM_SCHEMA)
    ratings = spark.createDataFrame([("a", None, 5), ("a", 7.0, 10), ("a", 6.0, 1), ("b", None, 5), (None, 5.0, 5)],
                                    "item_id string, score double, weight long")
    types = spark.createDataFrame([("a", "tvEpisode"), ("b", "tvEpisode")], "item_id string, item_type string")
    tagged = ingest.tag_items(items, ratings, types, None)
    got = sorted(((r["item_id"], r["score"], r["reject_reason"]) for r in tagged.collect()), key=str)
    assert got == sorted([("a", None, "score_null"), ("a", 6.0, None), ("a", 7.0, None)] * 2 + [("b", None, "score_null"), (None, None, "unrated")], key=str)
    assert ingest.clean_items(tagged).count() == 4


def test_smallest_type_decides(spark):
    rules = ingest.CleanRules(valid_types=("m", "c"))
    types = [("a", "c"), ("b", "m"), ("c", "d"), ("d", "z"), ("e", "a"), ("f", "m"), ("f", "d"), ("g", "z"), ("g", "m"), ("h", None), (None, "c")]
    codes = ingest.type_codes(spark.createDataFrame(types, "item_id string, item_type string"), rules)
    got = {r["item_id"]: r["t"] for r in codes.select("item_id", ingest._valid_type(rules).alias("t")).collect()}
    assert got == {"a": "c", "b": "m", "c": None, "d": None, "e": None, "f": None, "g": "m", "h": None}


def test_items_are_filtered_before_the_join(spark):
    items = spark.createDataFrame([("a", "A", "1", "1"), ("b", "A", "0", "1")], ITEM_SCHEMA)
    stage = ingest.item_stage(items, None)
    ratings = spark.createDataFrame([("a", 7.0, 10)], "item_id string, score double, weight long")
    types = spark.createDataFrame([("a", "tvEpisode")], "item_id string, item_type string")
    plan = ingest.check_items(stage, ratings, types)._jdf.queryExecution().optimizedPlan().toString()
    assert "period_text" not in plan  # the join reads the written rows that passed, not the raw items
    assert [r["item_id"] for r in ingest.rejected_items(stage).collect()] == ["b"]


def _skewed(spark, n=6000):
    """Items, ratings and types; one id holds a third of the ratings, most ratings match no item."""
    ids = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("i"), F.col("id").cast("string")))
    ratings = spark.range(n).select(ids.alias("item_id"), (F.col("id") % 10 + 0.5).alias("score"), F.col("id").alias("weight"))
    items = spark.range(n // 20).select(
        F.when(F.col("id") == 0, F.lit("hot")).otherwise(F.concat(F.lit("i"), (F.col("id") * 20 + 1).cast("string"))).alias("item_id"),
        F.lit("A").alias("parent_id"), F.lit("1").alias("period_text"), F.lit("1").alias("ordinal_text"))
    types = ratings.select("item_id", F.lit("tvEpisode").alias("item_type"))
    return items, ratings, types


def test_a_hot_id_is_split_and_nothing_is_lost(spark):
    items, ratings, types = _skewed(spark)
    rules = ingest.CleanRules(min_part_rows=100)
    checked = ingest.check_items(ingest.item_stage(items, None), ratings, types, rules)
    assert "_tm_i" in checked._jdf.queryExecution().optimizedPlan().toString()
    plain = items.join(ratings, "item_id").select("item_id", "score", "weight")
    kept = ingest.clean_items(checked).select("item_id", "score", "weight")
    assert kept.exceptAll(plain).count() == 0 and plain.exceptAll(kept).count() == 0 and kept.count() > 2000
    assert checked.filter("reject_reason = 'unrated'").count() == items.join(ratings, "item_id", "left_anti").count()


def test_ratings_and_types_are_reduced_before_they_travel(spark):
    items, ratings, types = _skewed(spark, 60_000)
    passed = items.select("item_id")
    known = bloom.key_filter(passed, "item_id", passed.count())
    cold = ratings.filter("item_id != 'hot'")
    near, matching = bloom.keep_known(cold, "item_id", known).count(), cold.join(passed, "item_id", "left_semi").count()
    assert matching <= near <= matching + 0.02 * cold.count()
    checked = ingest.check_items(ingest.item_stage(items, None), ratings, types)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_key_filter_sizes(spark):
    keys = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    rows = spark.createDataFrame([("a", 1), ("zz", 2), (None, 3), ("b", 4)], "k string, v int")
    known = bloom.key_filter(keys, "k", 3)
    assert {r["k"] for r in bloom.keep_known(rows, "k", known).collect()} - {"zz"} == {"a", "b"}
    too_large = bloom.key_filter(keys, "k", 10**9, max_bytes=1000)
    assert too_large.table is None and bloom.keep_known(rows, "k", too_large).count() == 4
    empty = bloom.key_filter(keys.filter("k = 'none'"), "k", 0)
    assert bloom.keep_known(rows, "k", empty).count() == 0


def test_dedupe_prefers_complete_rows(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "t", 2)], "k string, title string, v int")
    assert dedupe_first(df, ["k"], ["title"]).first()["title"] == "t"


def test_dedupe_and_duplicates(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 1), (None, 2)], "k string, v int")
    assert {r["k"]: r["v"] for r in dedupe_first(df, ["k"], ["v"]).collect()} == {"a": 1, "b": 2, None: 1}
    assert {r["k"]: r["count"] for r in duplicate_keys(df, ["k"]).collect()} == {"a": 2}
    e = extra_duplicates(df, ["k"]).first()
    assert (e["row_count"], e["distinct_keys"], e["extra_rows"]) == (5, 3, 2)
