"""Named queries over the driver tables (one per operator of the survey).

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
column names and types match the DuckDB oracle in ``plans/oracle.py``.
DOUBLE outputs are rounded to 6 decimals on both sides, because the two
engines sum floating-point values in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import check_state, ingest, marts, model, quality, reconcile
from tidemark.session import materialize, stage_folder
from tidemark.operators.dedupe import dedupe_first, extra_duplicates
from tidemark.operators.digest import table_diff
from tidemark.sources.bucketed import colocated_join, write_bucketed
from tidemark.sources.sinks import input_gate
from tidemark.operators.metrics import JoinPolicy, SeriesTrend
from tidemark.operators.order_stats import grouped_quantiles
from tidemark.sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
DECIMALS = 6


def rounded(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """DOUBLE columns rounded as the binary value times 10**decimals, half away from zero (``round(x, 6)`` here
    rounds the shortest decimal text instead, which differs where that text ends in a 5)."""
    scale = F.lit(10.0**decimals)
    return df.select(
        *[
            (F.round(F.col(f.name) * scale) / scale).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _trend(spark: SparkSession, sf_dir: str) -> SeriesTrend:
    return SeriesTrend(td.fact(spark, sf_dir))


C = td.COLS
E, P = C.entity, C.period


RULES = ingest.CleanRules(valid_types=td.VALID_TYPES)


# -- ingest ----------------------------------------------------------------
def _selected(spark, sf_dir):
    # the selection filters the supplier table, whose row count bounds it
    return td.selected_entities(spark, sf_dir), td.entity_rows_bound(spark, sf_dir)


def _stage(spark, sf_dir):
    sel, n = _selected(spark, sf_dir)
    return ingest.item_stage(td.raw_items(spark, sf_dir), sel, RULES, selected_rows=n)


def _checked(spark, sf_dir, stage=None):
    """Items that pass the item-stage rules, with the reasons of the other rules."""
    return ingest.check_items(_stage(spark, sf_dir) if stage is None else stage, td.raw_ratings(spark, sf_dir),
                              td.raw_types(spark, sf_dir), RULES)


def q_clean_items(spark, sf_dir):
    return rounded(ingest.clean_items(_checked(spark, sf_dir)))


def q_clean_funnel(spark, sf_dir):
    stage = _stage(spark, sf_dir)
    return ingest.clean_funnel(_checked(spark, sf_dir, stage).unionByName(ingest.rejected_items(stage)))


def q_item_types(spark, sf_dir):
    return ingest.item_types(_checked(spark, sf_dir), RULES)


def _metadata(spark, sf_dir):
    sel, n = _selected(spark, sf_dir)
    return ingest.entity_metadata(td.entity_basics(spark, sf_dir), sel, n, RULES)


def q_entity_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir)


def q_dedupe_first(spark, sf_dir):
    return rounded(dedupe_first(td.fact(spark, sf_dir), [C.item], [C.score, C.weight]))


def q_table_diff(spark, sf_dir):
    """The item table against its first-wins copy: the rows that de-duplication removed."""
    items = td.fact(spark, sf_dir).select(C.item, C.entity, C.period, C.score, C.weight)
    kept = materialize(dedupe_first(items, [C.item], [C.score, C.weight, C.entity, C.period]))  # read twice below
    return rounded(table_diff(items, kept, [C.item]))


def q_colocated_types(spark, sf_dir):
    """Items and the types of their ids joined bucket by bucket: rows and weight per type."""
    items = write_bucketed(td.fact(spark, sf_dir).select(C.item, C.weight), C.item)
    types = write_bucketed(td.raw_types(spark, sf_dir).select(C.item, "item_type"), C.item, like=items)
    return colocated_join(spark, items, types).groupBy("item_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(C.weight).alias("total_weight"))


# -- model -----------------------------------------------------------------
def q_dim_entity(spark, sf_dir):
    cat = td.categories(spark, sf_dir)
    return model.dim_entity(_metadata(spark, sf_dir), cat, category_rows=cat.count())


def q_fact_item(spark, sf_dir):
    return rounded(model.fact_item(td.fact(spark, sf_dir)))


# -- metrics ---------------------------------------------------------------
def q_period_stats(spark, sf_dir):
    t = _trend(spark, sf_dir)
    return rounded(t.frame.select(E, P, "item_count", "total_weight", "mean_score", "score_stddev"))


def q_weighted_mean(spark, sf_dir):
    return rounded(_trend(spark, sf_dir).frame.select(E, P, "weighted_score"))


def q_rolling_mean(spark, sf_dir):
    return rounded(_trend(spark, sf_dir).frame.select(E, P, "rolling_mean"))


def q_series_baseline(spark, sf_dir):
    t = _trend(spark, sf_dir)
    return rounded(t.frame.groupBy(E).agg(F.max("baseline").alias("baseline")))


def q_pct_high(spark, sf_dir):
    return rounded(_trend(spark, sf_dir).kpis().select(E, P, "pct_high"))


def q_period_rank(spark, sf_dir):
    return rounded(_trend(spark, sf_dir).kpis().select(E, P, "weighted_score", "period_rank"))


def q_segmented_trend(spark, sf_dir):
    """A daily series: a handful of entities hold all rows, each is split over several window tasks."""
    t = SeriesTrend(td.daily_fact(spark, sf_dir), policy=JoinPolicy(segment_rows=500))
    return rounded(t.ranked().select(E, P, "weighted_score", "baseline", "rolling_mean", "below", "prev_below", "prev_period", "period_rank"))


def q_value_index(spark, sf_dir):
    return rounded(_trend(spark, sf_dir).kpis().select(E, P, "value_index"))


def q_period_kpis(spark, sf_dir):
    return rounded(_trend(spark, sf_dir).kpis())


def q_below_flags(spark, sf_dir):
    return _trend(spark, sf_dir).frame.select(E, P, "below", "prev_below")


def q_break_period(spark, sf_dir):
    return _trend(spark, sf_dir).break_period(td.shows(spark, sf_dir))


def q_break_period_strict(spark, sf_dir):
    return _trend(spark, sf_dir).break_period(td.shows(spark, sf_dir), strict=True)


def q_durability(spark, sf_dir):
    return _trend(spark, sf_dir).durability(td.shows(spark, sf_dir))


def q_entity_summary(spark, sf_dir):
    return _trend(spark, sf_dir).summary(td.shows(spark, sf_dir))


# -- reconciliation ----------------------------------------------------------
def _titles(spark, sf_dir):
    return td.shows(spark, sf_dir), td.entity_rows_bound(spark, sf_dir)


def q_reconcile_counts(spark, sf_dir):
    tr = _trend(spark, sf_dir)
    titles, n = _titles(spark, sf_dir)
    return reconcile.reconcile_counts(tr.fact, tr.frame, titles, C, titles_rows=n)


def q_spot_check(spark, sf_dir):
    tr = _trend(spark, sf_dir)
    titles, n = _titles(spark, sf_dir)
    return rounded(reconcile.spot_check(tr.fact, tr.frame, titles, C, kpi_rows=tr.rows, titles_rows=n))


def q_duplicate_keys(spark, sf_dir):
    return reconcile.duplicate_items(td.fact(spark, sf_dir), C)


def q_break_sanity(spark, sf_dir):
    tr = _trend(spark, sf_dir)
    titles, n = _titles(spark, sf_dir)
    return reconcile.break_sanity(tr.break_period(titles), tr.frame, titles, C, titles_rows=n, kpi_rows=tr.rows)


def q_weight_extremes(spark, sf_dir):
    titles, n = _titles(spark, sf_dir)
    return reconcile.weight_extremes(td.fact(spark, sf_dir), titles, C, td.ITEM_LINK_PREFIX, titles_rows=n)


def q_qa_summary(spark, sf_dir):
    tr = _trend(spark, sf_dir)
    titles, n = _titles(spark, sf_dir)
    counts = reconcile.reconcile_counts(tr.fact, tr.frame, titles, C, titles_rows=n)
    spot = reconcile.spot_check(tr.fact, tr.frame, titles, C, kpi_rows=tr.rows, titles_rows=n)
    dups = reconcile.duplicate_items(tr.fact, C)
    sanity = reconcile.break_sanity(tr.break_period(titles), tr.frame, titles, C, titles_rows=n, kpi_rows=tr.rows)
    return reconcile.qa_summary(counts, spot, dups, sanity, is_sample=False)


# -- data quality (whole chain: clean -> metrics -> checks) -------------------
def q_dq_checks(spark, sf_dir):
    sel, n = _selected(spark, sf_dir)
    tagged = materialize(_checked(spark, sf_dir))
    items = ingest.clean_items(tagged)
    types = materialize(ingest.item_types(tagged, RULES))  # read by three checks
    meta = materialize(ingest.entity_metadata(td.entity_basics(spark, sf_dir), sel, n, RULES))
    expected = sel.select(F.col(E).cast("string").alias(E))
    tr = SeriesTrend(items)
    # The KPI table (period frame + an item pass) feeds four checks: written once.
    kpis = materialize(tr.kpis())
    entities = meta.select(E).distinct()  # the dimension drives the results, the selection checks them
    breaks = materialize(tr.break_period(entities))
    durable = materialize(tr.durability(entities))
    rules = quality.QualityRules(valid_types=td.VALID_TYPES, rederive_breaks=True, id_prefix=td.ID_PREFIX)
    return quality.dq_checks(items, meta, types, kpis, breaks, durable, expected, rules, expected_rows=n)


def q_dq_batches(spark, sf_dir):
    """Q1-Q11 over three batches of items (copies of an id fall into different ones), merged from their states."""
    sel, n = _selected(spark, sf_dir)
    tagged = materialize(_checked(spark, sf_dir))
    items, types = ingest.clean_items(tagged), materialize(ingest.item_types(tagged, RULES))
    meta = materialize(ingest.entity_metadata(td.entity_basics(spark, sf_dir), sel, n, RULES))
    rules = quality.QualityRules(valid_types=td.VALID_TYPES, id_prefix=td.ID_PREFIX)
    state = f"{stage_folder(spark)}/checks-{uuid.uuid4().hex}"
    part = F.pmod(F.coalesce(F.col(C.weight), F.lit(0)), F.lit(3))
    for batch in range(3):
        first = batch == 0  # the small tables come with the first batch
        check_state.add_batch(state, str(batch), items.filter(part == batch), meta.filter(F.lit(first)),
                              types.filter(F.lit(first)), rules)
    return check_state.merged_checks(spark, state, sel.select(F.col(E).cast("string").alias(E)), rules)


# -- marts -------------------------------------------------------------------
def _dim(spark, sf_dir):
    d = td.dim(spark, sf_dir)
    return d, d.count()  # left joins to nation/region: counted, not bounded by supplier


def q_kpi_card(spark, sf_dir):
    return rounded(marts.kpi_card(_trend(spark, sf_dir), td.shows(spark, sf_dir)))


def q_break_marker(spark, sf_dir):
    return rounded(marts.break_marker(_trend(spark, sf_dir)))


def q_rolling_gap(spark, sf_dir):
    return rounded(marts.rolling_gap(_trend(spark, sf_dir)))


def q_period_ranking(spark, sf_dir):
    return rounded(marts.period_ranking(_trend(spark, sf_dir)))


def q_score_distribution(spark, sf_dir):
    return rounded(marts.score_distribution(_trend(spark, sf_dir)))


def q_price_quartiles(spark, sf_dir):
    """Quartiles of a high-cardinality value over groups with a NULL period."""
    li = td.table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    rows = li.select(F.col("l_suppkey").alias(E), F.when(year != td.CLEAN_MISSING_YEAR, year).alias(P),
                     (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return rounded(grouped_quantiles(rows, [E, P], "price", [0.0, 0.25, 0.5, 0.75, 1.0],
                                     ["price_min", "price_q1", "price_median", "price_q3", "price_max"]))


def q_clean_prejoined(spark, sf_dir):
    """Line items as pre-joined rows whose numbers are written as decimals."""
    li = td.table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    items = li.select(
        td.item_id_expr().alias("item_id"),
        F.col("l_suppkey").cast("string").alias(E),
        F.when(year != td.CLEAN_MISSING_YEAR, (year - F.lit(td.CLEAN_FIRST_YEAR)).cast("double")).alias(P),
        F.col("l_linenumber").cast("double").alias("ordinal"),
        td.score_expr().alias("score"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".0")).alias("weight"),
    )
    tagged = ingest.prejoined_tag(items, td.raw_types(spark, sf_dir), RULES)
    return rounded(tagged.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome"), P).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("weight").alias("total_weight"), F.avg("score").alias("mean_score")))


def q_score_histogram(spark, sf_dir):
    return rounded(marts.score_histogram(_trend(spark, sf_dir)))


def q_volatility(spark, sf_dir):
    return rounded(marts.volatility(_trend(spark, sf_dir)))


def q_durability_rank(spark, sf_dir):
    return marts.durability_rank(_trend(spark, sf_dir), td.shows(spark, sf_dir))


def q_top_periods(spark, sf_dir):
    return rounded(marts.top_periods(_trend(spark, sf_dir)))


def q_category_comparison(spark, sf_dir):
    d, n = _dim(spark, sf_dir)
    return rounded(marts.category_comparison(_trend(spark, sf_dir), d, n))


def q_recovery(spark, sf_dir):
    return marts.recovery(_trend(spark, sf_dir), td.shows(spark, sf_dir))


def q_genre_agg(spark, sf_dir):
    d, n = _dim(spark, sf_dir)
    return rounded(marts.genre_agg(_trend(spark, sf_dir), d, n))


# -- checks as standalone operators ---------------------------------------------
# Columns each input must have (fixed values of the mapping).
REQUIRED = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate"],
    "part": ["p_partkey", "p_type"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
}


def q_input_gate(spark, sf_dir):
    gates = [input_gate(td.table(spark, sf_dir, t), t, cols) for t, cols in REQUIRED.items()]
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


def q_extra_duplicates(spark, sf_dir):
    return extra_duplicates(td.fact(spark, sf_dir), [C.item])


def q_column_profile(spark, sf_dir):
    return rounded(quality.column_profile(td.fact(spark, sf_dir), [P, C.ordinal, C.score, C.weight]))


def q_subset_anti(spark, sf_dir):
    types = ingest.item_types(_checked(spark, sf_dir), RULES)
    return quality.missing_keys(td.fact(spark, sf_dir).select(C.item), types, C.item)


def q_key_set_equality(spark, sf_dir):
    t = _trend(spark, sf_dir)
    sources = {"kpi": t.frame.select(E), "dim": td.shows(spark, sf_dir).select(E),
               "selected": td.selected_entities(spark, sf_dir)}
    return quality.key_set_equality(sources, E)


def q_entity_item_counts(spark, sf_dir):
    sel, n = _selected(spark, sf_dir)
    items = ingest.clean_items(_checked(spark, sf_dir))
    return reconcile.items_per_entity(items, sel.select(F.col(E).cast("string").alias(E)), C, entity_rows=n)


QUERIES: dict[str, Query] = {
    "clean_items": q_clean_items,
    "clean_funnel": q_clean_funnel,
    "entity_metadata": q_entity_metadata,
    "item_types": q_item_types,
    "dedupe_first": q_dedupe_first,
    "table_diff": q_table_diff,
    "colocated_types": q_colocated_types,
    "dim_entity": q_dim_entity,
    "fact_item": q_fact_item,
    "period_stats": q_period_stats,
    "weighted_mean": q_weighted_mean,
    "rolling_mean": q_rolling_mean,
    "series_baseline": q_series_baseline,
    "pct_high": q_pct_high,
    "period_rank": q_period_rank,
    "segmented_trend": q_segmented_trend,
    "value_index": q_value_index,
    "period_kpis": q_period_kpis,
    "below_flags": q_below_flags,
    "break_period": q_break_period,
    "break_period_strict": q_break_period_strict,
    "durability": q_durability,
    "entity_summary": q_entity_summary,
    "reconcile_counts": q_reconcile_counts,
    "spot_check": q_spot_check,
    "duplicate_keys": q_duplicate_keys,
    "break_sanity": q_break_sanity,
    "weight_extremes": q_weight_extremes,
    "qa_summary": q_qa_summary,
    "dq_checks": q_dq_checks,
    "dq_batches": q_dq_batches,
    "kpi_card": q_kpi_card,
    "break_marker": q_break_marker,
    "rolling_gap": q_rolling_gap,
    "period_ranking": q_period_ranking,
    "score_distribution": q_score_distribution,
    "price_quartiles": q_price_quartiles,
    "clean_prejoined": q_clean_prejoined,
    "score_histogram": q_score_histogram,
    "volatility": q_volatility,
    "durability_rank": q_durability_rank,
    "top_periods": q_top_periods,
    "category_comparison": q_category_comparison,
    "recovery": q_recovery,
    "genre_agg": q_genre_agg,
    "input_gate": q_input_gate,
    "extra_duplicates": q_extra_duplicates,
    "column_profile": q_column_profile,
    "subset_anti": q_subset_anti,
    "key_set_equality": q_key_set_equality,
    "entity_item_counts": q_entity_item_counts,
}


# One line per query: what it computes and the survey IDs it covers.
DESCRIPTIONS: dict[str, str] = {
    "clean_items": "C1: raw items that pass every rule (P3-P8, J1-J5, K4).",
    "clean_funnel": "C3: rows per outcome of the ordered reject-rule chain, zero-weight kept rows (A20).",
    "entity_metadata": "C4: one metadata row per selected entity (J4, W7).",
    "item_types": "C5: items with a valid type that passed the item-level rules (P20).",
    "dedupe_first": "W7: first-wins de-duplication by a total order, as a partial aggregate.",
    "table_diff": "U3, U5, R1: rows that two copies of a table don't share, by digests of key parts.",
    "colocated_types": "J6: items and types in tables bucketed by item id, joined without an exchange.",
    "dim_entity": "M1: entity metadata left join category (J7, P7).",
    "fact_item": "M2: typed item fact (P7).",
    "period_stats": "A1, A2, A4-A6: count, total weight, mean and sample stddev per (entity, period).",
    "weighted_mean": "A3: weighted mean per (entity, period), NULL for zero total weight.",
    "rolling_mean": "W2: 3-period rolling mean of the weighted means.",
    "series_baseline": "W1: per-entity baseline (mean of period weighted means).",
    "pct_high": "A7, J8 (K2): share of items at or above the entity baseline.",
    "period_rank": "W3: rank of periods by weighted mean (ties share, gaps).",
    "segmented_trend": "W1-W5 over entities of very many periods (daily series), each split over several window tasks.",
    "value_index": "Value index: weighted mean x log10(1 + total weight).",
    "period_kpis": "M3: the 12-column period KPI table.",
    "below_flags": "W4, W5: below-baseline flag and the previous period's flag.",
    "break_period": "M4, A8, J9: first break per dimension entity (period - 1 parity).",
    "break_period_strict": "W6: first break using the real previous existing period.",
    "durability": "M5, A9, J10: periods with rolling mean >= baseline, 0 default.",
    "entity_summary": "M6, A17: periods per entity, break with its label, durability.",
    "reconcile_counts": "R1, A10, J11, J12: item counts two ways, full outer join, -1 sentinel diff.",
    "spot_check": "R2, W8, A18, U6: weighted mean recomputed for one period per entity, detail + summary.",
    "duplicate_keys": "R3, A12: item ids seen more than once.",
    "break_sanity": "R4, A11, P16: breaks at period 1 or 2 flagged, highest period per entity.",
    "weight_extremes": "R5, O3-O6 (K3): lowest, median and highest item by (weight, id).",
    "qa_summary": "R6, A19: one PASS/FAIL/MANUAL/SKIP row per reconciliation report.",
    "dq_checks": "Q1-Q21: the data-quality checks over the whole clean -> metrics chain.",
    "dq_batches": "Q1-Q11 over batches, merged from written states without reading a batch again.",
    "kpi_card": "D1: baseline, best period, break period, total items per entity.",
    "break_marker": "D2: period line with the break flag.",
    "rolling_gap": "D3: rolling mean vs baseline with the gap.",
    "period_ranking": "D4: periods best to worst.",
    "score_distribution": "D5: exact quartiles of item scores per (entity, period).",
    "price_quartiles": "D5: exact quartiles of a high-cardinality value, with groups of a NULL period.",
    "clean_prejoined": "C2, J6: outcomes of the pre-joined mode with numbers written as decimals.",
    "score_histogram": "D5: items per (entity, period, score bucket).",
    "volatility": "D6: score spread per period.",
    "durability_rank": "D7: cross-entity durability rank.",
    "top_periods": "D8: best 5 periods per entity by value index.",
    "category_comparison": "D9: entities, mean durability and share broken per category.",
    "recovery": "D10: first period after the break back at or above the baseline.",
    "genre_agg": "D11: multi-valued attribute split and aggregated per value.",
    "input_gate": "S10, Q0: required columns present and non-empty inputs.",
    "extra_duplicates": "A13: rows beyond the first per item id.",
    "column_profile": "A15: min, max and NULL count per numeric fact column.",
    "subset_anti": "J13, U3, U4: fact item ids missing from the valid item types.",
    "key_set_equality": "U5: entity presence across KPI, dimension and selection.",
    "entity_item_counts": "A16: clean items per selected entity, 0 default.",
}
