"""Dashboard marts specified by the reference's design notes.

All marts select from the materialized period frame (``SeriesTrend``) or
aggregate the item fact with partial aggregation; per-entity joins go
through ``attach`` (broadcast only under a counted bound).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import MAX_BROADCAST_ROWS, attach
from tidemark.operators.metrics import SeriesTrend
from tidemark.operators.order_stats import grouped_quantiles

# Fixed values.
QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
TOP_N = 5


def kpi_card(t: SeriesTrend, dim: DataFrame) -> DataFrame:
    """Per dim entity: baseline, best period (rank 1, lowest period on ties),
    break period, total items."""
    c = t.c
    k = t.kpis()
    per = k.groupBy(c.entity).agg(
        F.max("baseline").alias("baseline"),
        F.min(F.when(F.col("period_rank") == 1, F.col(c.period))).alias("best_period"),
        F.sum("item_count").alias("total_items"),
    )
    out = t.attach_per_entity(dim.select(c.entity), per, "left")
    out = t.attach_per_entity(out, t.detected_breaks(), "left")
    return out.select(
        c.entity, "baseline", "best_period", "break_period",
        F.coalesce(F.col("total_items"), F.lit(0).cast("bigint")).alias("total_items"),
    )


def break_marker(t: SeriesTrend) -> DataFrame:
    """Period line with ``break_flag`` = 1 at the break period."""
    c = t.c
    _ = t.rows  # write the period frame first so both sides read the stored copy
    line = t.attach_per_entity(t.frame.select(c.entity, c.period, "weighted_score"), t.detected_breaks(), "left")
    return line.select(
        c.entity, c.period, "weighted_score",
        F.when(F.col(c.period) == F.col("break_period"), 1).otherwise(0).alias("break_flag"),
    )


def rolling_gap(t: SeriesTrend) -> DataFrame:
    """D3: rolling mean vs baseline with the gap."""
    c = t.c
    return t.frame.select(
        c.entity, c.period, "rolling_mean", "baseline",
        (F.col("rolling_mean") - F.col("baseline")).alias("gap"),
    )


def period_ranking(t: SeriesTrend) -> DataFrame:
    """Periods best to worst per entity."""
    c = t.c
    return t.kpis().select(c.entity, "period_rank", c.period, "weighted_score", "item_count")


QUARTILE_NAMES = ["score_min", "score_q1", "score_median", "score_q3", "score_max"]


def score_distribution(t: SeriesTrend) -> DataFrame:
    """Exact quartiles of the item scores per (entity, period) (box plot),
    linear interpolation between ranks like ``percentile``."""
    c = t.c
    return grouped_quantiles(t.counts, [c.entity, c.period], c.score, QUARTILES, QUARTILE_NAMES, times="items")


def score_histogram(t: SeriesTrend, width: float = 1.0) -> DataFrame:
    """Items per (entity, period, floor(score / width) bucket)."""
    c = t.c
    bucket = (F.floor(F.col(c.score) / F.lit(width)) * F.lit(width)).alias("bucket")
    return t.counts.groupBy(c.entity, c.period, bucket).agg(F.sum("items").alias("items"))


def volatility(t: SeriesTrend) -> DataFrame:
    """Score spread per period."""
    c = t.c
    return t.frame.select(c.entity, c.period, "score_stddev", "item_count")


def durability_rank(t: SeriesTrend, dim: DataFrame) -> DataFrame:
    """Durability across entities, rank 1 = most durable (ties share)."""
    return _global_rank(t.durability(dim), t.c.entity)


def _global_rank(d: DataFrame, entity: str) -> DataFrame:
    """Dense ordering of a one-row-per-entity table without a single-partition
    window: rank = 1 + number of entities with a strictly higher durability,
    computed from the (small, bounded) distribution of durability values."""
    dist = d.groupBy("durability").agg(F.count(F.lit(1)).alias("_n"))
    # durability is a small integer (<= number of periods): this frame is bounded.
    higher = dist.withColumn(
        "_higher",
        F.coalesce(
            F.sum("_n").over(Window.orderBy(F.col("durability").desc()).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).select("durability", (F.col("_higher") + 1).cast("int").alias("durability_rank"))
    return d.join(F.broadcast(higher), "durability", "left").select(entity, "durability", "durability_rank")


def top_periods(t: SeriesTrend, n: int = TOP_N) -> DataFrame:
    """Best ``n`` periods per entity by value index (ties -> lower period)."""
    c = t.c
    w = Window.partitionBy(c.entity).orderBy(F.col("value_index").desc_nulls_last(), F.col(c.period).asc())
    return (
        t.kpis()
        .withColumn("slot", F.row_number().over(w))
        .filter(F.col("slot") <= n)
        .select(c.entity, "slot", c.period, "value_index", "item_count")
    )


def category_comparison(t: SeriesTrend, dim: DataFrame, dim_rows: int | None = None) -> DataFrame:
    """Per category: entities, mean durability, share of entities with a break."""
    c = t.c
    per = t.summary(dim.select(c.entity))
    cat = dim.select(c.entity, "category")
    joined = attach(per, cat, [c.entity], "left", table_rows=dim_rows, max_broadcast_rows=MAX_BROADCAST_ROWS)
    return joined.groupBy("category").agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("durability").alias("mean_durability"),
        (F.count_if(F.col("break_period").isNotNull()) * F.lit(100.0) / F.count(F.lit(1))).alias("pct_broken"),
    )


def recovery(t: SeriesTrend, dim: DataFrame) -> DataFrame:
    """D10 (rule defined here, the design notes leave it open): first period
    after the break whose rolling mean is back at or above the baseline."""
    c = t.c
    _ = t.rows
    f = t.attach_per_entity(t.frame.select(c.entity, c.period, "rolling_mean", "baseline"),
                            t.detected_breaks(), "inner")
    rec = f.groupBy(c.entity).agg(
        F.min(
            F.when((F.col(c.period) > F.col("break_period")) & (F.col("rolling_mean") >= F.col("baseline")),
                   F.col(c.period))
        ).alias("recovery_period"),
        F.max("break_period").alias("break_period"),
    )
    out = t.attach_per_entity(dim.select(c.entity), rec, "left")
    return out.select(c.entity, "break_period", "recovery_period",
                      F.col("recovery_period").isNotNull().alias("recovered"))


def genre_agg(t: SeriesTrend, dim: DataFrame, dim_rows: int | None = None, sep: str = ",") -> DataFrame:
    """Split the multi-valued ``genres`` attribute and aggregate per genre."""
    c = t.c
    per = t.summary(dim.select(c.entity))
    g = dim.select(c.entity, F.explode_outer(F.split(F.col("genres"), sep)).alias("genre")).select(
        c.entity, F.trim(F.col("genre")).alias("genre")
    )
    joined = attach(g, per, [c.entity], "left", table_rows=dim_rows, max_broadcast_rows=MAX_BROADCAST_ROWS)
    return joined.groupBy("genre").agg(
        F.count_distinct(c.entity).alias("entities"),
        F.avg("durability").alias("mean_durability"),
        F.count_if(F.col("break_period").isNotNull()).alias("broken"),
    )
