"""Reconciliation reports (R1-R6; A10, A11, A18, J11, J12, O3-O6, U6, W8).

Each report is a DataFrame; the run summary (R6) turns their tallies into
one row per check. Per-entity tables (titles, chosen periods) are joined
with ``attach``: broadcast only under a counted bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import safe_ratio, within_tolerance
from tidemark.operators.dedupe import duplicate_keys
from tidemark.operators.joins import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, SALTS_COLUMN, attach, row_bytes
from tidemark.operators.order_stats import element_at_rank, first_by_each
from tidemark.operators.skew import HOT_SHARES, MIN_PART_ROWS
from tidemark.schemas import SeriesCols

# Fixed values of the reports.
SUMMARY_ITEM = "SUMMARY"
ZERO_WEIGHT_NOTE = "sum_weight=0"
TOLERANCE = 0.01
SUSPICIOUS_BREAKS = (1, 2)


def _titled(df: DataFrame, titles: DataFrame, entity: str, titles_rows: int | None) -> DataFrame:
    t = titles.select(entity, "title")
    return attach(df, t, [entity], "left", table_rows=titles_rows, max_broadcast_rows=MAX_BROADCAST_ROWS)


def reconcile_counts(items: DataFrame, kpis: DataFrame, titles: DataFrame, c: SeriesCols = SeriesCols(),
                     titles_rows: int | None = None) -> DataFrame:
    """Items per (entity, period) counted two ways, full outer join.

    ``diff`` uses -1 for a missing side (5 vs missing -> 6); the side
    columns stay NULL; ``match`` is ``diff = 0``."""
    e, p = c.entity, c.period
    a = items.groupBy(e, p).agg(F.count(F.lit(1)).alias("count_from_items"))
    b = kpis.select(e, p, F.col("item_count").alias("count_from_kpis"))
    m = a.join(b, [e, p], "full_outer")
    diff = F.coalesce("count_from_items", F.lit(-1)) - F.coalesce("count_from_kpis", F.lit(-1))
    m = m.withColumn("diff", diff).withColumn("match", F.col("diff") == 0)
    return _titled(m, titles, e, titles_rows).select(
        e, "title", p, "count_from_items", "count_from_kpis", "diff", "match"
    )


def spot_check_periods(kpis: DataFrame, c: SeriesCols = SeriesCols()) -> DataFrame:
    """One period per entity: not period 1 when another exists, most items,
    then lowest period."""
    e, p = c.entity, c.period
    pick = Window.partitionBy(e).orderBy(
        F.when(F.col(p) == 1, 1).otherwise(0).asc(), F.col("item_count").desc(), F.col(p).asc()
    )
    return (
        kpis.withColumn("_rn", F.row_number().over(pick))
        .filter(F.col("_rn") == 1)
        .select(e, p, F.col("weighted_score").alias("kpi_weighted_score"))
    )


def spot_check(items: DataFrame, kpis: DataFrame, titles: DataFrame, c: SeriesCols = SeriesCols(),
               kpi_rows: int | None = None, titles_rows: int | None = None,
               tolerance: float = TOLERANCE, max_broadcast_rows: int = MAX_BROADCAST_ROWS,
               hot_rows: int | None = None) -> DataFrame:
    """R2: per-item detail of the chosen period plus one SUMMARY row per entity
    that recomputes the weighted mean and compares it with the KPI value.

    The chosen periods (one per entity) are broadcast into the item pass
    when the KPI table is within bound; otherwise the join shuffles and a
    period of more than ``hot_rows`` items (by the KPI item counts; by default a share
    of all items, so at most ``HOT_SHARES`` periods) is dealt over salts, one per ``hot_rows``."""
    e, p = c.entity, c.period
    chosen = spot_check_periods(kpis, c)
    hot = None
    if kpi_rows is None or kpi_rows > max_broadcast_rows or kpi_rows * row_bytes(chosen.schema) > MAX_BROADCAST_BYTES:
        if hot_rows is None:
            total = kpis.agg(F.coalesce(F.sum("item_count"), F.lit(0))).first()[0]
            hot_rows = max(MIN_PART_ROWS, total // HOT_SHARES)
        hot = kpis.filter(F.col("item_count") > F.lit(hot_rows)).select(
            e, p, F.ceil(F.col("item_count") / F.lit(hot_rows)).cast("int").alias(SALTS_COLUMN))
    detail = attach(items.select(e, p, c.item, c.ordinal, c.score, c.weight), chosen, [e, p], "inner",
                    table_rows=kpi_rows, max_broadcast_rows=max_broadcast_rows,
                    hot_keys=hot, salt_by=[c.item, c.ordinal, c.score, c.weight])
    detail = detail.withColumn("score_x_weight", F.col(c.score) * F.col(c.weight))
    sums = detail.groupBy(e, p, "kpi_weighted_score").agg(
        F.sum("score_x_weight").alias("sum_score_x_weight"),
        F.sum(c.weight).alias("sum_weight"),
    )
    manual = safe_ratio("sum_score_x_weight", "sum_weight")
    summary = sums.select(
        e,
        p,
        F.lit(SUMMARY_ITEM).alias(c.item),
        F.col("sum_weight").alias(c.weight),
        F.col("sum_score_x_weight").alias("score_x_weight"),
        F.lit(True).alias("is_summary"),
        "sum_score_x_weight",
        "sum_weight",
        manual.alias("manual_weighted_score"),
        "kpi_weighted_score",
        F.abs(manual - F.col("kpi_weighted_score")).alias("diff"),
        F.coalesce(within_tolerance(manual, "kpi_weighted_score", tolerance), F.lit(False)).alias("pass"),
        F.when(F.col("sum_weight") == 0, F.lit(ZERO_WEIGHT_NOTE)).otherwise(F.lit("")).alias("note"),
    )
    rows = detail.drop("kpi_weighted_score").withColumn("is_summary", F.lit(False))
    both = rows.unionByName(summary, allowMissingColumns=True)
    titled = _titled(both, titles, e, titles_rows).withColumn(
        "title", F.coalesce(F.col("title"), F.col(e).cast("string"))  # J12: unknown title -> the id
    )
    return titled.select(
        e, "title", p, c.item, c.ordinal, c.score, c.weight, "score_x_weight", "is_summary",
        "sum_score_x_weight", "sum_weight", "manual_weighted_score", "kpi_weighted_score", "diff", "pass", "note",
    )


def items_per_entity(items: DataFrame, entities: DataFrame, c: SeriesCols = SeriesCols(),
                     entity_rows: int | None = None) -> DataFrame:
    """Clean items per listed entity, 0 when it has none (one partial
    aggregate over the items, then a join to the entity list)."""
    counts = items.groupBy(c.entity).agg(F.count(F.lit(1)).alias("items"))
    out = attach(entities.select(c.entity), counts, [c.entity], "left", table_rows=entity_rows,
                 max_broadcast_rows=MAX_BROADCAST_ROWS)
    return out.select(c.entity, F.coalesce(F.col("items"), F.lit(0).cast("bigint")).alias("items"))


def duplicate_items(items: DataFrame, c: SeriesCols = SeriesCols()) -> DataFrame:
    """Item ids seen more than once."""
    return duplicate_keys(items, [c.item])


def break_sanity(breaks: DataFrame, kpis: DataFrame, titles: DataFrame, c: SeriesCols = SeriesCols(),
                 titles_rows: int | None = None, kpi_rows: int | None = None) -> DataFrame:
    """A break at period 1 or 2 is suspicious; ``total_periods`` is the
    highest period number (not a count)."""
    e, p = c.entity, c.period
    total = kpis.groupBy(e).agg(F.max(p).alias("total_periods"))
    m = attach(breaks.select(e, "break_period"), total, [e], "left", table_rows=kpi_rows,
               max_broadcast_rows=MAX_BROADCAST_ROWS)
    flag = F.coalesce(F.col("break_period").isin(*SUSPICIOUS_BREAKS), F.lit(False))
    return _titled(m, titles, e, titles_rows).select(
        e, "title", "break_period", "total_periods", flag.alias("flag_suspicious")
    )


def weight_extremes(items: DataFrame, titles: DataFrame, c: SeriesCols = SeriesCols(),
                    link_prefix: str = "https://example.org/item/", titles_rows: int | None = None) -> DataFrame:
    """Lowest, median (index floor(n/2)) and highest item by (weight, item id);
    ties on the highest weight go to the lowest id. The same item may appear
    twice when n <= 2. Blank columns are left for a manual check."""
    cols = [c.weight, c.item, c.entity, c.period, c.ordinal, c.score]
    unknown = F.col(c.weight).isNull()  # a missing weight is neither lowest nor highest
    lowest_order = [unknown.alias("_null"), *[F.col(x) for x in cols]]
    highest_order = [unknown.alias("_null"), (-F.col(c.weight)).alias("_w"), *[F.col(x) for x in cols[1:]]]
    ends = first_by_each(items, {"lowest": lowest_order, "highest": highest_order}, cols)
    median = element_at_rank(items.select(*cols), cols, 0.5).withColumn("pick", F.lit("median"))
    picks = ends.unionByName(median)
    out = _titled(picks, titles, c.entity, titles_rows)
    return out.select(
        c.item,
        "title",
        c.period,
        c.ordinal,
        c.weight,
        F.concat(F.lit(link_prefix), F.col(c.item), F.lit("/")).alias("link"),
        F.lit("").alias("checked_weight"),
        F.lit("").alias("notes"),
        "pick",
    )


def qa_summary(counts: DataFrame, spot: DataFrame, dups: DataFrame, sanity: DataFrame,
               is_sample: bool) -> DataFrame:
    """One row per report: (check, result, detail). The weight check is a
    human step: MANUAL on real data, SKIP on synthetic data, never PASS."""
    def tally(df, ok_expr, label_ok, label_bad, name):
        t = df.agg(F.count_if(ok_expr).alias("_ok"), F.count_if(~ok_expr).alias("_bad"))
        return t.select(
            F.lit(name).alias("check"),
            F.when(F.col("_bad") == 0, "PASS").otherwise("FAIL").alias("result"),
            F.concat(F.col("_ok").cast("string"), F.lit(f" {label_ok}, "), F.col("_bad").cast("string"),
                     F.lit(f" {label_bad}")).alias("detail"),
        )

    r1 = tally(counts, F.coalesce(F.col("match"), F.lit(False)), "matched", "mismatched", "count_reconciliation")
    r2 = tally(spot.filter("is_summary"), F.col("pass"), "passed", "failed", "weighted_mean_check")
    n_dup = dups.agg(F.count(F.lit(1)).alias("_n"))
    r3 = n_dup.select(
        F.lit("duplicate_check").alias("check"),
        F.when(F.col("_n") == 0, "PASS").otherwise("FAIL").alias("result"),
        F.concat(F.col("_n").cast("string"), F.lit(" duplicate item ids")).alias("detail"),
    )
    r4 = tally(sanity, ~F.col("flag_suspicious"), "OK", "suspicious (period 1 or 2)", "break_sanity")
    mode = "SKIP" if is_sample else "MANUAL"
    detail = "Synthetic data: skip manual check" if is_sample else "3 items selected for manual check"
    r5 = counts.sparkSession.range(1).select(
        F.lit("weight_check").alias("check"), F.lit(mode).alias("result"), F.lit(detail).alias("detail")
    )
    return r1.unionByName(r2).unionByName(r3).unionByName(r4).unionByName(r5)
