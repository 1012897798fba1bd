"""Ordered windows over entities with very many rows, by segments.

A window partitioned by entity is one task an entity. Here (entity, order) ranges of about
``rows_per_task`` rows are written first, so an entity of any length spans as many segments as
it needs, and what crosses a border is carried:

* rows: the last ``window`` rows before a segment come along as its context, which is all that a
  rolling frame of ``window`` rows and the flag of the row before look at;
* sums: a segment's ordered sum and count; an entity's mean adds its segments in order;
* ranks: rows with equal keys never straddle ranges, so a rank is the rank inside the range plus
  the entity's rows in earlier ranges.

An entity that lies in one segment gets the very values of the plain window. What is broadcast
belongs to entities that cross a border: at most two segments a range, hence a few rows a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import safe_ratio, value_index
from tidemark.schemas import SeriesCols
from tidemark.session import materialize

ROWS_PER_TASK = 1_000_000

_SEG, _N, _RN, _SUM, _CNT = "_seg", "_seg_rows", "_seg_row", "_seg_sum", "_seg_count"
_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


def longest_series(periods: DataFrame, c: SeriesCols = SeriesCols()) -> int:
    """Rows of the entity with most rows (exact; one partial aggregate)."""
    return periods.groupBy(c.entity).count().agg(F.max("count")).first()[0] or 0


def _ranges(df: DataFrame, order: list[Column], rows: int, rows_per_task: int) -> DataFrame:
    """``df`` dealt into ranges of ``order`` and written, so that segment numbers are stable when tasks repeat."""
    ranges = max(1, -(-rows // rows_per_task))
    return materialize(df.repartitionByRange(ranges, *order).withColumn(_SEG, F.spark_partition_id()))


def _beside(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a small table on keys that may be NULL."""
    renamed = small.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(F.broadcast(renamed), same, "left").drop(*[f"_r_{k}" for k in keys])


def segmented_trend(periods: DataFrame, rows: int, c: SeriesCols = SeriesCols(), window: int = 3,
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The columns of ``metrics.with_trend`` for a frame of ``rows`` rows (one per entity and period)."""
    e, p, wr = c.entity, c.period, F.col("weighted_score")
    by_period = F.col(p).asc_nulls_first()
    ranged = _ranges(periods, [F.col(e), by_period], rows, rows_per_task)
    inside = Window.partitionBy(e, _SEG).orderBy(by_period)
    whole = inside.rowsBetween(_FIRST, _LAST)

    # sums and last rows of the segments; only entities of several segments matter further on
    counted = ranged.select(e, p, "weighted_score", _SEG).withColumns({
        _RN: F.row_number().over(inside), _N: F.count(F.lit(1)).over(whole), _SUM: F.sum(wr).over(whole), _CNT: F.count(wr).over(whole)})
    tails = counted.filter(F.col(_N) - F.col(_RN) < window)
    segments = Window.partitionBy(e).orderBy(_SEG).rowsBetween(_FIRST, _LAST)
    ends = tails.filter(F.col(_RN) == F.col(_N)).withColumns({
        "_segments": F.count(F.lit(1)).over(segments),
        "_mean": safe_ratio(F.sum(_SUM).over(segments), F.sum(_CNT).over(segments))}).filter("_segments > 1")
    crossing = materialize(ends.select(e, _SEG, "_mean"))
    means = crossing.groupBy(e).agg(F.max("_mean").alias("_mean"), F.lit(True).alias("_crosses"))

    # the rows before a segment, found at the first of its own last rows: all that precede are earlier segments'
    before = Window.partitionBy(e).orderBy(_SEG, by_period).rowsBetween(-window, -1)
    row = F.struct(F.col(p).alias("_p"), wr.alias("_w"))
    context = (
        _beside(tails, means, [e]).filter("_crosses")
        .withColumn("_before", F.collect_list(row).over(before))
        .filter(F.col(_RN) == F.greatest(F.lit(1), F.col(_N) - F.lit(window - 1)))
        .select(e, _SEG, F.explode("_before").alias("_b"))
        .select(e, _SEG, F.col("_b._p").alias(p), F.col("_b._w").alias("weighted_score"), F.lit(True).alias("_context"))
    )

    own = Window.partitionBy(e, _SEG).orderBy(by_period)
    every = own.rowsBetween(_FIRST, _LAST)
    mine = F.when(F.col("_context").isNull(), wr)
    rows_and_context = ranged.withColumn("_context", F.lit(None).cast("boolean")).unionByName(context, allowMissingColumns=True)
    seen = rows_and_context.withColumns({
        "rolling_mean": F.avg(wr).over(own.rowsBetween(-(window - 1), Window.currentRow)),
        _SUM: F.sum(mine).over(every), _CNT: F.count(mine).over(every), "prev_period": F.lag(p).over(own)})
    based = _beside(seen, means, [e]).withColumn(
        "baseline", F.when(F.col("_crosses"), F.col("_mean")).otherwise(safe_ratio(F.col(_SUM), F.col(_CNT))))
    flagged = based.withColumn("below", F.when(F.col("rolling_mean") < F.col("baseline"), 1).otherwise(0))
    return (
        flagged.withColumn("prev_below", F.lag("below").over(own))
        .filter(F.col("_context").isNull())
        .select(*periods.columns, "baseline", "rolling_mean", "below", "prev_below", "prev_period")
    )


def segmented_rank(trend: DataFrame, rows: int, c: SeriesCols = SeriesCols(), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The columns of ``metrics.with_rank`` (ties share a rank, NULL scores last)."""
    best_first = F.col("weighted_score").desc_nulls_last()
    ranged = _ranges(trend, [F.col(c.entity), best_first], rows, rows_per_task)
    prior = Window.partitionBy(c.entity).orderBy(_SEG).rowsBetween(_FIRST, -1)
    offsets = ranged.groupBy(c.entity, _SEG).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_earlier", F.sum("_rows").over(prior))
    offsets = offsets.filter("_earlier > 0").select(c.entity, _SEG, "_earlier")
    local = F.rank().over(Window.partitionBy(c.entity, _SEG).orderBy(best_first))
    ranked = _beside(ranged.withColumn("_local", local), offsets, [c.entity, _SEG])
    return ranked.withColumn("period_rank", (F.col("_local") + F.coalesce(F.col("_earlier"), F.lit(0))).cast("int")).select(
        *trend.columns, "period_rank", value_index("weighted_score", "total_weight").alias("value_index"))
