"""Per-period KPIs, break detection and durability.

Plan shape (see README "Plans"):

* ``period_base`` is one hash aggregate on (entity, period): partial
  aggregation runs map-side, so the shuffle carries one row per
  (entity, period) per map task, whatever the skew.
* ``with_trend`` runs on that small frame: one exchange on entity, one
  sort on (entity, period) shared by the baseline, rolling mean and lag
  windows. The baseline uses the ordered full frame so its summation
  order is fixed (a period series with <= 3 periods compares values that
  are mathematically equal; the order decides ``<``).
* ``SeriesTrend`` writes that frame once (Parquet in the shared checkpoint
  folder) as soon as an output needs a join decision; every later output
  (KPIs, break, durability, marts) reads the stored copy. Its exact row
  count drives the broadcast decisions. Outputs that only select from the
  frame stay one lazy plan.
* ``pct_high`` compares items with a baseline that is known only after all of
  them were read. ``counted_scores`` (grouping sets: one row per entity, period
  and distinct score, and one per entity and period) is written in one scan of
  the fact; the period frame, the share at or above the baseline, histograms and
  quartiles all come from that table. An
  entity with a third of all items has no more rows there than it has
  periods times scores, so the join with its baseline needs no salting.
  Scores are on a scale of steps; a fact of continuous scores gives a table as
  long as itself, which costs what a second scan would.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import share_pct, value_index, weighted_mean
from tidemark.operators.joins import MAX_BROADCAST_ROWS, attach
from tidemark.operators.segments import longest_series, segmented_rank, segmented_trend
from tidemark.schemas import SeriesCols
from tidemark.session import materialize, materialize_observed

# Label of an entity without a break (fixed value of the run report).
NO_BREAK_LABEL = "No break detected"


@dataclass(frozen=True)
class JoinPolicy:
    """``segment_rows``: an entity with more periods than this is split over several window tasks
    (``operators.segments``); the periods are then written and counted before the windows. None: one
    window task an entity."""

    max_broadcast_rows: int = MAX_BROADCAST_ROWS
    segment_rows: int | None = None


def _period_aggs(c: SeriesCols) -> list:
    s, w = F.col(c.score), F.col(c.weight)
    return [
        F.count(F.lit(1)).alias("item_count"),
        F.sum(w).alias("total_weight"),
        weighted_mean(s, w).alias("weighted_score"),
        F.avg(s).alias("mean_score"),
        F.stddev_samp(s).alias("score_stddev"),
    ]


def counted_scores(fact: DataFrame, c: SeriesCols = SeriesCols()) -> DataFrame:
    """Grouping sets of one scan: the aggregates of ``period_base`` per (entity, period) with ``_level`` 1
    and per (entity, period, score) with ``_level`` 0. Both add up item by item, so the rows of level 1 are
    those of ``period_base`` and never sums of sums."""
    keys = [F.col(k) for k in (c.entity, c.period, c.score)]
    return fact.groupingSets([keys, keys[:2]], *keys).agg(F.grouping(c.score).alias("_level"), *_period_aggs(c))


def score_counts(counted: DataFrame, c: SeriesCols = SeriesCols()) -> DataFrame:
    """One row per (entity, period, score) with its number of items, from ``counted_scores``."""
    return counted.filter("_level = 0").select(c.entity, c.period, c.score, F.col("item_count").alias("items"))


def period_base_of_counts(counted: DataFrame, c: SeriesCols = SeriesCols()) -> DataFrame:
    """``period_base`` from ``counted_scores``."""
    return counted.filter("_level = 1").drop(c.score, "_level")


def period_base(fact: DataFrame, c: SeriesCols = SeriesCols()) -> DataFrame:
    """One row per (entity, period)."""
    return fact.groupBy(c.entity, c.period).agg(*_period_aggs(c))


def with_trend(periods: DataFrame, c: SeriesCols = SeriesCols(), window: int = 3) -> DataFrame:
    """W1 baseline, W2 rolling mean, W5 below flag, W4 previous flag, previous period."""
    ordered = Window.partitionBy(c.entity).orderBy(F.col(c.period).asc_nulls_first())
    full = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rolling = ordered.rowsBetween(-(window - 1), Window.currentRow)
    wr = F.col("weighted_score")
    return (
        periods.withColumn("baseline", F.avg(wr).over(full))
        .withColumn("rolling_mean", F.avg(wr).over(rolling))
        .withColumn("below", F.when(F.col("rolling_mean") < F.col("baseline"), 1).otherwise(0))
        .withColumn("prev_below", F.lag("below").over(ordered))
        .withColumn("prev_period", F.lag(c.period).over(ordered))
    )


def with_rank(trend: DataFrame, c: SeriesCols = SeriesCols()) -> DataFrame:
    """W3 rank (ties share, gaps; NULL weighted score ranks last) and value index."""
    best_first = Window.partitionBy(c.entity).orderBy(F.col("weighted_score").desc_nulls_last())
    return trend.withColumn("period_rank", F.rank().over(best_first)).withColumn(
        "value_index", value_index("weighted_score", "total_weight")
    )


class SeriesTrend:
    """The period frame of one fact table; written once (lazily) and reused.

    Outputs that only select from the frame run as one lazy plan. The first
    output that needs a join decision writes the frame to the shared
    checkpoint folder and counts it; every later output reads that copy.
    """

    def __init__(self, fact: DataFrame, c: SeriesCols = SeriesCols(), policy: JoinPolicy = JoinPolicy(),
                 window: int = 3):
        self.fact = fact
        self.c = c
        self.policy = policy
        self._window = window
        self._segmented = False
        self._lazy: DataFrame | None = None
        self._counts: DataFrame | None = None
        self._stored: DataFrame | None = None
        self._rows: int | None = None

    def _trend(self, base: DataFrame) -> DataFrame:
        limit = self.policy.segment_rows
        if limit is not None:
            base, seen = materialize_observed(base)
            if seen["rows"] > limit and longest_series(base, self.c) > limit:
                self._segmented = True
                return segmented_trend(base, seen["rows"], self.c, self._window, limit)
        return with_trend(base, self.c, self._window)

    def ranked(self) -> DataFrame:
        """The frame with W3 rank and value index."""
        rows = self.rows
        if self._segmented:
            return segmented_rank(self.frame, rows, self.c, self.policy.segment_rows)
        return with_rank(self.frame, self.c)

    @property
    def frame(self) -> DataFrame:
        if self._stored is not None:
            return self._stored
        if self._lazy is None:
            self._lazy = self._trend(period_base(self.fact, self.c))
        return self._lazy

    @property
    def counts(self) -> DataFrame:
        """``score_counts``, written by one scan of the fact; a frame that isn't written yet comes from the same table."""
        if self._counts is None:
            counted = materialize(counted_scores(self.fact, self.c))
            self._counts = score_counts(counted, self.c)
            if self._stored is None and (self._lazy is None or not self._segmented):
                self._lazy = self._trend(period_base_of_counts(counted, self.c))
        return self._counts

    @property
    def rows(self) -> int:
        """Exact row count of the frame (materializes it once; the count is
        observed during the write, no extra pass)."""
        if self._rows is None:
            self._stored, seen = materialize_observed(self.frame)
            self._rows = int(seen["rows"])
        return self._rows

    # -- join helpers -------------------------------------------------
    def attach_per_entity(self, big: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        """Join ``big`` to a table with at most one row per trend row on entity."""
        return attach(big, table, [self.c.entity], how,
                      table_rows=self.rows, max_broadcast_rows=self.policy.max_broadcast_rows)

    def attach_per_period(self, big: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        """Join ``big`` to a table keyed by (entity, period) with <= trend rows."""
        rows = self.rows
        return attach(big, table, [self.c.entity, self.c.period], how,
                      table_rows=rows, max_broadcast_rows=self.policy.max_broadcast_rows)

    # -- outputs ------------------------------------------------------
    def high_counts(self) -> DataFrame:
        """A7 numerator: items per (entity, period) with score >= entity baseline, from the counted scores."""
        c = self.c
        counts = self.counts
        _ = self.rows  # materialize first so every branch reads the stored frame
        base = self.frame.groupBy(c.entity).agg(F.max("baseline").alias("_baseline"))
        high = F.sum(F.when(F.col(c.score) >= F.col("_baseline"), F.col("items")))
        return self.attach_per_entity(counts, base).groupBy(c.entity, c.period).agg(
            F.coalesce(high, F.lit(0).cast("bigint")).alias("high_count"))

    def kpis(self) -> DataFrame:
        """M3: the 12-column period KPI table (entities of the fact, dim not needed)."""
        c = self.c
        _ = self.counts, self.rows  # the one scan of the fact
        ranked = self.ranked()
        joined = self.attach_per_period(ranked, self.high_counts(), "left")
        return joined.select(
            c.entity,
            c.period,
            "item_count",
            "total_weight",
            "weighted_score",
            "mean_score",
            "score_stddev",
            share_pct(F.coalesce(F.col("high_count"), F.lit(0)), "item_count").alias("pct_high"),
            "baseline",
            "rolling_mean",
            "period_rank",
            "value_index",
        )

    def detected_breaks(self, strict: bool = False) -> DataFrame:
        """First period that starts two consecutive below-baseline periods.

        Parity form: ``min(period - 1)`` over rows where this and the previous
        existing period are below (assumes contiguous periods). Strict form:
        the real previous existing period.
        """
        c = self.c
        pair = (F.col("below") == 1) & (F.col("prev_below") == 1)
        start = F.col("prev_period") if strict else F.col(c.period) - F.lit(1)
        return self.frame.groupBy(c.entity).agg(F.min(F.when(pair, start)).alias("break_period"))

    def durable_counts(self) -> DataFrame:
        """Periods whose rolling mean is >= baseline (NULL not counted)."""
        c = self.c
        return self.frame.groupBy(c.entity).agg(
            F.count_if(F.col("rolling_mean") >= F.col("baseline")).alias("durability")
        )

    def break_period(self, dim: DataFrame, strict: bool = False) -> DataFrame:
        """M4: one row per dimension entity, NULL when no break."""
        c = self.c
        _ = self.rows
        return self.attach_per_entity(dim.select(c.entity), self.detected_breaks(strict), "left").select(
            c.entity, "break_period"
        )

    def durability(self, dim: DataFrame) -> DataFrame:
        """M5: one row per dimension entity, 0 by default."""
        c = self.c
        _ = self.rows
        return self.attach_per_entity(dim.select(c.entity), self.durable_counts(), "left").select(
            c.entity, F.coalesce(F.col("durability"), F.lit(0).cast("bigint")).alias("durability")
        )

    def summary(self, dim: DataFrame) -> DataFrame:
        """M6: periods per dim entity, break period with its label, durability."""
        c = self.c
        _ = self.rows
        per_entity = self.frame.groupBy(c.entity).agg(
            F.count(c.period).alias("period_count"),
            F.min(F.when((F.col("below") == 1) & (F.col("prev_below") == 1), F.col(c.period) - F.lit(1))).alias(
                "break_period"
            ),
            F.count_if(F.col("rolling_mean") >= F.col("baseline")).alias("durability"),
        )
        joined = self.attach_per_entity(dim.select(c.entity), per_entity, "left")
        return joined.select(
            c.entity,
            F.coalesce(F.col("period_count"), F.lit(0).cast("bigint")).alias("period_count"),
            "break_period",
            F.coalesce(F.col("break_period").cast("string"), F.lit(NO_BREAK_LABEL)).alias("break_label"),
            F.coalesce(F.col("durability"), F.lit(0).cast("bigint")).alias("durability"),
        )


def period_kpis(fact: DataFrame, c: SeriesCols = SeriesCols(), policy: JoinPolicy = JoinPolicy()) -> DataFrame:
    return SeriesTrend(fact, c, policy).kpis()


def break_period(fact: DataFrame, dim: DataFrame, c: SeriesCols = SeriesCols(), strict: bool = False,
                 policy: JoinPolicy = JoinPolicy()) -> DataFrame:
    return SeriesTrend(fact, c, policy).break_period(dim, strict)


def durability(fact: DataFrame, dim: DataFrame, c: SeriesCols = SeriesCols(),
               policy: JoinPolicy = JoinPolicy()) -> DataFrame:
    return SeriesTrend(fact, c, policy).durability(dim)
