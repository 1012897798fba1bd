"""Global order statistics without a single-partition sort.

* ``first_by`` / ``last_by``: one global aggregate of ``min(struct(...))``;
  partial aggregation keeps one candidate per map task.
* ``element_at_rank``: a mergeable quantile sketch brackets the rank, exact
  counts inside the bracket decide; nothing is sorted but the last bracket.
* ``grouped_quantiles``: identical keys collapse with a multiplicity (a hot
  key is one row), distinct keys are range-partitioned (sampled bounds, as many
  ranges as the counted rows need) and written to the shared checkpoint
  folder so partition ids are stable, per-range sizes give offsets, and
  ranks are taken inside ranges. One path at every size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize, materialize_observed


def _sort_struct(cols: Sequence[Column | str]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])


def first_by(df: DataFrame, order: Sequence[str | Column], columns: Sequence[str]) -> DataFrame:
    """The row that sorts first by ``order`` (one row; none for an empty input).

    ``order`` may contain expressions (e.g. a negated weight for descending)."""
    keyed = df.select(_sort_struct(order).alias("_k"), *columns)
    best = keyed.agg(F.min(F.struct("_k", *columns)).alias("_b"), F.count(F.lit(1)).alias("_n"))
    return best.filter(F.col("_n") > 0).select(*[F.col(f"_b.{c}").alias(c) for c in columns])


def first_by_each(df: DataFrame, orders: dict[str, Sequence[str | Column]], columns: Sequence[str],
                  label: str = "pick") -> DataFrame:
    """Several ``first_by`` picks from ONE scan and one global aggregate:
    one row per non-empty pick, tagged with its name in ``label``."""
    aggs = [
        F.min(F.struct(_sort_struct(order).alias("_k"), *columns)).alias(f"_b{i}")
        for i, order in enumerate(orders.values())
    ]
    best = df.agg(*aggs, F.count(F.lit(1)).alias("_n"))
    picks = F.array(*[
        F.struct(F.lit(name).alias(label), *[F.col(f"_b{i}.{c}").alias(c) for c in columns])
        for i, name in enumerate(orders)
    ])
    return best.filter(F.col("_n") > 0).select(F.explode(picks).alias("_p")).select("_p.*")


# Target rows of one range partition and of a bracket that one task may order.
ROWS_PER_TASK = 1_000_000
# Size of a sketch; its rank error is about 0.13% of the rows, and brackets reach three times as far.
_SKETCH_K, _REACH = 4096, 0.004


def _ordered(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


@dataclass(frozen=True)
class _Step:
    """One number per row, in the order of (a part of) a column. ``exact``: equal numbers are equal parts."""

    number: Column
    floating: bool = False
    exact: bool = True
    more: bool = False  # equal numbers may be followed by another part


def _step(name: str, kind: T.DataType, part: int) -> _Step:
    c = F.col(name)
    if isinstance(kind, T.IntegralType):
        return _Step(c.cast("bigint"))
    if isinstance(kind, T.BooleanType):
        return _Step(c.cast("int").cast("bigint"))
    if isinstance(kind, T.DateType):
        return _Step(F.unix_date(c).cast("bigint"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _Step(F.when(~F.isnan(c), c.cast("double")), floating=True)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # seven bytes and how many there are of them: in the order of the bytes
        piece = F.substring(c.cast("binary"), 7 * part + 1, 7)
        head = F.conv(F.rpad(F.hex(piece), 14, "0"), 16, 10).cast("bigint")
        return _Step(F.when(c.isNotNull(), head * 8 + F.octet_length(piece)), more=True)
    return _Step(c.cast("double"), floating=True, exact=False)  # order kept, near values may fall together


def element_at_rank(df: DataFrame, order: Sequence[str], fraction: float = 0.5,
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Row at 0-based index ``floor(n * fraction)`` of ``df`` sorted by ``order``
    (ascending, NULLs last). ``order`` should be a total order of the output
    columns; identical rows are interchangeable. Returns 0 or 1 row.

    A mergeable quantile sketch of the first column brackets the rank; a second
    scan counts exactly what lies below and inside and writes only the rows inside.
    Where they are more than one task may order (heavy ties), the same is done inside
    the bracket with the next part of the order (text counts seven bytes at a time), so a
    table takes two scans and every further round sees a fraction of the rows. Counts and
    sketches reach the driver; no rows do."""
    order = list(order)
    rows, target = df.select(*order), None
    column, part = 0, 0
    while True:
        step = _step(order[column], rows.schema[order[column]].dataType, part)
        sketch = F.kll_sketch_agg_double if step.floating else F.kll_sketch_agg_bigint
        keyed = rows.withColumn("_x", step.number)
        seen = keyed.agg(F.count(F.lit(1)).alias("n"), F.count("_x").alias("m"), F.count(order[column]).alias("known"),
                         F.min("_x").alias("least"), F.max("_x").alias("most"), sketch("_x", F.lit(_SKETCH_K)).alias("sketch")).first()
        n, m, known = seen["n"], seen["m"], seen["known"]
        if target is None:
            if n == 0:
                return rows.filter(F.lit(False))
            target = min(int(n * fraction), n - 1)
        if n <= rows_per_task or column == len(order) - 1 and known == 0:
            return rows.orderBy(*_ordered(order)).offset(target).limit(1)
        if target >= m:  # behind all numbers: not-a-number, then NULL
            nan = known - m
            special = F.col("_x").isNull() & (F.col(order[column]).isNotNull() if target < known else F.col(order[column]).isNull())
            target -= m if target < known else m + nan
            rows, column, part = keyed.filter(special).select(*order), column + 1, 0
        elif seen["least"] != seen["most"]:
            inside, count, target = _bracket(keyed, seen["sketch"], step, target, m)
            rows = inside.select(*order)
            if count <= rows_per_task:
                return rows.orderBy(*_ordered(order)).offset(target).limit(1)
            if count == n:  # too few numbers for a bracket
                return _range_select(rows, order, target, n, rows_per_task)
        elif not step.exact:
            return _range_select(keyed.filter(F.col("_x").isNotNull()).select(*order), order, target, m, rows_per_task)
        else:
            rows = keyed.filter(F.col("_x").isNotNull()).select(*order)
            length = F.octet_length(F.col(order[column]).cast("binary"))
            longer = step.more and rows.agg(F.max(length)).first()[0] > 7 * (part + 1)
            column, part = (column, part + 1) if longer else (column + 1, 0)
        if column == len(order):  # all rows left are equal
            return rows.limit(1)


def _bracket(keyed: DataFrame, sketch, step: _Step, target: int, m: int) -> tuple[DataFrame, int, int]:
    """(rows around ``target``, their count, the rank among them) of ``keyed``, whose ``m`` numbers ``_x`` the
    ``sketch`` describes. The rows are written, unless they share one number: heavy ties are only counted."""
    read = F.kll_sketch_get_quantile_double if step.floating else F.kll_sketch_get_quantile_bigint
    reach = _REACH
    while True:
        ends = [max(0.0, target / m - reach), min(1.0, (target + 1) / m + reach)]  # 0 and 1 are the exact ends
        low, high = keyed.sparkSession.range(1).select(
            read(F.lit(bytes(sketch)), F.array(*[F.lit(e) for e in ends])).alias("q")).first()["q"]
        within = F.col("_x").between(F.lit(low), F.lit(high))
        counts = {"below": F.count_if(F.col("_x") < F.lit(low)), "inside": F.count_if(within)}
        if low == high:
            inside, seen = keyed.filter(within), keyed.agg(*[c.alias(k) for k, c in counts.items()]).first()
        else:
            counted = Observation()
            inside = materialize(keyed.observe(counted, *[c.alias(k) for k, c in counts.items()]).filter(within))
            seen = counted.get
        before, count = int(seen["below"]), int(seen["inside"])
        if before <= target < before + count:
            return inside, count, target - before
        reach *= 4  # the sketch was off by more than it promises


def _by_range(keyed: DataFrame, order: Sequence[str], rows: int, rows_per_task: int) -> DataFrame:
    """``keyed`` (``rows`` distinct keys) dealt into ranges of ``order`` and written, so that the
    partition numbers ``_pid`` are stable."""
    partitions = max(1, -(-rows // rows_per_task))
    return materialize(keyed.repartitionByRange(partitions, *_ordered(order)).withColumn("_pid", F.spark_partition_id()))


def _range_select(rows: DataFrame, order: list[str], k: int, n: int, rows_per_task: int) -> DataFrame:
    """Row ``k`` of ``rows`` (``n`` rows) by ranges of equal keys: range sizes give offsets (a window over
    as many rows as ranges) and only the range that holds ``k`` is ordered."""
    ranged = _by_range(rows.groupBy(*order).agg(F.count(F.lit(1)).alias("_m")), order, n, rows_per_task)
    sizes = ranged.groupBy("_pid").agg(F.sum("_m").alias("_size"))
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(prior), F.lit(0))).filter(
        (F.col("_start") <= k) & (F.lit(k) < F.col("_start") + F.col("_size"))
    )
    inside = Window.partitionBy("_pid").orderBy(*_ordered(order)).rowsBetween(Window.unboundedPreceding, -1)
    cand = ranged.join(F.broadcast(offsets), "_pid").withColumn(  # offsets: one row
        "_before", F.col("_start") + F.coalesce(F.sum("_m").over(inside), F.lit(0))
    )
    return cand.filter((F.col("_before") <= k) & (F.lit(k) < F.col("_before") + F.col("_m"))).select(*order)


def grouped_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float],
                      names: Sequence[str], rows_per_task: int = ROWS_PER_TASK, times: str | None = None) -> DataFrame:
    """Exact per-group quantiles (linear interpolation between ranks, like
    ``percentile``). NULL values are ignored; NULL group keys form groups.
    ``times`` names a column that says how often a row counts (default: once).

    Values are counted per (group, value) with partial aggregation; the
    distinct pairs are range-partitioned by (group, value) and written, so a
    hot group spans several balanced ranges. Per-(group, range) sizes give each
    chunk's offset inside its group, ranks inside a chunk come from a window
    over that chunk only, and the values at the needed ranks are picked by one
    partial-aggregating ``groupBy``."""
    group = list(group)
    hist, seen = materialize_observed(
        df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_m"))
    )
    ranged = _by_range(hist, [*group, value], seen["rows"], rows_per_task)
    chunks = ranged.groupBy(*group, "_pid").agg(F.sum("_m").alias("_s"))
    by_group = Window.partitionBy(*group)
    prior = by_group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        *[F.col(g).alias(f"_c{i}") for i, g in enumerate(group)],
        F.col("_pid").alias("_chunk"),
        F.coalesce(F.sum("_s").over(prior), F.lit(0)).alias("_off"),
        F.sum("_s").over(by_group).alias("_n"),
    )
    inside = Window.partitionBy(*group, "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("_local", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
    same = F.col("_pid") == F.col("_chunk")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_c{i}"))
    first_rank = F.col("_off") + F.col("_local")
    return _pick_quantiles(ranked.join(chunks, same), group, value, probs, names, first_rank,
                           first_rank + F.col("_m") - 1)


def _pick_quantiles(ranked: DataFrame, group: list[str], value: str, probs: Sequence[float],
                    names: Sequence[str], first_rank: Column, last_rank: Column) -> DataFrame:
    """Values at the interpolation ranks of each group, from rows annotated
    with their rank range and the group size ``_n`` (one partial aggregate)."""

    def value_at(rank: Column) -> Column:
        return F.max(F.when((first_rank <= rank) & (rank <= last_rank), F.col(value)))

    aggs = []
    for i, q in enumerate(probs):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        aggs += [value_at(F.floor(pos)).alias(f"_lo{i}"), value_at(F.ceil(pos)).alias(f"_hi{i}"),
                 F.max(pos).alias(f"_pos{i}")]
    per = ranked.groupBy(*group).agg(*aggs)
    outs = []
    for i, name in enumerate(names):
        lo, hi, pos = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_pos{i}")
        frac = pos - F.floor(pos)
        outs.append(F.when(frac == 0, lo).otherwise((F.lit(1.0) - frac) * lo + frac * hi).alias(name))
    return per.select(*group, *outs)
