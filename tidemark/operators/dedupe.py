"""De-duplication and duplicate-key reports.

All three are hash aggregates with map-side partial aggregation, so a key
that holds a third of all rows is reduced inside each map task before the
shuffle. A window ``row_number() = 1`` would instead send every copy of a
hot key to one task, so it is not used for de-duplication.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key; the row that sorts first by ``order`` then by the
    remaining columns wins, NULLs last (a total, file-order-free rule)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    ordered = list(order) + rest
    if not ordered:
        return df.select(*keys).distinct()
    # NULLs last, so a complete row beats one with gaps
    keyed = [x for i, c in enumerate(ordered) for x in (F.col(c).isNull().alias(f"_null{i}"), F.col(c))]
    first = F.min(F.struct(*keyed)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in ordered]).select(
        *df.columns
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys seen more than once, with their count. NULL keys are
    left out, like a value count."""
    keys = list(keys)
    not_null = None
    for k in keys:
        cond = F.col(k).isNotNull()
        not_null = cond if not_null is None else not_null & cond
    return (
        df.filter(not_null)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") > 1)
    )


def extra_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key (NULL keys compare equal here).
    One row: (row_count, distinct_keys, extra_rows)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("extra_rows"),
    )
