"""Equi-joins whose hot keys are split by what a sketch counted.

``heavy_hitters`` is a frequent-items sketch (space saving with merged partials, built into
Spark) that runs as an observed metric while a side is written, so it costs no pass.
``salts`` turns its counts into a number of parts per key: a key with n rows gets
``n / limit`` parts, where the limit is a share of the side, hence at most ``HOT_SHARES``
keys are hot and the lists stay small whatever the data.

``split_join`` deals a hot key's rows over a grid: with a parts on the left and b on the right,
a left row goes to one of a rows of the grid and to all b columns, a right row to one
column and all a rows, so every pair meets exactly once and no task holds a whole hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARES = 256  # a key is hot beyond 1/HOT_SHARES of its side's rows ...
MIN_PART_ROWS = 100_000  # ... if that is more than one small task
_TRACKED = 8192  # counters of the sketch: counts are wrong by less than 1/4000 of the rows

_ROW, _LEFT, _RIGHT, _I, _J = "_tm_row", "_tm_left", "_tm_right", "_tm_i", "_tm_j"


def heavy_hitters(key: Column) -> Column:
    """Frequent values of ``key`` with their (slightly low) counts: array of (item, count)."""
    return F.call_function("approx_top_k", key, F.lit(HOT_SHARES), F.lit(_TRACKED))


def salts(hitters, rows: int, min_part_rows: int = MIN_PART_ROWS) -> dict:
    """{key: parts} of the hot keys among the collected ``hitters`` of a side of ``rows`` rows."""
    limit = max(rows / HOT_SHARES, min_part_rows)
    return {h["item"]: -int(-h["count"] // limit) for h in hitters or () if h["item"] is not None and h["count"] > limit}


@dataclass(frozen=True)
class Split:
    """Parts per hot key of the left and the right side of a join on one column."""

    left: dict
    right: dict

    def __bool__(self) -> bool:
        return bool(self.left or self.right)

    def table(self, df: DataFrame, column: str) -> DataFrame:
        keys = sorted(set(self.left) | set(self.right))
        schema = T.StructType([T.StructField(column, df.schema[column].dataType), T.StructField(_LEFT, T.IntegerType()), T.StructField(_RIGHT, T.IntegerType())])
        return df.sparkSession.createDataFrame([(k, self.left.get(k, 1), self.right.get(k, 1)) for k in keys], schema)


def _parts(df: DataFrame, column: str, split: Split) -> DataFrame:
    """``df`` with the parts of each row's key (1 for keys that aren't hot); the list holds at most 2 * HOT_SHARES keys."""
    hot = F.broadcast(split.table(df, column))
    return df.join(hot, column, "left").withColumns({c: F.coalesce(F.col(c), F.lit(1)) for c in (_LEFT, _RIGHT)})


def _every(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def _one(count: Column) -> Column:
    # a row's place in its partition: rows that agree in every column are spread, too. Any choice is right.
    return F.pmod(F.col(_ROW), count).cast("int")


def split_join(left: DataFrame, right: DataFrame, column: str, split: Split, how: str = "inner",
               right_flag: str | None = None, per_key: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``column`` (``inner`` or ``left``), hot keys on a grid.

    A left join needs ``right_flag``, a column of ``right`` that is never NULL. ``per_key`` (at most one
    row per key) is left-joined to the result on the same grid, without another exchange of it.
    The sides should be written tables or scans: a repeated task must read their rows in the same order."""
    if not split:
        out = left.join(right, column, how)
        return out if per_key is None else out.join(per_key, column, "left")
    grid = [column, _I, _J]
    lefts = _parts(left.withColumn(_ROW, F.monotonically_increasing_id()), column, split)
    lefts = lefts.withColumn(_I, _one(F.col(_LEFT))).withColumn(_J, _every(F.col(_RIGHT))).drop(_ROW, _LEFT)
    rights = _parts(right.withColumn(_ROW, F.monotonically_increasing_id()), column, split)
    rights = rights.withColumn(_J, _one(F.col(_RIGHT))).withColumn(_I, _every(F.col(_LEFT))).drop(_ROW, _LEFT, _RIGHT)
    out = lefts.join(rights, grid, how)
    if how == "left":
        # a key with several columns has right rows, so a copy of its left row that met none is spurious
        out = out.filter(F.col(right_flag).isNotNull() | (F.col(_RIGHT) == 1))
    if per_key is not None:
        keyed = _parts(per_key, column, split).withColumn(_I, _every(F.col(_LEFT))).withColumn(_J, _every(F.col(_RIGHT))).drop(_LEFT, _RIGHT)
        out = out.join(keyed, grid, "left")
    return out.drop(_I, _J, _RIGHT)
