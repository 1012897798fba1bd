"""Comparison of two copies of a table by digests.

Every row is hashed (two 64-bit hashes of all columns, with a mask of its NULLs) and dealt to one of
``buckets`` parts by its keys. A part's digest is the number of its rows and the sums of the pieces of
their hashes, so it depends neither on order nor on partitioning, and repeated rows count. Left rows add,
right rows subtract, in one partial aggregate: equal tables shuffle at most ``buckets`` sums a task and
nothing else. Only rows of parts whose sums aren't zero are compared row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize_observed

BUCKETS = 4096

# Pieces of a 64-bit hash: sums of pieces of at most 22 bits stay in a long up to 2**41 rows a part.
_PIECES = ((0, 22), (22, 21), (43, 21))
_BUCKET, _SIGN = "_tm_bucket", "_tm_sign"


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """Hash of a row. Spark's hash skips NULLs, so the mask tells (NULL, x) from (x, NULL)."""
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(F.lit(seed), mask, *[F.col(c) for c in columns])


def _pieces(columns: Sequence[str], seed: int) -> dict[str, Column]:
    h = row_hash(columns, seed)
    return {f"_h{seed}_{at}": F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) for at, bits in _PIECES}


def _signed(left: DataFrame, right: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    part = F.pmod(row_hash(keys, 0), F.lit(buckets)).cast("int").alias(_BUCKET)
    columns = left.columns
    sides = [df.select(*columns, part, F.lit(sign).cast("bigint").alias(_SIGN)) for df, sign in ((left, 1), (right, -1))]
    return sides[0].unionAll(sides[1])


def differing_buckets(left: DataFrame, right: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The parts (at most ``buckets``) whose multisets of rows differ."""
    return _differing(_signed(left, right, keys, buckets), left.columns)


def _differing(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    pieces = {**_pieces(columns, 1), **_pieces(columns, 2)}
    sums = [F.sum(F.col(_SIGN) * piece).alias(name) for name, piece in pieces.items()]
    parts = rows.groupBy(_BUCKET).agg(F.sum(_SIGN).alias("_rows"), *sums)
    unequal = F.col("_rows") != 0
    for name in pieces:
        unequal = unequal | (F.col(name) != 0)
    return parts.filter(unequal).select(_BUCKET)


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows that two tables don't share: the columns and ``surplus``, copies on the left less copies on the right.

    Both sides have the same columns (any order) of types that can be hashed and grouped. NULLs equal
    NULLs. Equal tables, also two empty ones, give no rows and read nothing a second time."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    columns = left.columns
    rows = _signed(left, right, keys, buckets)
    unequal, seen = materialize_observed(_differing(rows, columns))
    surplus = F.sum(_SIGN).alias("surplus")
    if seen["rows"] == 0:
        return rows.filter(F.lit(False)).groupBy(*columns).agg(surplus)
    # at most ``buckets`` numbers; a hot row collapses in the partial aggregate, a hot key spreads by its other columns
    suspect = rows.join(F.broadcast(unequal), _BUCKET, "left_semi")
    return suspect.groupBy(*columns).agg(surplus).filter("surplus <> 0")
