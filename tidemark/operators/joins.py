"""Join strategies for attaching a per-key table to a large fact.

Rules applied everywhere in the package:

* A side is broadcast only when its row count is known (it comes from a
  materialized small frame, so the check is cheap and exact) and both the rows
  and their bytes are within bound. Bytes follow the schema: fixed-width
  columns count as they are, a string as ``STRING_BYTES``.
* Beyond that bound the join shuffles. Keys that hold a large share of the
  fact ("hot" keys, e.g. one entity with a third of all rows) are split:
  their fact rows get a deterministic salt and their table rows are
  replicated once per salt, so no single task receives a hot key's rows. The
  list of hot keys carries each key's number of salts, made from its counted rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Defaults (tunable per call).
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20
STRING_BYTES = 64

SALTS_COLUMN = "_tm_salts"
_SALT = "_tm_salt"


def row_bytes(schema: T.StructType) -> int:
    """About the bytes of a row in a hash table: a header and eight bytes a column, more for text."""
    return 32 + sum(8 + (STRING_BYTES if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 0) for f in schema.fields)


def attach(
    big: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    table_rows: int | None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    hot_keys: DataFrame | None = None,
    salt_by: Sequence[str] | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join ``big`` to ``table`` (one row per key) on ``keys``.

    ``table_rows``: exact row count of ``table`` (None = unknown: never broadcast).
    ``hot_keys``: bounded frame of the keys that need splitting and ``SALTS_COLUMN``, the number
    of their salts (shuffle path only).
    ``salt_by``: columns of ``big`` hashed to spread a hot key's rows.
    """
    keys = list(keys)
    if (table_rows is not None and table_rows <= max_broadcast_rows
            and table_rows * row_bytes(table.schema) <= max_broadcast_bytes):
        return big.join(F.broadcast(table), keys, how)
    if hot_keys is None or not salt_by:
        return big.join(table, keys, how)

    hot = F.broadcast(hot_keys.select(*keys, SALTS_COLUMN))
    salts = F.coalesce(F.col(SALTS_COLUMN), F.lit(1)).cast("int")
    salted_big = (
        big.join(hot, keys, "left")
        .withColumn(_SALT, F.pmod(F.xxhash64(*salt_by), salts).cast("int"))
        .drop(SALTS_COLUMN)
    )
    salted_table = (
        table.join(hot, keys, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop(SALTS_COLUMN)
    )
    return salted_big.join(salted_table, keys + [_SALT], how).drop(_SALT)
