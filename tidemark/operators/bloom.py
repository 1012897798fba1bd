"""Semi-join reduction by a blocked Bloom filter that is itself a table.

A filter of ``blocks`` blocks of 512 bits is a DataFrame (block, w0..w7): a key sets one
bit in each of the eight words of one block. It is built by one hash aggregate
(``bit_or`` per word, merged from map-side partials, so any number of tasks can build it)
and applied by one lookup of the key's block, a broadcast hash join on a long, followed by
eight bit tests. A key that was added always passes; about one other key in a hundred passes too
(``BITS_PER_KEY`` bits a key), so results don't change, only fewer rows travel.

``pays`` says whether a filter is worth its pass: not where most rows would pass it.
The size follows the counted keys. A filter beyond ``max_bytes`` isn't built:
``keep_known`` then returns its input, and the join that follows does all the work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

WORDS = 8
BITS_PER_KEY = 12
BLOCK_BYTES = 96  # a row of the broadcast relation: key, eight words, row header
MAX_BYTES = 256 << 20
MIN_REDUCTION = 4  # a filter that lets more than a quarter pass isn't built

_BLOCK, _HASH = "_tm_block", "_tm_hash"
_BITS = [f"_tm_w{i}" for i in range(WORDS)]


@dataclass(frozen=True)
class KeyFilter:
    """``table`` is None where the filter would have been too large."""

    table: DataFrame | None
    blocks: int


def _placed(df: DataFrame, column: str, blocks: int) -> DataFrame:
    """Rows with a key, its block and a hash that is independent of the block and names the bits."""
    place = F.xxhash64(column)
    return df.filter(F.col(column).isNotNull()).withColumns({
        _BLOCK: F.pmod(place, F.lit(blocks).cast("bigint")), _HASH: F.xxhash64(place, F.lit(1))})


def _masks() -> list[Column]:
    one, low = F.lit(1).cast("bigint"), F.lit(63).cast("bigint")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(_HASH, 6 * i).bitwiseAND(low).cast("int")) for i in range(WORDS)]


def key_filter(keys: DataFrame, column: str, rows: int, max_bytes: int = MAX_BYTES) -> KeyFilter:
    """The filter of ``column`` of ``keys``; ``rows`` is a counted bound of its keys. Written once,
    so that every scan it reduces reads the small table."""
    blocks = max(1, -(-rows * BITS_PER_KEY // (64 * WORDS)))
    if blocks * BLOCK_BYTES > max_bytes:
        return KeyFilter(None, blocks)
    marks = [F.bit_or(mask).alias(name) for mask, name in zip(_masks(), _BITS)]
    return KeyFilter(materialize(_placed(keys.select(column), column, blocks).groupBy(_BLOCK).agg(*marks)), blocks)


def pays(keys: int, rows: int) -> bool:
    """Whether ``keys`` of ``rows`` rows are few enough for a filter to spare more than it costs."""
    return keys * MIN_REDUCTION <= rows


def keep_known(df: DataFrame, column: str, known: KeyFilter) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be a key of the filter (all that are, about one in a hundred that isn't)."""
    if known.table is None:
        return df
    found = _placed(df, column, known.blocks).join(F.broadcast(known.table), _BLOCK)
    hit = None
    for mask, name in zip(_masks(), _BITS):
        test = F.col(name).bitwiseAND(mask) != 0
        hit = test if hit is None else hit & test
    return found.filter(hit).select(*df.columns)
