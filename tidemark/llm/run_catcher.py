"""Periodic runs in word sequences, found online by catchers over dyadic blocks.

``RunCatcher`` reads a word sequence piece by piece. For every completed block
``[b, b + L)`` with ``L`` a power of two and ``b`` a multiple of ``L`` it keeps a catcher: the
hash of the block, which waits for the block to come back ``p`` words later, ``2L - 1 <= p <= 4L - 2``.
A run of period ``p`` holds a whole block of that size in its first period, wherever it
starts, so no run is missed, and each appended word meets two catchers a level: the suffix
comparisons of one word cost O(log n). A caught square grows word by word to both sides as
far as words ``p`` apart agree (words are compared there, not hashes); once it holds
enough copies it becomes a run, and a run that reaches the end of the sequence stays open
and grows with the next words. Catches inside a known run whose period divides theirs merge into it.

The comparisons of all words of a piece are made level by level in numpy; the result doesn't
depend on the pieces. Memory: the sequence, two hashes a word over all levels, and the last
block length of hashes a level. A run of ``c`` or more copies is extended in time linear in
its length; runs with distinct periods overlap by less than two periods, so all extensions
together stay near-linear in the number of words.

Cases of ``find_runs`` (a map over rows, no shuffle):

* A NULL or empty text, or one of white space only, has no words: no runs, collapsed text "".
* Repeated rows and ids are independent: every row has its own result.
* Very long texts: a text is never cut; runs are independent of the batches that rows come in.
* An empty table gives an empty table. Columns of the input stay; ``n_words``, ``runs`` and
  ``collapsed`` replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import free_name, slices, string_buffer, text_or_empty
from tidemark.llm.words import WHITE, mix, word_spans

MIN_LENGTH, MIN_COPIES = 6, 4
RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
_SLICE_BYTES = 4 << 20
_PIECE = 1 << 17  # words appended at once


class _Level:
    """Blocks of one length: hashes of the completed blocks (catchers) and of the latest starts."""

    def __init__(self, length: int):
        self.length = length
        self.done = 0  # starts hashed so far
        self.tail = np.empty(0, np.uint64)  # hashes of the last starts, as the next level needs them
        self.catchers = np.empty(0, np.uint64)
        self.waiting = np.empty((2, 0), np.int64)  # caught (block, period) whose copies are still to come

    def take(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add the hashes of the next starts; gives the caught (block, period) pairs."""
        size, first = self.length, self.done
        self.done += len(hashes)
        self.catchers = np.concatenate([self.catchers, hashes[-first % size :: size]])
        starts = np.arange(first, self.done)
        blocks, periods = [], []
        newest = (starts - 2 * size + 1) // size  # the two blocks at a distance within [2L - 1, 4L - 2]
        for block in (newest, newest - 1):
            live = np.flatnonzero(block >= 0)
            live = live[self.catchers[block[live]] == hashes[live]]
            blocks.append(block[live] * size)
            periods.append(starts[live] - block[live] * size)
        return np.concatenate(blocks), np.concatenate(periods)


def _agreeing(words: np.ndarray, at: int, period: int, end: int, step: int) -> int:
    """How many words from ``at`` on (``step`` 1) or before it (-1), up to ``end``, equal those a period later."""
    done, width = 0, 32
    left = abs(end - at)
    while done < left:
        width = min(2 * width, left - done)
        lo = at + done if step > 0 else at - done - width
        same = words[lo : lo + width] == words[lo + period : lo + period + width]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done += width
    return done


def _prime_factors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return [*out, n] if n > 1 else out


class RunCatcher:
    """Runs of at least ``min_copies`` periods and ``min_length`` words in a growing sequence.

    ``append`` takes word numbers (equal numbers, equal words); ``runs`` gives
    (start, length, period) of the sequence so far, by start and period."""

    def __init__(self, min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES):
        if min_copies < 2:
            raise ValueError("a run has at least two copies of its period")
        self.min_length, self.min_copies = min_length, min_copies
        self.n = 0
        self.words = np.empty(0, np.int64)
        self.cover = np.empty(0, np.int32)  # number of the run of longest period that holds the word
        self.held = np.empty(0, np.int64)  # its period, 0: no run
        self.levels: list[_Level] = []
        self.found: dict[tuple[int, int], int] = {}  # (start, period) -> number
        self.start, self.period, self.end = ([], [], [])

    def append(self, words: np.ndarray) -> None:
        n0, self.n = self.n, self.n + len(words)
        if len(self.words) < self.n:
            room = max(2 * len(self.words), self.n) - len(self.words)
            self.words = np.concatenate([self.words, np.zeros(room, np.int64)])
            self.cover = np.concatenate([self.cover, np.zeros(room, np.int32)])
            self.held = np.concatenate([self.held, np.zeros(room, np.int64)])
        self.words[n0 : self.n] = words
        for i in [i for i, end in enumerate(self.end) if end == n0]:
            self._grow(i)
        hashes, length, k = self._single(words), 1, 0
        while self.min_copies * (2 * length - 1) <= self.n:
            if k == len(self.levels):
                self.levels.append(_Level(length))
                hashes = self._hashes_below(k)  # the level begins now, with all starts so far
            level = self.levels[k]
            block, period = level.take(hashes)
            self._follow(level, block, period)
            kept = np.concatenate([level.tail, hashes])
            hashes = self._doubled(kept, length)
            level.tail = kept[max(0, len(kept) - length) :]
            length, k = 2 * length, k + 1

    @staticmethod
    def _single(words: np.ndarray) -> np.ndarray:
        return mix(np.asarray(words, np.int64).astype(np.uint64) + np.uint64(1))

    @staticmethod
    def _doubled(hashes: np.ndarray, length: int) -> np.ndarray:
        """Hashes of blocks of twice the length from those of consecutive starts."""
        return mix(hashes[:-length] * np.uint64(0x9E3779B97F4A7C15) + hashes[length:]) if len(hashes) > length else np.empty(0, np.uint64)

    def _hashes_below(self, k: int) -> np.ndarray:
        """Hashes of all starts for level ``k``, from the words."""
        hashes = self._single(self.words[: self.n])
        for j in range(k):
            hashes = self._doubled(hashes, 1 << j)
        return hashes

    def _follow(self, level: _Level, block: np.ndarray, period: np.ndarray) -> None:
        """Extend what the level caught, as far as words are there."""
        if len(block):
            q = self.held[block]
            inside = q > 0
            if inside.any():
                end = np.array(self.end)[self.cover[block[inside]]]
                inside[inside] = (period[inside] % q[inside] == 0) & (block[inside] + period[inside] + level.length <= end)
                block, period = block[~inside], period[~inside]
        block = np.concatenate([level.waiting[0], block])
        period = np.concatenate([level.waiting[1], period])
        ready = block + (self.min_copies - 1) * period + level.length <= self.n
        waiting = [np.stack([block[~ready], period[~ready]])]
        block, period = block[ready], period[ready]
        for copy in range(2, self.min_copies):  # most squares have no third copy
            same = self.words[block + copy * period] == self.words[block]
            block, period = block[same], period[same]
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        i = 0
        while i < len(block):
            b, p = int(block[i]), int(period[i])
            start = b - _agreeing(self.words, b, p, 0, -1)
            end = b + p + _agreeing(self.words, b, p, self.n - p, 1)
            if end - start >= max(self.min_length, self.min_copies * p):
                self._add(start, p, end)
            elif end == self.n:  # it may still grow
                waiting.append(np.array([[b], [p]]))
            # all other catches inside this stretch
            i += max(1, self._later(block, period, i, end - p))
        level.waiting = np.concatenate(waiting, 1)

    @staticmethod
    def _later(block: np.ndarray, period: np.ndarray, i: int, end: int) -> int:
        """How many catches from ``i`` on have its period and a block before ``end``."""
        stop = i + int(np.searchsorted(period[i:], period[i], "right"))
        return int(np.searchsorted(block[i:stop], end, "left"))

    def _add(self, start: int, period: int, end: int) -> None:
        if (start, period) in self.found:
            return
        for prime in _prime_factors(period):  # the smallest period divides every period of a square
            q = period // prime
            if _agreeing(self.words, start, q, end - q, 1) == end - q - start:
                return
        self.found[start, period] = len(self.start)
        self.start.append(start)
        self.period.append(period)
        self.end.append(end)
        self._mark(len(self.start) - 1, start)

    def _grow(self, i: int) -> None:
        end, p = self.end[i], self.period[i]
        self.end[i] = end + _agreeing(self.words, end - p, p, self.n - p, 1)
        self._mark(i, end)

    def _mark(self, i: int, first: int) -> None:
        held, cover = self.held[first : self.end[i]], self.cover[first : self.end[i]]
        longer = held < self.period[i]
        held[longer], cover[longer] = self.period[i], i

    def runs(self) -> list[tuple[int, int, int]]:
        return sorted((s, e - s, p) for s, p, e in zip(self.start, self.period, self.end))


def _catch(words: np.ndarray, rows: np.ndarray, n_rows: int, min_length: int, min_copies: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 4 array of row, start, length, period by row, start, period; mask of the words to keep) of
    word numbers ``words`` in rows ``rows`` (ascending): one sequence, each row ends in a word of its own."""
    firsts = np.searchsorted(rows, np.arange(n_rows))
    place = np.arange(len(words)) + rows
    sequence = -1 - np.arange(len(words) + n_rows)  # numbers that no word has, each once
    sequence[place] = words
    catcher = RunCatcher(min_length, min_copies)
    for i in range(0, len(sequence), _PIECE):
        catcher.append(sequence[i : i + _PIECE])
    found = np.array(catcher.runs(), np.int64).reshape(-1, 3)
    ends = np.cumsum(np.bincount(rows, minlength=n_rows) + 1) if n_rows else np.empty(0, np.int64)
    row = np.searchsorted(ends, found[:, 0], "right")
    first = found[:, 0] - row  # in ``words``
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, first + found[:, 2], 1)
    np.add.at(gone, first + found[:, 1], -1)
    runs = np.column_stack([row, first - firsts[row], found[:, 1], found[:, 2]])
    return runs, np.cumsum(gone[:-1]) == 0


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _batches(batches: Iterator[pa.RecordBatch], min_length: int, min_copies: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, -1, _SLICE_BYTES):
        n = batch.num_rows
        data, offsets = string_buffer(batch.column(batch.num_columns - 1))
        starts, stops, rows = word_spans(data, offsets)
        # the words as one Arrow array: all bytes that are no white space
        bounds = np.concatenate([[0], np.cumsum(stops - starts)])
        raw = pa.py_buffer(data[~WHITE[data]].tobytes())
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64).tobytes()), raw)
        numbers = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        runs, keep = _catch(numbers, rows, n, min_length, min_copies)
        kept = words if keep.all() else words.filter(pa.array(keep))
        collapsed = pc.binary_join(_lists(np.bincount(rows[keep], minlength=n), kept), pa.scalar(" ", pa.large_string()))
        structs = pa.StructArray.from_arrays([pa.array(runs[:, j]) for j in (1, 2, 3)], ["start", "length", "period"])
        found = _lists(np.bincount(runs[:, 0], minlength=n), structs)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(np.bincount(rows, minlength=n)), found, collapsed.cast(pa.string())],
            [*batch.schema.names[:-1], "n_words", "runs", "collapsed"],
        )


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_copies: int = MIN_COPIES,
              keep_text: bool = False) -> DataFrame:
    """``docs`` (its text column only if ``keep_text``) with ``n_words``, all ``runs`` of the text's words (by start and
    period) and the ``collapsed`` text: the words joined by one space, of each run only the first period kept."""
    stay = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed") and (keep_text or c.lower() != text_col.lower())]
    text = free_name(docs.select(*stay), "_lm_text")
    wide = docs.select(*stay, text_or_empty(text_col).alias(text))
    schema = T.StructType([*wide.drop(text).schema.fields, *T._parse_datatype_string(f"n_words bigint, runs {RUNS_TYPE}, collapsed string").fields])
    return wide.mapInArrow(lambda batches: _batches(batches, min_length, min_copies), schema)
