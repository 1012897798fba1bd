"""Benchmark decontamination by the CGK embedding.

Texts and benchmark items are sequences of words (lower case, without marks; each
character of a script without spaces is a word). The
CGK random walk copies the word under a pointer at each step and moves the
pointer on by a random bit that depends on the step and the word; two sequences
at a small edit distance walk in step again after each edit, so their walks have a
small Hamming distance. Bit sampling on the walks (``samples`` steps a table) finds
candidates; the number of tables is set by simulated edits at the threshold so that
``recall`` is reached. Windows start at every word of every text and have the
size of the items; candidates are verified by the exact edit distance in words.

Before the walk a lossless filter drops windows: ``k`` edits cut an item of ``m``
words into at most ``k + 1`` stretches, so an occurrence holds an unchanged stretch of
``m // (k + 1)`` words, at most ``k`` words from its place. Only windows with such a
stretch are walked; the rest can't be occurrences.

Short items, of which no word may differ, and lengths for which ``max_tables`` tables don't reach ``recall`` (long items) are searched
without walks and without loss: ``k`` edits spoil at most ``k * q`` of an item's runs
of ``q`` words, so where the others lie near one diagonal, all windows are aligned
with the item in one pass (``best_window``).

The benchmark is taken in blocks of a bounded number of items and characters, each block as one
map over the documents; only matches are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, slices, string_buffer, text_or_empty
from tidemark.llm.words import mix, word_hashes

SLICE_BYTES = 6 << 20
ITEMS_PER_BLOCK = 20_000
CHARS_PER_BLOCK = 16 << 20  # long items make more blocks, not larger ones
MIN_WORDS = 5  # shorter items allow no edit and are found by their words alone
# Scripts without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, Tai, kana, bopomofo, Han): a character is a word
_UNSPACED = r"\u0E01-\u0EFF\u0F00-\u109F\u1780-\u17FF\u1950-\u19FF\u1A20-\u1AAF\u3005-\u3007\u3021-\u302F\u3031-\u303C\u3041-\u30FA\u30FC-\u312F\u31A0-\u31BF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uA9E0-\uA9FF\uAA60-\uAADF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
_WIDE_MARKS = r"\u3000-\u3004\u3008-\u3020\u3030\u303D-\u303F\u30FB\uFE10-\uFE1F\uFE30-\uFE6F\uFF01-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65\uFFE0-\uFFEE"
_SHIFT = 1 << 20  # keeps positions before a text's begin above zero; more than any item's words
_STEP_KEY = 0x9E3779B97F4A7C15


class Search(NamedTuple):
    """An occurrence has an edit distance of at most ``1 - similarity`` of the item's words."""

    similarity: float = 0.8
    samples: int = 2
    recall: float = 0.95  # of one window at the most edits; nearby windows and fewer edits raise it
    max_tables: int = 1000
    seed: int = 3


def allowed_edits(m: np.ndarray | int, similarity: float) -> np.ndarray | int:
    return np.floor(np.asarray(m) * (1 - similarity) + 1e-9).astype(np.int64)


def walk(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The CGK walks over ``words[start:stop]`` at the (sorted) ``steps``: ``[step, window]``."""
    out = np.zeros((len(steps), len(starts)), np.uint64)
    at, wanted, k = starts.astype(np.int64).copy(), set(steps.tolist()), 0
    last = len(words) - 1
    for t in range(int(steps[-1]) + 1 if len(steps) else 0):
        word = np.where(at < stops, words[np.minimum(at, last)], np.uint64(0))
        if t in wanted:
            out[k] = word
            k += 1
        at += (mix(word + np.uint64((t + 1) * _STEP_KEY % 2**64)) >> np.uint64(63)).astype(np.int64)
    return out


class LengthClass(NamedTuple):
    """Items of ``least`` to almost 1.5 ``least`` words; tables of sampled steps and their keys."""

    tables: np.ndarray  # [table, sample] -> index into steps
    steps: np.ndarray
    keys: list[np.ndarray]  # per table: sorted item keys
    items: list[np.ndarray]  # and the items in that order


class Seeds(NamedTuple):
    """All runs of ``size`` words of the items whose unchanged stretch has that size."""

    size: int
    present: np.ndarray  # bitmap over the top 22 bits of a run's hash
    keys: np.ndarray  # sorted, with the run's item and place
    items: np.ndarray
    places: np.ndarray


class Index(NamedTuple):
    ids: list
    words: list[np.ndarray]
    sizes: np.ndarray
    edits: np.ndarray
    similarity: float
    seeds: list[Seeds]
    classes: list[LengthClass]
    exact: list[Seeds]  # of the items that are searched without walks


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position (those past the end are of no use)."""
    key = np.zeros(len(words), np.uint64)
    for k in range(size):
        follow = np.zeros(len(words), np.uint64)
        follow[: len(words) - k] = words[k:]
        key = key * np.uint64(0x9E3779B97F4A7C15) + (follow ^ (key >> np.uint64(29)))
    return mix(key)


def _seeds(words: list[np.ndarray], edits: np.ndarray, chosen: np.ndarray) -> list[Seeds]:
    by_size: dict[int, list[int]] = {}
    for i in chosen.tolist():
        by_size.setdefault(len(words[i]) // (int(edits[i]) + 1), []).append(i)
    out = []
    for size, mine in sorted(by_size.items()):
        counts = [len(words[i]) - size + 1 for i in mine]
        keys = np.concatenate([_runs(words[i], size)[:n] for i, n in zip(mine, counts)])
        order = np.argsort(keys, kind="stable")
        present = np.zeros(1 << 22, bool)
        present[(keys >> np.uint64(42)).astype(np.int64)] = True
        out.append(Seeds(size, present, keys[order], np.repeat(mine, counts)[order], np.concatenate([np.arange(n) for n in counts])[order]))
    return out


def _table_keys(symbols: np.ndarray, tables: np.ndarray) -> np.ndarray:
    key = np.zeros((len(tables), symbols.shape[1]), np.uint64)
    for s in range(tables.shape[1]):
        key = mix(key * np.uint64(31) + symbols[tables[:, s]] + np.uint64(s + 1))
    return key


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        new = int(rng.integers(1, 2**63))
        if kind == 0:
            out[at] = new
        elif kind == 1:
            out.insert(at, new)
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.uint64)


def _pack(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stops = np.cumsum([len(x) for x in sequences])
    return np.concatenate(sequences), np.r_[0, stops[:-1]], stops


def build_index(ids: list, words: list[np.ndarray], search: Search) -> Index:
    """The tables for items given as word hashes (each of one or more)."""
    sizes = np.array([len(w) for w in words], np.int64)
    edits = allowed_edits(sizes, search.similarity)
    classes, least = [], MIN_WORDS
    exact = sizes < MIN_WORDS
    while len(words) and least <= sizes.max():
        above = max(least + 1, -(-least * 3 // 2))
        mine = np.flatnonzero((sizes >= least) & (sizes < above))
        n, rng = 0, np.random.default_rng([search.seed, least])  # no class depends on another
        if len(mine):
            reach = 2 * least - 1  # the pointer has gone over about ``least`` words by then
            trial = mine[rng.integers(0, len(mine), 300)]
            edited = [_edited(words[i], int(edits[i]), rng) for i in trial]
            every = np.arange(reach)
            same = walk(*_pack([words[i] for i in trial]), every) == walk(*_pack(edited), every)
            hit = same.mean(0) ** search.samples
            n = next((n for n in range(1, search.max_tables + 1) if (1 - (1 - hit) ** n).mean() >= search.recall), 0)
        if not n:  # this class only: others may reach the recall
            exact[mine] = True
        else:
            picked = np.sort(np.array([rng.choice(reach, search.samples, replace=reach < search.samples) for _ in range(n)]), axis=1)
            steps, flat = np.unique(picked, return_inverse=True)
            tables = flat.reshape(picked.shape)
            keys = _table_keys(walk(*_pack([words[i] for i in mine]), steps), tables)
            order = np.argsort(keys, axis=1)
            classes.append(LengthClass(tables, steps, [k[o] for k, o in zip(keys, order)], [mine[o] for o in order]))
        least = above
    walked, rest = np.flatnonzero(~exact), np.flatnonzero(exact)
    return Index(ids, words, sizes, edits, search.similarity, _seeds(words, edits, walked), classes, _seeds(words, edits, rest))


def _lookup(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``wanted``, index into ``sorted_keys``) of all equal pairs."""
    left = np.searchsorted(sorted_keys, wanted, "left")
    many = np.searchsorted(sorted_keys, wanted, "right") - left
    return np.repeat(np.arange(len(wanted)), many), np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def windows(words: np.ndarray, firsts: np.ndarray, stops: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The positions at which an occurrence may begin, and the sorted keys of the
    unchanged stretches (item, then position of the stretch less its place in the item).

    ``firsts``, ``stops``: for every word the begin and end of its text."""
    marks = np.zeros(len(words) + 1, np.int64)
    keys = [np.empty(0, np.int64)]
    for seeds in index.seeds:
        run = _runs(words, seeds.size)
        at = np.flatnonzero(seeds.present[(run >> np.uint64(42)).astype(np.int64)])
        at = at[at + seeds.size <= stops[at]]
        which, seed = _lookup(seeds.keys, run[at])
        at, edits = at[which], index.edits[seeds.items[seed]]
        low = np.maximum(at - seeds.places[seed] - edits, firsts[at])
        high = np.minimum(at - seeds.places[seed] + edits, stops[at] - 1)
        fits = low <= high
        np.add.at(marks, low[fits], 1)
        np.add.at(marks, high[fits] + 1, -1)
        keys.append((seeds.items[seed][fits] << 40) + at[fits] - seeds.places[seed][fits] + _SHIFT)
    return np.flatnonzero(np.cumsum(marks[:-1]) > 0), np.unique(np.concatenate(keys))


def candidates(words: np.ndarray, firsts: np.ndarray, stops: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(word position, item) pairs whose walks agree in some table."""
    starts, stretches = windows(words, firsts, stops, index)
    pairs = [np.empty((2, 0), np.int64)]
    for c in index.classes:
        for i in range(0, len(starts), 20_000):
            s = starts[i : i + 20_000]
            keys = _table_keys(walk(words, s, stops[s], c.steps), c.tables)
            for t, key in enumerate(keys):
                which, found = _lookup(c.keys[t], key)
                pairs.append(np.stack([s[which], c.items[t][found]]))
    key = np.unique(np.concatenate([(p[1] << 40) + p[0] for p in pairs]))
    # of another item's windows only those near an unchanged stretch of this one (lossless, like the windows)
    edits = index.edits[key >> 40]
    near = np.searchsorted(stretches, key + _SHIFT + edits, "right") > np.searchsorted(stretches, key + _SHIFT - edits, "left")
    key = key[near]
    return key & ((1 << 40) - 1), key >> 40


def distances(words: np.ndarray, at: np.ndarray, stops: np.ndarray, item: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact edit distances of items of one length (a row each) to the best window from each position, and the windows' ends."""
    m, width = item.shape[1], item.shape[1] + edits
    best, end = np.full(len(at), m), at.copy()
    row = np.tile(np.arange(m + 1), (len(at), 1))  # distances of the empty window to the item's prefixes
    for j in range(width):
        inside = at + j < stops
        if not inside.any():
            break
        word = words[np.minimum(at + j, len(words) - 1)]
        new = np.empty_like(row)
        new[:, 0] = j + 1
        cost = item != word[:, None]
        new[:, 1:] = np.minimum(row[:, :-1] + cost, row[:, 1:] + 1)
        # insertions along the item: a running minimum of new[i] - i
        steps = np.arange(m + 1)
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        row = np.where(inside[:, None], new, row)
        better = inside & (row[:, m] < best)
        best = np.where(better, row[:, m], best)
        end = np.where(better, at + j + 1, end)
    return best, end


def best_window(words: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance of ``item`` to a window of ``words``, the first begin with it and
    the first end with both: one pass for all windows, cells are (distance, begin) in one number."""
    unit = 1 << 40
    steps = np.arange(len(item) + 1) * unit
    row, best, end = steps, int(steps[-1]), 0
    for j, word in enumerate(words):
        new = np.empty_like(row)
        new[0] = j + 1
        new[1:] = np.minimum(row[:-1] + (item != word) * unit, row[1:] + unit)
        row = np.minimum.accumulate(new - steps) + steps
        if row[-1] < best:
            best, end = int(row[-1]), j + 1
    return best // unit, best % unit, end


def _added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of ``keys`` in order, and their summed counts."""
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)][: keys.shape[1]])
    return keys[:, first], np.add.reduceat(counts[order], first) if len(first) else counts


def exact_matches(words: np.ndarray, firsts: np.ndarray, ends: np.ndarray, text: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, text, distance, begin, end) of the occurrences of the items that aren't walked, the
    best one among them. ``firsts``, ``ends``: of every text; ``text``: of every word."""
    for seeds in index.exact:
        run = _runs(words, seeds.size)
        at = np.flatnonzero(seeds.present[(run >> np.uint64(42)).astype(np.int64)])
        at = at[at + seeds.size <= ends[text[at]]]
        many = np.cumsum(np.searchsorted(seeds.keys, run[at], "right") - np.searchsorted(seeds.keys, run[at], "left"))
        keys, counts = np.empty((3, 0), np.int64), np.empty(0, np.int64)
        for part in np.split(at, np.flatnonzero(np.diff(many >> 21)) + 1):  # bounds the pairs held at a time
            which, seed = _lookup(seeds.keys, run[part])
            found = np.stack([seeds.items[seed], text[part[which]], part[which] - seeds.places[seed]])
            keys, counts = _added_up(np.concatenate([keys, found], 1), np.r_[counts, np.ones(len(seed), np.int64)])
        groups = np.flatnonzero(np.r_[True, (keys[:2, 1:] != keys[:2, :-1]).any(0)][: keys.shape[1]])
        for low, high in zip(groups, np.r_[groups[1:], keys.shape[1]]):
            item, t, diagonal, hits = int(keys[0, low]), int(keys[1, low]), keys[2, low:high], counts[low:high]
            wanted, k, first, end = index.words[item], int(index.edits[item]), int(firsts[t]), int(ends[t])
            m = len(wanted)
            runs = m - seeds.size + 1
            whole = diagonal[(hits >= runs) & (diagonal >= first) & (diagonal + m <= end)].tolist()
            copy = next((s for s in whole if np.array_equal(words[s : s + m], wanted)), None)
            if copy is not None:
                yield item, t, 0, copy, copy + m
                continue
            # begins with ``runs - k * size`` hits (one at least) on diagonals at most k away
            total = np.cumsum(hits)
            last = np.searchsorted(total, total - hits + runs - k * seeds.size)
            one = np.flatnonzero(last < len(total))
            one = one[diagonal[last[one]] - diagonal[one] <= 2 * k]
            spans: list[list[int]] = []
            for a, b in zip(np.maximum(diagonal[last[one]] - k, first).tolist(), np.minimum(diagonal[one] + k, end - 1).tolist()):
                if a <= b and spans and a <= spans[-1][1] + m + k:
                    spans[-1][1] = max(spans[-1][1], b)
                elif a <= b:
                    spans.append([a, b])
            for a, b in spans if k else []:
                distance, begin, stop = best_window(words[a : min(end, b + m + k)], wanted)
                if distance <= k:
                    yield item, t, distance, a + begin, a + stop


def matches(words: np.ndarray, rows: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, first word, end word) of the best occurrence of each item in each row."""
    if not len(words) or not index.ids:
        return []
    ends = np.r_[np.flatnonzero(rows[1:] != rows[:-1]) + 1, len(rows)]
    firsts = np.r_[0, ends[:-1]]
    text = np.repeat(np.arange(len(ends)), ends - firsts)
    at, items = candidates(words, firsts[text], ends[text], index)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def note(where: np.ndarray, item: np.ndarray, distance: np.ndarray, end: np.ndarray) -> None:
        for s, i, d, e in zip(where.tolist(), item.tolist(), distance.tolist(), end.tolist()):
            first = int(firsts[text[s]])
            found = (d, s - first, e - first)
            key = (int(rows[s]), i)
            best[key] = min(best.get(key, found), found)

    for i, t, d, s, e in exact_matches(words, firsts, ends, text, index):
        found, key = (d, s - int(firsts[t]), e - int(firsts[t])), (int(rows[s]), i)
        best[key] = min(best.get(key, found), found)

    sizes = index.sizes[items]
    for m in np.unique(sizes):
        mine = np.flatnonzero(sizes == m)
        k = int(allowed_edits(m, index.similarity))
        rest = []
        for i in range(0, len(mine), 4096):  # plain copies first; they need no further look at their text and item
            s, which = at[mine[i : i + 4096]], items[mine[i : i + 4096]]
            item = np.stack([index.words[j] for j in which])
            equal = (words[np.minimum(s[:, None] + np.arange(m), len(words) - 1)] == item).all(1) & (s + m <= ends[text[s]])
            note(s[equal], which[equal], np.zeros(equal.sum(), np.int64), s[equal] + m)
            rest += [j for j, x, y in zip(mine[i : i + 4096][~equal], rows[s[~equal]].tolist(), which[~equal].tolist()) if best.get((x, y), (1,))[0]]
        rest = np.array([j for j in rest if best.get((int(rows[at[j]]), int(items[j])), (1,))[0]], np.int64)
        for i in range(0, len(rest), 4096):
            s, which = at[rest[i : i + 4096]], items[rest[i : i + 4096]]
            distance, end = distances(words, s, ends[text[s]], np.stack([index.words[j] for j in which]), k)
            fits = distance <= k
            note(s[fits], which[fits], distance[fits], end[fits])
    return [(row, item, *found) for (row, item), found in sorted(best.items())]


def _normal(column: str) -> Column:
    """The text in lower case, with spaces round the characters of unspaced scripts and for wide marks."""
    text = F.lower(text_or_empty(column))
    apart = F.regexp_replace(F.regexp_replace(text, f"[{_WIDE_MARKS}]", " "), f"([{_UNSPACED}])", " $1 ")
    return F.when(text.rlike(f"[{_WIDE_MARKS}{_UNSPACED}]"), apart).otherwise(text)


def _indexes(docs: DataFrame, benchmark: DataFrame, search: Search, per_block: int) -> Iterator:
    """Broadcast indexes of the benchmark, each of at most about ``per_block`` items."""
    items = benchmark.select("item_id", _normal("text").alias("t"))
    total = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-total["n"] // per_block), -(-total["chars"] // CHARS_PER_BLOCK))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == b).toArrow()
        column = pa.concat_arrays([*part.column("t").chunks, pa.array([], pa.string())])
        hashes, rows = word_hashes(*string_buffer(column), marks=True)
        cuts = np.searchsorted(rows, np.arange(len(column) + 1))
        use = [i for i in range(len(column)) if cuts[i + 1] > cuts[i]]
        names = part.column("item_id").to_pylist()
        index = build_index([names[i] for i in use], [hashes[cuts[i] : cuts[i + 1]] for i in use], search)
        yield docs.sparkSession.sparkContext.broadcast(index)


def find_leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search(), per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """One row per (document, item) with an occurrence: doc_id, item_id, distance,
    item_words, first_word and end_word (of the best occurrence, counted in words).

    NULL texts are empty and match nothing, like items without a word; items with fewer
    than ``MIN_WORDS`` words match where all their words stand in a run; repeated documents and items match each on their own. Rows with
    NULL ids match like others and carry the NULL."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _normal("text").alias("_lm_text"))
    out = None
    for index in _indexes(docs, benchmark.withColumn("item_id", F.col("item_id").cast("long")), search, per_block):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1, SLICE_BYTES):
                words, rows = word_hashes(*string_buffer(batch.column(1)), marks=True)
                found = matches(words, rows, index.value)
                if found:
                    row, item, distance, first, end = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([index.value.ids[i] for i in item], pa.int64()), pa.array(distance, pa.int32()),
                         pa.array([len(index.value.words[i]) for i in item], pa.int32()), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                        names=["doc_id", "item_id", "distance", "item_words", "first_word", "end_word"])

        found = src.mapInArrow(run, "doc_id long, item_id long, distance int, item_words int, first_word long, end_word long")
        out = found if out is None else out.unionAll(found)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, search: Search = Search(), per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``docs`` without the rows that hold an occurrence of an item: a map, no shuffle."""
    for index in _indexes(docs, benchmark, search, per_block):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, -1, SLICE_BYTES):
                words, rows = word_hashes(*string_buffer(batch.column(batch.num_columns - 1)), marks=True)
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in matches(words, rows, index.value)]] = False
                kept = batch.filter(pa.array(clean))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

        docs = docs.withColumn(free_name(docs, "_lm_normal"), _normal("text")).mapInArrow(run, docs.schema)
    return docs
