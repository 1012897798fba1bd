"""Best-fit packing of token sequences by minimum bin slack.

Documents become token ids plus an end id; longer ones are cut into pieces of at
most ``capacity`` ids (the first piece takes the remainder). The plan works on
the histogram of piece lengths alone: for each bin the longest length left opens
it and a bitset subset-sum over the lengths left finds the fullest feasible
combination, which is removed. A combination is taken as often as its lengths
last, so the plan has a few thousand entries at any number of pieces and is the
only thing the driver sees. Pieces find their place from their rank within
their length, which comes from per-partition counts (no window over a length).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import slices, stage, text_or_empty

CAPACITY = 1024
END_ID = 2
SLICE_BYTES = 4 << 20
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a tokenizers file, kept per worker. Where the same
    vocabulary lies beside it as tiktoken ranks those give the same ids at a
    third of the time (``tests/llm`` compares the two)."""
    if path not in _ENCODERS:
        import os

        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        ranks_file = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks_file):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            plain = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            added = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or "(?!)")
            # strings of added tokens are tokens of their own, which the ranks don't know
            _ENCODERS[path] = lambda text: whole.encode(text, add_special_tokens=False).ids if added.search(text) else plain.encode_ordinary(text)
        else:
            _ENCODERS[path] = lambda text: whole.encode(text, add_special_tokens=False).ids
    return _ENCODERS[path]


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, with
    ``keep_ids``, the ids. NULL texts are empty (one piece with the end id only);
    repeated rows give their pieces again."""
    src = docs.select("doc_id", text_or_empty("text").alias("_lm_text"))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, 1, SLICE_BYTES):
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py()), end_id], "<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if keep_ids:
                        kept.append(ids[a:b].astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return src.mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def _fullest(counts: np.ndarray, capacity: int) -> list[int]:
    """The longest length left and the lengths that fill the rest best (bitset subset-sum)."""
    lengths = np.flatnonzero(counts)[::-1].tolist()
    seed = lengths[0]
    room = capacity - seed
    if room == 0:
        return [seed]
    mask = (1 << (room + 1)) - 1
    reach, states = 1, []
    for length in lengths:
        if length > room:
            continue
        copies = min(int(counts[length]) - (length == seed), room // length)
        for _ in range(copies):
            grown = (reach | (reach << length)) & mask
            if grown == reach:
                break
            states.append((length, reach))
            reach = grown
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    chosen = [seed]
    for length, before in reversed(states):
        if not before >> left & 1:  # not reachable without this copy
            chosen.append(length)
            left -= length
    return chosen


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of the bins for a histogram ``counts[length]``; uses every piece."""
    counts = counts.copy()
    plan = []
    while counts.any():
        chosen = _fullest(counts, capacity)
        used = np.bincount(chosen, minlength=len(counts))
        at = np.flatnonzero(used)
        times = int((counts[at] // used[at]).min())
        counts -= used * times
        plan.append((times, chosen))
    return plan


class _Slots:
    """For each length: the rank at which each slot of the plan starts, and where it leads."""

    def __init__(self, plan: list[tuple[int, list[int]]], capacity: int):
        firsts = [[] for _ in range(capacity + 1)]
        ranks = [0] * (capacity + 1)
        base = 0
        for times, chosen in plan:
            offset = 0
            for length in chosen:
                firsts[length].append((ranks[length], base, offset))
                ranks[length] += times
                offset += length
            base += times
        self.tables = [np.array(x, np.int64).reshape(-1, 3) for x in firsts]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for size in np.unique(length):
            table, mine = self.tables[size], length == size
            k = np.searchsorted(table[:, 0], rank[mine], "right") - 1
            sequence[mine] = table[k, 1] + rank[mine] - table[k, 0]
            offset[mine] = table[k, 2]
        return sequence, offset


def _ranks_in_order(length: np.ndarray) -> np.ndarray:
    """For each element how often its value came before."""
    order = np.argsort(length, kind="stable")
    sorted_ = length[order]
    first = np.r_[True, sorted_[1:] != sorted_[:-1]]
    starts = np.flatnonzero(first)
    rank = np.arange(len(length)) - np.repeat(starts, np.diff(np.r_[starts, len(length)]))
    out = np.empty(len(length), np.int64)
    out[order] = rank
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = 20_000) -> DataFrame:
    """``pieces`` (with ``length`` <= ``capacity``) plus sequence_id and offset.

    The pieces are written once with a group number (runs of ``group_rows`` rows of
    a writing task). Counts per (group, length) give each group's first rank of
    every length by a window over groups; each group then ranks and places its
    own rows, so no task holds more than a group, whatever length is frequent.
    """
    spark = pieces.sparkSession
    serial = F.monotonically_increasing_id()
    group = F.shiftright(serial, 33) * F.lit(1 << 24) + F.floor(serial.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(group_rows))
    written = stage(pieces.withColumn("_lm_group", group.cast("long")), "pieces")
    counts = written.groupBy("_lm_group", "length").agg(F.count(F.lit(1)).alias("_lm_n"))
    total = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_lm_n").alias("n")).collect():  # at most ``capacity`` rows
        total[r["length"]] = r["n"]
    slots = spark.sparkContext.broadcast(_Slots(plan_bins(total, capacity), capacity))
    offsets = counts.select(
        "_lm_group", "length",
        F.expr("coalesce(sum(_lm_n) over (partition by length order by _lm_group rows between unbounded preceding and 1 preceding), 0)").alias("_lm_first"),
    )
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        first = np.zeros(capacity + 1, np.int64)
        first[right.column("length").to_numpy()] = right.column("_lm_first").to_numpy()
        length = left.column("length").to_numpy()
        sequence, offset = slots.value.place(length, first[length] + _ranks_in_order(length))
        return left.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return written.groupBy("_lm_group").cogroup(offsets.groupBy("_lm_group")).applyInArrow(place, schema)
